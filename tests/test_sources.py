"""Files in, files out."""

import pytest
from pyspark.sql import functions as F

from vigilmesh.plans.ingestion import city_lines, envelopes
from vigilmesh.sources import archive, labelled, observations, sinks


def test_archive_csv_round_trip(spark, tables, tmp_path):
    header = ",".join(f.split()[0] for f in archive.LAYOUT["city_kpi_5m.csv"].split(", "))
    lines = [header] + [r.line for r in city_lines(tables).collect()]
    (tmp_path / "city_kpi_5m.csv").write_text("\n".join(lines) + "\n")
    rows = archive.read_file(spark, str(tmp_path), "city_kpi_5m.csv")
    assert rows.count() == tables.city5m.count()
    bad = tables.city5m.where("slot % 101 = 0").count()
    assert rows.agg(F.count("_corrupt"), F.count("city_id")).first()[0] == bad
    assert rows.select(F.sum("voice_success")).first() == tables.city5m.select(F.sum("voice_success")).first()
    assert rows.where("size(sms_delay_hist) <> 9 OR sms_delay_hist IS NULL").count() == 0


def test_archive_header_is_pinned(spark, tmp_path):
    (tmp_path / "countries.csv").write_text("id,label,partner_id\nRO,Romania,RO-DEMO-01\n")
    with pytest.raises(Exception, match="(?i)header"):
        archive.read_file(spark, str(tmp_path), "countries.csv").select("name").collect()


def test_observation_files(spark, tables, tmp_path):
    source = envelopes(tables)
    source.write.json(str(tmp_path / "in"))
    back = observations.read_files(spark, str(tmp_path / "in"))
    got = observations.validate(back, tables.catalogue).groupBy("reason").count().collect()
    want = observations.validate(source, tables.catalogue).groupBy("reason").count().collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)


def test_metric_csv_export(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q"', [1, 2]), (2, None, []), (3, "", [3])], "n int, s string, a array<int>")
    sinks.write_csv(df.coalesce(1), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*")).read_bytes().decode()
    assert text.split("\r\n") == ['"n","s","a"', '"1","a ""q""","[1,2]"', '"2",,"[]"', '"3","","[3]"', ""]
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_csv(df, str(tmp_path / "out"))


def test_json_artifact_refuses_to_overwrite(spark, tmp_path):
    df = spark.range(3)
    sinks.write_json(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_json(df, str(tmp_path / "out"))


def test_labelled_split_reading(spark, tmp_path):
    (tmp_path / "train.jsonl").write_text(
        '{"service":"SMS","runId":"r","split":"train","windowStart":"2026-01-01T00:00:00Z","featureValues":[1,2,3,4,5,6],"label":"NORMAL","severity":0}\n'
        '{"service":"SMS","runId":"r","split":"train","windowStart":"2026-01-01T00:01:00Z","featureValues":[1,2],"label":"FAULT","severity":1}\n')
    rows = labelled.read_split(spark, str(tmp_path), "train")
    assert [r[0] for r in rows.orderBy("windowStart").select(labelled.finite_vector(F.col("featureValues"))).collect()] == [True, False]


def test_truncated_dead_letter(spark, tables):
    big = spark.createDataFrame([("S0", "{" + "x" * 70000, 1)], "key string, payload string, arrival bigint").withColumn("received_at", F.current_timestamp())
    r = observations.dead_letters(observations.validate(big, tables.catalogue)).first()
    assert (r.reason_code, len(r.raw_payload), r.payload_size, r.payload_truncated) == ("MALFORMED_JSON", 65536, 70001, True)


def test_known_archive_row(spark):
    """Golden values of one published row: 7957 attempts, 7900 successes."""
    line = (
        '2026-09-10T09:00:00.000Z,chi,7957,7900,28,1034167.194308,3274.817784,6598.184313,"{3559,1955,1665,503,198,19,1,0,0}",'
        '3979,4139,0,0,0,"{2471,996,628,44,0,0,0,0,0}",1358,1348,10864,10842,45.584172,557,554'
    )
    from vigilmesh.functions.arithmetic import percent

    rows = archive.parse_lines(spark.createDataFrame([(line,)], "line string"), "line", "city_kpi_5m.csv")
    r = rows.select(
        "ts", "_corrupt", F.aggregate("voice_setup_hist", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("cohort"),
        percent(F.col("voice_success"), F.col("voice_attempts")).alias("rate")).first()
    assert (r.ts.isoformat(), r["_corrupt"], r.cohort) == ("2026-09-10T09:00:00", None, 7900)
    assert abs(r.rate - 99.28364961668971) < 1e-9


def test_every_part_of_an_archive_needs_its_header(spark, tmp_path):
    header = archive.header_of("link_kpi_5m.csv").split(",")
    swapped = [header[0], header[1], header[3], header[2], *header[4:]]
    row = "2026-09-10 09:00:00,L1,1.0,2.0,0.1,3.0,0.2,0,0"
    folder = tmp_path / "link_kpi_5m.csv"
    folder.mkdir()
    (folder / "part-0.csv").write_text(",".join(header) + "\n" + row + "\n")
    assert archive.read_file(spark, str(tmp_path), "link_kpi_5m.csv").count() == 1
    (folder / "part-1.csv").write_text(",".join(swapped) + "\n" + row + "\n")
    with pytest.raises(ValueError, match="part-1"):
        archive.read_file(spark, str(tmp_path), "link_kpi_5m.csv")


def test_cut_ids_of_dead_letters_are_flagged(spark):
    kind = "arrival long, key string, payload string, reason string, o struct<eventId: string>"
    rows = [(1, "k" * 5000, "x" * 70000, "R", ("e" * 5000,)), (2, "a\x00b", "{}", "R", ("e",)), (3, None, "{}", "R", None)]
    got = {r.arrival: r for r in observations.dead_letters(spark.createDataFrame(rows, kind)).collect()}
    assert got[1].event_id_truncated and got[1].message_key_truncated and got[1].payload_truncated
    assert got[1].payload_size == 70000 and len(got[1].raw_payload) == 65536
    assert got[2].message_key == "a\\u0000b" and not (got[2].event_id_truncated or got[2].message_key_truncated)
    assert got[3].event_id is None and not got[3].event_id_truncated
