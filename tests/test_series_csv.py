"""The fixed export layout: byte-equal lines, order over files, a commit per batch."""

from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from vigilmesh.sources import series_csv

AT = datetime(2026, 9, 10, 9)
SCHEMA = (
    "scopeId string, `from` timestamp, `to` timestamp, value decimal(10,3), coverage double, quality string, nullReason string, sampleCount bigint, "
    "projectionIds array<string>, provenance struct<kind:string,reason:string>, snapshotAt timestamp, histogramCounts array<bigint>, extra string"
)


def sample(spark):
    rows = [
        ("C1", AT, AT + timedelta(hours=1), Decimal("97.500"), 1.0, 'say "ok"', None, 5, ["p", 'q"r'], ("a", None), AT + timedelta(milliseconds=1500), [1, None], "x"),
        ("C1", AT + timedelta(hours=1), AT + timedelta(hours=2), None, 0.0, "", "NO_SOURCE_SLOTS", None, None, None, None, None, "x"),
    ]
    return series_csv.points(spark.createDataFrame(rows, SCHEMA), datasetId="d", domain="VOLTE", metric="m", synthetic=True, requestedFrom=AT, expectedSlots=12)


def test_lines_byte_by_byte(spark, tmp_path):
    assert len(series_csv.COLUMNS) == 39 == len(set(series_csv.COLUMNS))
    series_csv.write(sample(spark), str(tmp_path / "out"))
    data = b"".join(f.read_bytes() for f in sorted((tmp_path / "out").glob("part-*")) if f.stat().st_size)
    header = ",".join(f'"{c}"' for c in series_csv.COLUMNS)
    first = {
        "datasetId": "d", "domain": "VOLTE", "metric": "m", "scopeId": "C1", "requestedFrom": "2026-09-10T09:00:00Z", "from": "2026-09-10T09:00:00Z", "to": "2026-09-10T10:00:00Z",
        "value": "97.500", "coverage": "1.0", "quality": 'say ""ok""', "sampleCount": "5", "synthetic": "true", "expectedSlots": "12", "projectionIds": '[""p"",""q\\""r""]',
        "provenance": '{""kind"":""a"",""reason"":null}', "snapshotAt": "2026-09-10T09:00:01.5Z", "histogramCounts": "[1,null]", "histogramEdges": "null"}
    second = {
        **{k: first[k] for k in ("datasetId", "domain", "metric", "scopeId", "requestedFrom", "synthetic", "expectedSlots")}, "from": "2026-09-10T10:00:00Z", "to": "2026-09-10T11:00:00Z",
        "coverage": "0.0", "quality": "", "nullReason": "NO_SOURCE_SLOTS", **{k: "null" for k in series_csv.NESTED}}
    text = lambda row: ",".join(f'"{row[c]}"' if c in row else "" for c in series_csv.COLUMNS)
    lines = data.decode().split("\r\n")
    assert lines[0] == header and lines[-1] == ""
    assert [line for line in lines[:-1] if line != header] == [text(first), text(second)]


def test_files_follow_series_and_time(spark, tmp_path):
    rows = spark.range(3000).selectExpr(
        "concat('C', IF(id % 3 = 0, 0, id % 7)) AS scopeId", f"timestampadd(MINUTE, CAST(id * 7919 % 3000 AS INT), timestamp'{AT}') AS `from`").repartition(9)
    series_csv.write(series_csv.points(rows, datasetId="d", metric="m"), str(tmp_path / "out"))
    seen = []
    for file in sorted((tmp_path / "out").glob("part-*")):
        lines = file.read_text().split("\r\n")[:-1] if file.stat().st_size else []
        lines = [x for x in file.read_bytes().decode().split("\r\n") if x]
        if lines:
            assert lines[0] == series_csv.HEADER and series_csv.HEADER not in lines[1:]
        seen += [(x.split(",")[4], x.split(",")[12]) for x in lines[1:]]
    assert len(seen) == 3000 and seen == sorted(seen)
    series_csv.write(series_csv.points(rows.limit(0)), str(tmp_path / "empty"))
    assert not any(f.stat().st_size for f in (tmp_path / "empty").glob("part-*"))


def test_a_replayed_batch_replaces_itself(spark, tmp_path):
    series = sample(spark)
    path = str(tmp_path / "out")
    for batch_id, part in ((0, series.where(F.col("nullReason").isNull())), (1, series), (1, series)):
        series_csv.append(part, batch_id, path)
    count = lambda i: sum(len([x for x in f.read_bytes().decode().split("\r\n") if x and x != series_csv.HEADER]) for f in (tmp_path / "out" / f"batch_id={i}").glob("part-*"))
    assert (count(0), count(1)) == (1, 2)


def test_stream_commits_each_batch_once(spark, tmp_path):
    source = sample(spark)
    source.coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
        query = series_csv.stream(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
        query.awaitTermination(120)
        assert query.exception() is None
    folders = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert folders == ["batch_id=0"]
