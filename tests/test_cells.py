"""Order statistics and ranks where values crowd or scatter."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilmesh.models.scaling import exact_quantiles
from vigilmesh.operators.latest import empirical_rank
from vigilmesh.operators.ranks import CELLS, equi_depth_cells
from vigilmesh.operators.summaries import CITY_SUMS, city_summary

N = 20_000
SHAPES = {
    "outlier": lambda rng: np.append(rng.random(N), 1e9),
    "close": lambda rng: 5 + 1e-7 * rng.random(N),
    "far": lambda rng: np.concatenate([rng.normal(-1e6, 1e3, N), rng.normal(1e12, 1, 50)]),
    "ties": lambda rng: rng.integers(0, 3, N).astype(float),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_quantiles_and_ranks(spark, shape):
    values = SHAPES[shape](np.random.default_rng(1))
    frame = spark.createDataFrame([("k", float(v)) for v in values], "key string, value double")
    for q in (0.25, 0.5, 0.9):
        assert exact_quantiles(frame, ["key"], q).first()["quantile"] == pytest.approx(np.quantile(values, q), rel=1e-12)
    distinct = frame.distinct()
    cells = equi_depth_cells(distinct, ["key"], "value").groupBy("cell").count()
    assert cells.agg(F.max("count")).first()[0] <= max(2, 4 * distinct.count() / CELLS)
    probes = np.concatenate([values[:50], [values.min() - 1, values.max() + 1]])
    scored = spark.createDataFrame([(float(p),) for p in probes], "value double")
    got = {r.value: r["rank"] for r in empirical_rank(scored, frame.select("value"), "value").collect()}
    for p in probes:
        assert got[float(p)] == pytest.approx((values <= p).mean())


def test_slots_beyond_one_bitmap(spark):
    rows = spark.range(80_000).selectExpr(
        "id DIV 2 AS slot", "concat('C', id % 2) AS city_id", "timestamp_seconds((id DIV 2) * 300) AS ts",
        *[f"1 AS {c}" for c in CITY_SUMS], "array_repeat(1, 9) AS voice_setup_hist", "array_repeat(1, 9) AS sms_delay_hist",
        "id AS sms_queue", "1.0 AS sms_oldest_seconds",
    )
    row = city_summary(rows, F.lit("all"), 80_000).first()
    assert row.slot_count == 40_000 and row.row_count == 80_000 and row.erlang == pytest.approx(80_000 / (40_000 * 300))
    assert row.queue == 79_998 + 79_999
