import numpy as np
import pyarrow as pa

from vigilmesh.llm import quality
from vigilmesh.llm.common import held_out
from vigilmesh.llm.queries import QUERIES


def test_prior_of_known_mixture():
    rng = np.random.default_rng(0)
    positive = rng.normal(2, 1, 4000)
    for share in (0.3, 0.85):
        mixed = np.where(rng.random(6000) < share, rng.normal(2, 1, 6000), rng.normal(-2, 1, 6000))
        assert abs(quality.estimate_prior(positive, mixed) - share) < 0.06


def test_features_are_finite_and_by_row():
    texts = [None, "", " ", "a", "ONE two. three\nfour", "é " * 5000, "x" * 30000]
    rows = quality.feature_rows(pa.array(texts))
    assert rows.shape == (len(texts), len(quality.FEATURES)) and np.isfinite(rows).all()
    for text, row in zip(texts, rows):
        assert (quality.feature_rows(pa.array([text], pa.string()))[0] == row).all()
    together = quality.feature_rows(pa.array(["x y A", "bcd e", "BC"]))
    assert [r[quality.FEATURES.index("upper_words")] for r in together] == [0, 0, 1]


def test_risk_has_the_gradient_of_finite_differences():
    rng = np.random.default_rng(4)
    p, u = rng.normal(0, 1, (40, 5)), rng.normal(0, 1, (60, 5))
    layers = [rng.normal(0, 1, (5, 7)), rng.normal(0, 1, 7), rng.normal(0, 1, 7), rng.normal(0, 1, 1)]
    kinds = set()
    for prior in (None, 0.3, 0.98):
        for offset in (0.0, 6.0, -6.0):
            layers[3][0] = offset
            value, gradients = quality.risk(layers, p, u, prior)
            if prior:
                m = lambda x: np.tanh(x @ layers[0] + layers[1]) @ layers[2] + layers[3]
                negative = np.log1p(np.exp(m(u))).mean() - prior * np.log1p(np.exp(m(p))).mean()
                kinds.add(negative >= 0)
                assert np.isclose(value, prior * np.log1p(np.exp(-m(p))).mean() + negative if negative >= 0 else -negative)
            for layer, gradient in zip(layers, gradients):
                for at in list(np.ndindex(layer.shape))[:12]:
                    kept, ends = layer[at], []
                    for step in (1e-6, -1e-6):
                        layer[at] = kept + step
                        ends.append(quality.risk(layers, p, u, prior)[0])
                    layer[at] = kept
                    assert abs((ends[0] - ends[1]) / 2e-6 - gradient[at]) < 1e-6
    assert kinds == {True, False}


def test_prior_equals_a_plain_version():
    rng = np.random.default_rng(2)
    p, u = rng.normal(1, 1, 300), rng.normal(0, 1.5, 500)
    error = np.sqrt(np.log(20) / 600) + np.sqrt(np.log(20) / 1000)
    best = None
    for cut in np.quantile(p, np.linspace(0.01, 0.9, 60)):
        a, b = sum(x >= cut for x in p) / 300, sum(x >= cut for x in u) / 500
        if best is None or (b + error) / a < best[0]:
            best = ((b + error) / a, b / a)
    assert quality.estimate_prior(p, u) == min(max(best[1], 0.02), 0.98)


def corpus(spark, n=900):
    rng = np.random.default_rng(3)
    docs, labels = [], []
    for i in range(n):
        words = [f"word{w}" for w in rng.integers(0, 300, 60)]
        good = i % 4 != 0
        docs.append((i, " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words), "x", 0.1))
        if i % 3 == 0:
            labels.append((i, int(good), 0))
    return spark.createDataFrame(docs, "doc_id long, text string, source string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learns_without_negatives_and_held_out_labels(spark):
    docs, labels = corpus(spark)
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 900 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert sum(r.predicted == (r.doc_id % 4 != 0) for r in rows) >= 890
    turned = labels.withColumn("quality", 1 - labels.quality).where(held_out(labels.doc_id)).unionAll(labels.where(~held_out(labels.doc_id)))
    again = {r.doc_id: r.score for r in quality.classify(docs.repartition(5), turned).collect()}
    assert again == {r.doc_id: r.score for r in rows}


def test_equal_texts_in_both_samples_under_any_partitioning(spark):
    docs, labels = corpus(spark, 400)
    copies = docs.where("doc_id % 4 = 1").selectExpr("doc_id + 10000 AS doc_id", "text", "source", "score")
    docs = docs.unionAll(copies)
    runs = [{r.doc_id: r.score for r in quality.classify(d, labels).collect()} for d in (docs.coalesce(1), docs.repartition(3, "text"), docs.repartition(11))]
    assert len(runs[0]) == 500 and runs[0] == runs[1] == runs[2]
    assert all(runs[0][i] == runs[0][i - 10000] for i in runs[0] if i >= 10000)


def test_labels_on_every_document_still_teach(spark):
    docs, _ = corpus(spark, 600)
    every = docs.selectExpr("doc_id", "CAST(doc_id % 4 <> 0 AS int) AS quality")
    rows = quality.classify(docs, every).collect()
    assert sum(r.predicted == (r.doc_id % 4 != 0) for r in rows) >= 590


def test_edges(spark):
    docs, labels = corpus(spark, 300)
    odd = spark.createDataFrame([(1000, None, "x", 1.0), (1001, "", None, 1.0), (None, "a b", "x", 1.0), (1003, "w " * 50000, "x", 1.0), (1003, "w " * 50000, "x", 1.0)], docs.schema)
    out = quality.classify(docs.unionAll(odd), labels).where("doc_id IS NULL OR doc_id >= 1000").collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op5_quality_classifier"](spark, folder).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in rows) >= 0.97 * len(rows)
