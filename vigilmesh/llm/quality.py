"""A quality classifier by positive-unlabelled learning.

Trusted positives are labelled rows of good quality; the unlabelled side is any other text, whose label, if it has one, is not read. Features are shares
and rates of a text's form: letters, marks, repetition, words and lines. The share of positives among the
unlabelled is estimated from a first classifier that only tells the two samples apart: where positives
score high, unlabelled texts do so as often as they are positive. A small network then minimises the
non-negative unbiased risk: prior * (loss of positives as positive) + max(0, loss of unlabelled as negative - prior * loss of
positives as negative).
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilmesh.llm.common import held_out, slices, text_bytes
from vigilmesh.llm.shingles import SLICE, SPACES, shingle_sets, words

#: Bounds of the rows that a fit reads: positives, and unlabelled ones.
POSITIVES, UNLABELLED = 10_000, 20_000
HIDDEN, STEPS, BATCH, RATE, DECAY = 24, 4000, 512, 0.004, 1e-4
#: Marks that have a share of their own among the features.
MARKS = b"!?.,;:|#*$%&@/\\<>[]{}()=+-_~\"'"

FEATURES = (
    ["log_bytes", "log_words", "bytes_a_word", "spread_of_words", "upper", "digit", "mark", "space", "line_break", "non_ascii"]
    + [f"mark_{m}" for m in range(len(MARKS))]
    + ["distinct_words", "repeats_before", "distinct_shingles", "commonest_word", "short_words", "words_a_line", "words_a_stop", "marked_words", "upper_words"]
)


def _shares(of: np.ndarray, doc: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(doc, weights=of, minlength=rows)


def features(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x FEATURES of a slice of texts. A text without words has zeros but for what its bytes say."""
    rows = len(offsets) - 1
    lengths = np.diff(offsets)
    doc = np.repeat(np.arange(rows), lengths)
    size = np.maximum(lengths, 1)
    upper, digit = (flat >= 65) & (flat <= 90), (flat >= 48) & (flat <= 57)
    letter = upper | ((flat >= 97) & (flat <= 122)) | (flat >= 128)
    space = SPACES[flat]
    w = words(flat, offsets)
    count = np.bincount(w.doc, minlength=rows)
    some = np.maximum(count, 1)
    length = (w.end - w.start).astype(float)
    mean = _shares(length, w.doc, rows) / some
    spread = np.sqrt(np.maximum(_shares(length**2, w.doc, rows) / some - mean**2, 0))
    out = [np.log1p(lengths), np.log1p(count), mean, spread]
    out += [_shares(x, doc, rows) / size for x in (upper, digit, ~(letter | digit | space), space, flat == 10, flat >= 128)]
    out += [_shares(flat == m, doc, rows) / size for m in MARKS]
    order = np.lexsort((w.hash, w.doc))
    d, h = w.doc[order], w.hash[order]
    starts = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])])) if len(d) else np.zeros(0, np.int64)
    times = np.diff(np.append(starts, len(d)))
    most = np.zeros(rows)
    np.maximum.at(most, d[starts], times)
    again = np.zeros(len(w.doc))
    again[1:] = (w.doc[1:] == w.doc[:-1]) & (w.hash[1:] == w.hash[:-1])
    sets = shingle_sets(flat, offsets)
    last, first = (flat[w.end - 1], flat[w.start]) if len(w.doc) else (np.zeros(0, np.uint8),) * 2
    plain = lambda b: ((b >= 48) & (b <= 57)) | ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122)) | (b >= 128)
    stops = _shares((last == 46) | (last == 33) | (last == 63), w.doc, rows)
    lines = _shares(flat == 10, doc, rows) + 1
    second = np.where(length > 1, flat[np.minimum(w.start + 1, len(flat) - 1)], 0) if len(w.doc) else first
    out += [
        np.bincount(d[starts], minlength=rows) / some, _shares(again, w.doc, rows) / some,
        np.bincount(sets.doc, minlength=rows) / np.maximum(count - 4, 1), most / some, _shares(length <= 3, w.doc, rows) / some,
        np.log1p(count / lines), np.log1p(count / (stops + 1)), _shares(~plain(last), w.doc, rows) / some,
        _shares((first >= 65) & (first <= 90) & (second >= 65) & (second <= 90), w.doc, rows) / some,
    ]
    return np.stack(out, 1)


def feature_rows(column: pa.Array) -> np.ndarray:
    flat, offsets = text_bytes(column)
    parts = [np.zeros((0, len(FEATURES)))]
    for start, end in slices(np.diff(offsets), SLICE):
        part = offsets[start : end + 1]
        with np.errstate(over="ignore"):
            parts.append(features(flat[part[0] : part[-1]], part - part[0]))
    return np.concatenate(parts)


class Model(NamedTuple):
    center: np.ndarray
    scale: np.ndarray
    layers: tuple  # weights and offsets of the two layers
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Of each row by itself: a matrix product would round its sums by the size of the batch."""
        a, b, c, d = self.layers
        z = np.clip((x - self.center) / self.scale, -8, 8)
        hidden = np.tile(b, (len(z), 1))
        for j in range(z.shape[1]):
            hidden += z[:, j, None] * a[j]
        hidden = np.tanh(hidden)
        margin = np.full(len(z), d[0])
        for j in range(hidden.shape[1]):
            margin += hidden[:, j] * c[j]
        return margin

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def risk(layers: list[np.ndarray], positive: np.ndarray, unlabelled: np.ndarray, prior: float | None) -> tuple[float, list[np.ndarray]]:
    """(what a step lowers, its gradients) for margins under the logistic loss.

    With a prior: the unbiased risk, prior * loss of positives as positive + (loss of unlabelled as negative - prior * loss of positives
    as negative); where the bracket, the risk of negatives, is below 0, which no risk can be, the step raises it instead.
    Without a prior: positives against unlabelled.
    """
    x = np.concatenate([positive, unlabelled])
    hidden = np.tanh(x @ layers[0] + layers[1])
    margin = hidden @ layers[2] + layers[3]
    of_p, of_u = margin[: len(positive)], margin[len(positive) :]
    # Losses log(1 + exp(-m)) as positive and log(1 + exp(m)) as negative, and their slopes.
    loss_p, slope_p = np.logaddexp(0, -of_p).mean(), -_sigmoid(-of_p) / len(of_p)
    turned, slope_turned = np.logaddexp(0, of_p).mean(), _sigmoid(of_p) / len(of_p)
    loss_u, slope_u = np.logaddexp(0, of_u).mean(), _sigmoid(of_u) / len(of_u)
    if prior is None:
        value, slope = loss_p + loss_u, np.concatenate([slope_p, slope_u])
    elif loss_u >= prior * turned:
        value, slope = prior * loss_p + loss_u - prior * turned, np.concatenate([prior * (slope_p - slope_turned), slope_u])
    else:
        value, slope = prior * turned - loss_u, np.concatenate([prior * slope_turned, -slope_u])
    back = np.outer(slope, layers[2]) * (1 - hidden**2)
    return float(value), [x.T @ back, back.sum(0), hidden.T @ slope, np.array([slope.sum()])]


def _train(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, seed: int) -> tuple:
    """Weights that lower the risk, by Adam."""
    rng = np.random.default_rng(seed)
    width = positive.shape[1]
    layers = [rng.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(x) for x in layers], [np.zeros_like(x) for x in layers]
    for step in range(1, STEPS + 1):
        p = positive[rng.integers(0, len(positive), BATCH)]
        u = unlabelled[rng.integers(0, len(unlabelled), BATCH)]
        _, gradients = risk(layers, p, u, prior)
        gradients[0] += DECAY * layers[0]
        gradients[2] += DECAY * layers[2]
        rate = RATE * (0.5 * (1 + np.cos(np.pi * step / STEPS)))
        for i, g in enumerate(gradients):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            layers[i] = layers[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return tuple(layers)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled: the least ratio of both samples' shares above a score, where enough positives are.

    Ratios carry a margin of error that shrinks with both samples, so that small tails do not decide.
    """
    cuts = np.quantile(positive, np.linspace(0.01, 0.9, 60))
    share_p = (positive[None] >= cuts[:, None]).mean(1)
    share_u = (unlabelled[None] >= cuts[:, None]).mean(1)
    error = np.sqrt(np.log(20) / (2 * len(positive))) + np.sqrt(np.log(20) / (2 * len(unlabelled)))
    best = np.argmin((share_u + error) / share_p)
    return float(np.clip(share_u[best] / share_p[best], 0.02, 0.98))


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", seed: int = 5) -> Model | None:
    """The model of bounded samples, those with the smallest hash; None without positives or without any other row.

    Only labels of 1 on rows that are not held out are read, as positives. All other rows are unlabelled, so that labels on every
    document still teach. The samples are put in one order, whatever order the rows came in.
    """
    trusted = (
        labels.where(F.col(label) == 1).select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
        .distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(POSITIVES).withColumn("positive", F.lit(1))
    )
    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    free = (
        ids.join(F.broadcast(trusted.select("doc_id")), "doc_id", "left_anti")  # at most POSITIVES ids
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(UNLABELLED).withColumn("positive", F.lit(0))
    )

    def sampled(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("positive"), pa.array(list(feature_rows(batch.column("text"))), pa.list_(pa.float64()))], names=["positive", "x"]
            )

    # At most POSITIVES + UNLABELLED rows of two numbers.
    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(trusted.unionAll(free)), "doc_id")
    rows = chosen.mapInArrow(sampled, "positive int, x array<double>").toPandas()
    if not 0 < rows["positive"].sum() < len(rows):
        return None
    x = np.stack(rows["x"].to_numpy())
    # Equal texts may be in both samples: the label decides among them.
    order = np.lexsort((rows["positive"].to_numpy(), *x.T))
    x, positive = x[order], rows["positive"].to_numpy()[order] == 1
    center, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - center) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    part = rng.random(len(z)) < 0.5
    if min(part[positive].sum(), (~part)[positive].sum(), part[~positive].sum(), (~part)[~positive].sum()) == 0:
        part = np.ones(len(z), bool)
    a, b, c, d = _train(z[positive & part], z[~positive & part], None, seed)
    rest = ~part if not part.all() else part
    told = np.tanh(z[rest] @ a + b) @ c + d
    prior = estimate_prior(told[positive[rest]], told[~positive[rest]])
    return Model(center, scale, _train(z[positive], z[~positive], prior, seed + 1), prior)


def classify(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: good quality likelier) and predicted per document.

    Null text is scored as empty text. Without a positive, or without any other row, every score is 0.5. Rows
    that are repeated are scored each; other columns are not read.
    """
    model = fit(documents, labels)

    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(feature_rows(texts)) if model else np.full(len(texts), 0.5))

    return documents.select("doc_id", F.arrow_udf(scored, "double")("text").alias("score")).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
