"""The registered queries of this subpackage, each a thin use of its operator on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilmesh.llm import bpe, fingerprints, jaccard, licenses, mixing, orchard, passages, quality, resampling, topk, toxicity, urls, vectors
from vigilmesh.llm.common import LOWER, UPPER, table
from vigilmesh.session import prepare

# Batches for Python stay small whatever the rows: texts may be very long.
RUNTIME = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def ready(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return prepare(spark)


def query(name: str, oracle: str | None = None):
    def register(build):
        QUERIES[name] = lambda spark, folder: build(ready(spark), folder)
        if oracle:
            ORACLES[name] = oracle
        return build

    return register


def tokenizer() -> tuple[str, str]:
    """Rank file and pattern of the tokenizer that the contract names."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@query("op10_byte_bpe")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    path, pattern = tokenizer()
    encoded = bpe.encode(table(spark, folder, "documents"), path, pattern)
    return bpe.decode(encoded, path, pattern).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


@query("op2_embedding_near_duplicates")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, folder, "embeddings"))


TOP_K = """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.e, c.e)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
ranked AS (
  SELECT query_id, vec_id, score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query("op8_exact_top_k", TOP_K)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), lambda vec_id: vec_id % 100 == 0)


@query("op9_ngram_jaccard_join")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, folder, "documents"))


@query("op6_substring_dedup")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return passages.repeated_passages(table(spark, folder, "documents"))


@query("op3_mixing")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query("op7_toxicity")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


URL_HOST = r"translate(regexp_extract(coalesce(url, ''), '" + urls.HOST + "', 1), '" + UPPER + "', '" + LOWER + "')"
URL_PATH = r"translate(regexp_extract(coalesce(url, ''), '" + urls.PATH + "', 1), '" + UPPER + "', '" + LOWER + "')"
URL_VERDICTS = rf"""
WITH p AS (SELECT page_id, page_id * 7919 % 1000 AS day, {URL_HOST} AS host, {URL_PATH} AS path,
                  row_number() OVER () AS row FROM pages),
names AS (
  SELECT DISTINCT rule FROM (
    SELECT unnest([host, host || '/' || split_part(path, '/', 2), regexp_extract(host, '([^.]+\.[^.]+)$', 1)]) AS rule FROM p)
  WHERE rule <> '' AND rule NOT LIKE '%/'),
n AS (SELECT rule, CAST('0x' || substr(md5(rule), 1, 8) AS BIGINT) AS n FROM names),
log AS (
  SELECT rule, CASE WHEN n % 4 = 0 THEN 'allow' ELSE 'block' END AS list, unnest([true, false, true, true, false]) AS adds,
         unnest([n % 500, n % 500 + 20 + n % 200, n % 500 + 200 + n % 90, n % 500 + 230 + n % 90, n % 500 + 500]) AS day FROM n),
days AS (SELECT rule, list, day, bool_and(adds) AS listed FROM log GROUP BY ALL),
held AS (
  SELECT rule, list, day AS since, until FROM (
    SELECT *, lead(day) OVER (PARTITION BY rule, list ORDER BY day) AS until FROM (
      SELECT *, coalesce(lag(listed) OVER (PARTITION BY rule, list ORDER BY day), false) AS before FROM days)
    WHERE listed <> before) WHERE listed),
matched AS (
  SELECT p.row, h.rule, h.list FROM p JOIN held h
    ON p.host <> '' AND h.since <= p.day AND (h.until IS NULL OR p.day < h.until)
   AND (p.host = h.rule OR (NOT contains(h.rule, '/') AND ends_with(p.host, '.' || h.rule))
        OR (contains(h.rule, '/') AND (p.host || p.path = h.rule OR starts_with(p.host || p.path, h.rule || '/')))))
SELECT page_id, host, day, count(rule) AS n_active,
       arg_max(rule, (length(rule), CASE WHEN list = 'allow' THEN 1 ELSE 0 END, rule)) AS rule,
       coalesce(arg_max(list, (length(rule), CASE WHEN list = 'allow' THEN 1 ELSE 0 END, rule)), 'none') AS verdict
FROM p LEFT JOIN matched USING (row) GROUP BY row, page_id, host, day
"""


@query("op1_url_filters", URL_VERDICTS)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return urls.verdicts(urls.captures_of(pages), urls.sample_log(pages))


@query("op4_license_scan")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


@query("op5_quality_classifier")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def _codes_sql(rounds: int = 6) -> str:
    """The codebooks round by round: every part against every entry of its codebook."""
    nearest = """
a{r} AS (
  SELECT row, part, any_value(p.v) AS v, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT p.row, p.part, p.v, c.entry, list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(p.v, c.v)]) AS d
    FROM p JOIN c{r} c USING (part)) p
  GROUP BY row, part)"""
    moved = """
m{r} AS (
  SELECT part, entry, list(CAST(floor(CAST(s AS DOUBLE) / n) AS BIGINT) ORDER BY place) AS v FROM (
    SELECT part, entry, place, sum(x) AS s, count(*) AS n FROM (SELECT part, entry, unnest(v) AS x, unnest(range(len(v))) AS place FROM a{r})
    GROUP BY ALL) GROUP BY ALL),
c{next} AS (SELECT part, entry, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m USING (part, entry))"""
    steps = [text.format(r=r, next=r + 1) for r in range(rounds) for text in (nearest, moved)] + [nearest.format(r=rounds)]
    return f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, [CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT row, part, e[part * len(e) // 8 + 1 : (part + 1) * len(e) // 8] AS v FROM v, range(8) AS parts(part)),
c0 AS (SELECT part, row - 1 AS entry, v FROM p WHERE row <= 16),{",".join(steps)},
coded AS (SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY row),
numbers AS (SELECT part, entry, unnest(v) AS x, unnest(range(len(v))) AS place FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, place)) FROM numbers) AS codebooks_sha256
FROM coded JOIN v USING (row)
"""


@query("op11_vector_codes", _codes_sql())
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return orchard.compress(table(spark, folder, "embeddings"))


@query("op12_importance_resampling")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op13_document_fingerprints")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edits(table(spark, folder, "documents"))


@query("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline  # at the repository top; it uses this module

    return corpus_pipeline.run(spark, folder)
