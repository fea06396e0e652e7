"""A cleaning and mixing run over documents: five stages, each of one operator, on all that the stage before it kept.

A stage takes (spark, docs, folder) and returns a table, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilmesh.llm import bpe, jaccard, mixing, passages, toxicity
from vigilmesh.llm.common import stored, table
from vigilmesh.llm.queries import ready, tokenizer
from vigilmesh.session import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC = 0.7


def key():
    """Tells rows apart, also those that share an id or have none; equal rows have equal keys."""
    return F.xxhash64("doc_id", "text", "source")


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that score below TOXIC; labels of the table teach the score.

    Every row is scored by its own text: null, empty and repeated ones like others, with or without an id. Without labels of both kinds all
    score the rate of the label and stay, and an empty table stays empty.
    """
    model = toxicity.fit(docs, table(ready(spark), folder, "labels"))
    return toxicity.score(docs, model).where(F.col("score") < TOXIC).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id.

    Rows are grouped by their texts, so an id with two texts is two documents; a row without an id stays only if
    its group has none with one. Equal rows are one document. Texts without words are like no other.
    """
    ready(spark)
    keyed = docs.withColumn("key", key())
    group = jaccard.jaccard_components(keyed, id_column="key").select(F.col("doc_id").alias("key"), F.col("component_id").alias("group")).distinct()
    of_group = group.join(keyed.select("key", "doc_id").distinct(), "key").groupBy("group")
    stays = of_group.agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))["key"].alias("key"))
    return keyed.join(stays, "key", "left_semi").dropDuplicates(["doc_id", "key"]).select(*COLUMNS)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The documents without passages that an earlier document holds; a document of which nothing is left goes."""
    ready(spark)
    left = passages.without(docs, passages.repeated_passages(docs))
    blank = F.col("text").isNotNull() & (F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) == 0)
    emptied = blank & (F.coalesce(F.col("n_chars"), F.lit(0)) > F.length("text"))
    return left.where(~emptied).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Each document as often as the mix takes it. Rows that share an id, or have none, are taken each by itself; equal rows together."""
    ready(spark)
    keyed = docs.withColumn("key", key())
    takes = mixing.mix(keyed, id_column="key").groupBy(F.col("doc_id").alias("key")).agg(F.sum("copies").alias("copies")).where("copies > 0")
    return (
        keyed.dropDuplicates(["doc_id", "key"]).join(takes, "key")
        .withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select(*COLUMNS)
    )


def tokenize(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, ids, n_tokens and whether decoding gives the text back, for every row."""
    ready(spark)
    path, pattern = tokenizer()
    # Stored, so that a task runs one Python worker and not one for each direction.
    encoded = stored(bpe.encode(docs, path, pattern))
    return bpe.decode(encoded, path, pattern).select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("mixing", mix_sources),
    ("byte_bpe", tokenize),
]

# A trained score, components and a balanced draw are not SQL: tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
