"""URL filters as a temporal list join.

A list is a log of dated entries: on a date a rule is added to or removed from a list. Each rule's log becomes
validity intervals, from an addition to the next entry that ends it. A capture meets the rules that its URL may match
by plain equality, on its host, each parent domain and each path prefix, and of those keeps the intervals that hold
its fetch date. The longest active rule decides; between equals, allowing wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigilmesh.llm.common import small_letters

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def intervals(entries: DataFrame) -> DataFrame:
    """rule, list, since and until (null: open) of a log with rule, list, action ('add' or 'remove') and day.

    Rules are lowered in A-Z. Of entries for one rule, list and day, a removal wins. Entries with a null or an
    empty rule, a null list, day or unknown action are ignored; a removal of what is not listed changes nothing. A
    rule's log is first cut to one row per day, so that its order is one over days, however often it was entered.
    """
    days = (
        entries.select(small_letters(F.col("rule")).alias("rule"), "list", "action", "day")
        .where("rule <> '' AND list IS NOT NULL AND day IS NOT NULL AND action IN ('add', 'remove')")
        .groupBy("rule", "list", "day").agg(F.bool_and(F.col("action") == "add").alias("listed"))
    )
    by_day = Window.partitionBy("rule", "list").orderBy("day")
    changes = days.withColumn("before", F.lag("listed", 1, False).over(by_day)).where("listed <> before")
    return changes.withColumn("until", F.lead("day").over(by_day)).where("listed").select("rule", "list", F.col("day").alias("since"), "until")


def host_of(url):
    return small_letters(F.regexp_extract(url, HOST, 1))


def verdicts(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, host, day, n_active, rule and verdict ('allow', 'block' or 'none') per capture (page_id, url, day).

    A rule without a slash holds for its host and all hosts below it; one with a slash for that very host and the
    paths that begin with its segments. n_active counts the active (rule, list) pairs that match. A null, empty or
    malformed URL and a null day match nothing; their host is empty. Repeated rows are returned as often as they come.
    Other columns are not read.
    """
    held = intervals(entries)
    # Two numbers: no capture is expanded beyond the deepest rule.
    labels, segments = held.agg(
        F.max(F.size(F.split(F.substring_index("rule", "/", 1), r"\."))), F.max(F.size(F.split("rule", "/")) - 1)
    ).first()
    labels, segments = labels or 1, segments or 0
    parts = F.split("host", r"\.")
    count = F.size(parts)
    parents = F.transform(
        F.sequence(F.greatest(F.lit(1), count - labels + 1), count), lambda i: F.array_join(F.slice(parts, i, count), ".")
    )
    pieces = F.filter(F.split("path", "/"), lambda x: x != "")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(pieces), F.lit(segments))), lambda i: F.concat("host", F.lit("/"), F.array_join(F.slice(pieces, 1, i), "/"))
    )
    none = F.array().cast("array<string>")
    keys = F.when(F.col("host") == "", none).otherwise(
        F.concat(parents, F.when(F.size(pieces) * segments > 0, prefixes).otherwise(none)) if segments else parents
    )
    rows = (
        captures.select("page_id", F.coalesce("url", F.lit("")).alias("url"), "day")
        .groupBy("page_id", "url", "day").agg(F.count("*").alias("times"))
        .select("page_id", "url", "day", "times", host_of(F.col("url")).alias("host"), small_letters(F.regexp_extract("url", PATH, 1)).alias("path"))
        .withColumn("key", F.explode_outer(F.array_distinct(keys)))
    )
    active = (F.col("key") == F.col("rule")) & (F.col("since") <= F.col("day")) & (F.col("until").isNull() | (F.col("day") < F.col("until")))
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule"), (F.col("list") == "allow").alias("allows"), "rule")))
    return (
        rows.join(held, active, "left")
        .groupBy("page_id", "url", "day", "times", "host")
        .agg(F.count("rule").alias("n_active"), best.alias("best"))
        .withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
        .select(
            "page_id", "host", "day", "n_active", F.col("best.rule").alias("rule"),
            F.when(F.col("best").isNull(), "none").when(F.col("best.allows"), "allow").otherwise("block").alias("verdict"),
        )
    )


def sample_log(pages: DataFrame) -> DataFrame:
    """A dated log derived from the hosts and first path segments of pages: which of them are entered, and when, follows from their MD5."""
    url = F.coalesce("url", F.lit(""))
    host, path = host_of(url), small_letters(F.regexp_extract(url, PATH, 1))
    segment = F.split_part(path, F.lit("/"), F.lit(2))
    names = (
        pages.select(F.explode(F.array(host, F.concat(host, F.lit("/"), segment), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1))).alias("rule"))
        .where("rule <> '' AND rule NOT LIKE '%/'").distinct()
        .withColumn("n", F.conv(F.substring(F.md5(F.col("rule").cast("binary")), 1, 8), 16, 10).cast("long"))
    )
    start = F.col("n") % 500
    step = lambda action, day: F.struct(F.lit(action).alias("action"), day.cast("long").alias("day"))
    entries = F.array(
        step("add", start), step("remove", start + 20 + F.col("n") % 200), step("add", start + 200 + F.col("n") % 90),
        step("add", start + 230 + F.col("n") % 90), step("remove", start + 500),
    )
    kind = F.when(F.col("n") % 4 == 0, "allow").otherwise("block")
    return names.select("rule", kind.alias("list"), F.inline(entries))


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages with a fetch day derived from their id."""
    return pages.select("page_id", "url", (F.col("page_id") * 7919 % 1000).alias("day"))
