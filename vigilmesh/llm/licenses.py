"""License scans by ordered signature rules.

Signatures are regular expressions over words. A text is scanned only if it holds a word that some rule waits for,
and then by the rules of the words it holds. Detections that overlap are resolved by rank: one that lies within
another of a better rank, or of its own rank but wider, is dropped. The base phrases always count.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigilmesh.llm.common import PLAIN_WORD, small_letters

#: As PLAIN_WORD, for texts whose letters are not lowered yet: as many words, without lowering the text.
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


class Rule(NamedTuple):
    label: str
    rank: int  # 0 is best
    weight: float  # confidence of a detection
    keyword: str  # a word every match contains
    pattern: str  # over words that single spaces separate
    base: bool = False


#: Phrases whose places are counted. Fixed by the contract.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Label, keyword, names (alternatives) and versions of license families.
FAMILIES = [
    ("apache", "apache", "apache software license|apache license|apache", ["1 0", "1 1", "2 0", "2"]),
    ("gpl", "gpl", "gnu gpl|gpl", ["1", "2", "2 0", "3", "3 0"]),
    ("gpl", "general", "gnu general public license|general public license", ["1", "2", "2 0", "3", "3 0"]),
    ("lgpl", "lgpl", "gnu lgpl|lgpl", ["2", "2 0", "2 1", "3", "3 0"]),
    ("lgpl", "lesser", "gnu lesser general public license|lesser general public license", ["2 1", "3", "3 0"]),
    ("lgpl", "library", "gnu library general public license|library general public license", ["2", "2 0"]),
    ("agpl", "agpl", "gnu agpl|agpl", ["1", "3", "3 0"]),
    ("agpl", "affero", "gnu affero general public license|affero general public license", ["1", "3", "3 0"]),
    ("gfdl", "documentation", "gnu free documentation license|free documentation license", ["1 1", "1 2", "1 3"]),
    ("mpl", "mpl", "mpl", ["1 0", "1 1", "2 0"]),
    ("mpl", "mozilla", "mozilla public license", ["1 0", "1 1", "2 0", "2"]),
    ("epl", "eclipse", "eclipse public license", ["1 0", "2 0"]),
    ("edl", "eclipse", "eclipse distribution license", ["1 0"]),
    ("cddl", "cddl", "cddl", ["1 0", "1 1"]),
    ("cddl", "distribution", "common development and distribution license", ["1 0", "1 1"]),
    ("cpl", "common", "common public license", ["0 5", "1 0"]),
    ("eupl", "eupl", "eupl", ["1 0", "1 1", "1 2"]),
    ("eupl", "union", "european union public licen[cs]e", ["1 0", "1 1", "1 2"]),
    ("artistic", "artistic", "artistic license|perl artistic license", ["1 0", "2 0"]),
    ("afl", "academic", "academic free license", ["1 2", "2 0", "2 1", "3 0"]),
    ("osl", "open", "open software license", ["1 0", "2 0", "2 1", "3 0"]),
    ("ofl", "font", "sil open font license|open font license", ["1 0", "1 1"]),
    ("boost", "boost", "boost software license", ["1 0"]),
    ("zpl", "zope", "zope public license", ["1 1", "2 0", "2 1"]),
    ("php", "php", "php license", ["3 0", "3 01"]),
    ("python", "python", "python software foundation license|python license", ["2", "2 0"]),
    ("python", "psf", "psf license", ["2", "2 0"]),
    ("ms-pl", "microsoft", "microsoft public license", []),
    ("ms-rl", "microsoft", "microsoft reciprocal license", []),
    ("odbl", "database", "open database license", ["1 0"]),
    ("odc-by", "attribution", "open data commons attribution license", ["1 0"]),
    ("unlicense", "unlicense", "the unlicense|unlicense", []),
    ("wtfpl", "wtfpl", "wtfpl", ["1", "2"]),
    ("zlib", "zlib", "zlib license|zlib libpng license", []),
    ("isc", "isc", "isc license", []),
    ("mit", "mit", "mit license|mit x11 license|expat license mit", []),
    ("bsd", "bsd", "bsd license|berkeley software distribution bsd license", []),
    ("bsl", "business", "business source license", ["1 1"]),
    ("sspl", "server", "server side public license", ["1"]),
    ("elastic", "elastic", "elastic license", ["1 0", "2 0"]),
    ("mulan", "mulan", "mulan permissive software license|mulan psl", ["1", "2"]),
]
#: Ways to name a version after a family's name.
VERSIONED = ["{n} version {v}", "{n} v {v}", "{n} v{v}", "{n} {v}", "{n} version {v} or later", "{n} version {v} or any later version", "{n} version {v} only"]
#: Creative Commons: elements and versions.
COMMONS = {"by": "attribution", "by-sa": "attribution share ?alike", "by-nc": "attribution non ?commercial", "by-nd": "attribution no ?deriv(atives|s)",
           "by-nc-sa": "attribution non ?commercial share ?alike", "by-nc-nd": "attribution non ?commercial no ?deriv(atives|s)"}
#: Sentences of license texts and notices: label, rank, weight, keyword, pattern.
TEXTS = [
    ("mit", 1, 0.95, "merchantability", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mit", 1, 0.9, "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", 1, 0.9, "hereby", "permission to use copy modify and (or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", 1, 0.9, "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", 1, 0.9, "endorse", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-2-clause", 1, 0.8, "bsd", "(2|two|simplified) clause bsd( license)?|bsd (2|two) clause( license)?|simplified bsd license"),
    ("bsd-3-clause", 1, 0.8, "bsd", "(3|three) clause bsd( license)?|bsd (3|three) clause( license)?|(new|revised|modified) bsd license"),
    ("bsd-4-clause", 1, 0.8, "bsd", "(4|four) clause bsd( license)?|bsd (4|four) clause( license)?|original bsd license"),
    ("0bsd", 1, 0.8, "bsd", "(0|zero) clause bsd( license)?|bsd zero clause license"),
    ("zlib", 1, 0.9, "altered", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("apache", 1, 0.95, "apache", "licensed under the apache license version 2 0"),
    ("gpl", 1, 0.95, "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", 1, 0.95, "redistribute", "you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license"),
    ("agpl", 1, 0.95, "redistribute", "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("mpl", 1, 0.95, "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", 1, 0.9, "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("cc0", 1, 0.9, "cc0", "cc0( 1 0)?( universal)?"),
    ("cc0", 1, 0.9, "commons", "creative commons zero"),
    ("public-domain", 2, 0.7, "domain", "(is|are|placed|released|dedicated) (in|in to|into|to) the public domain"),
    ("proprietary", 2, 0.6, "reserved", "all rights reserved"),
    ("proprietary", 2, 0.7, "confidential", "(proprietary and confidential|confidential and proprietary)"),
    ("copyright", 3, 0.4, "copyright", "copyright( c)? [12][0-9]{3}"),
    ("copyleft", 3, 0.4, "copyleft", "copyleft"),
    ("unknown", 3, 0.3, "licensed", "(is|are) licensed under( the)?( terms of)?( the)? [^ ]+"),
    ("unknown", 3, 0.3, "license", "(released|distributed|available|published) under (the|an?) ([^ ]+ ){0,3}license"),
    ("unknown", 3, 0.2, "license", "see (the )?license( file)? for details|see the accompanying license"),
]


def rules() -> list[Rule]:
    """All signatures: base phrases, families with their versions, identifiers, Creative Commons and notice sentences."""
    out = [Rule(label, 2, 0.8, phrase.split()[0], phrase, True) for phrase, label in BASE.items()]
    for label, keyword, names, versions in FAMILIES:
        named = f"(the )?({names})"
        out.append(Rule(label, 2, 0.6, keyword, named))
        for version in versions:
            out += [Rule(f"{label}-{version.replace(' ', '.')}", 1, 0.85, keyword, way.format(n=named, v=version)) for way in VERSIONED]
            out.append(Rule(f"{label}-{version.replace(' ', '.')}", 0, 0.99, "spdx", f"spdx license identifier {label.replace('-', ' ')} {version}( only| or later)?"))
    for short, long in COMMONS.items():
        words = short.replace("-", " ")
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            label = f"cc-{short}-{version.replace(' ', '.')}"
            out.append(Rule(label, 1, 0.9, "cc", f"cc {words} {version}"))
            out.append(Rule(label, 1, 0.9, "commons", f"creative commons {long} {version}( international| unported| generic)?"))
        out.append(Rule(f"cc-{short}", 2, 0.6, "commons", f"creative commons {long}"))
    out += [Rule(*text) for text in TEXTS]
    return out


def _table(spark: SparkSession) -> DataFrame:
    """The rules, each with a number: a table of the size of the code that states it."""
    rows = [(i, r.label, r.rank, r.weight, r.keyword, f"(?<= )({r.pattern})(?= )", r.base) for i, r in enumerate(rules())]
    return spark.createDataFrame(rows, "rule int, label string, rank int, weight double, keyword string, pattern string, base boolean")


def _spaces(text):
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def scan(documents: DataFrame, id_column="doc_id", text_column="text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score.

    Words are runs of letters, digits and non-ASCII, A-Z lowered, counted from 0. n_base counts the places of the base
    phrases, first_word and last_word are the smallest and largest of them (null without one). labels holds those of all
    detections that stand, base ones included; both label lists are distinct, sorted and joined by commas. score is the
    weight of the surest detection, 0 without one. Null text is empty. Repeated rows are returned as often
    as they come. Other columns are not read.
    """
    spark = documents.sparkSession
    table = F.broadcast(_table(spark))
    keywords = sorted({r.keyword for r in rules()})
    gate = "(?i)(?<![0-9a-z])(?:" + "|".join(keywords) + ")(?![0-9a-z])"
    rows = documents.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")
    )
    words = F.regexp_extract_all(small_letters(F.col("text")), F.lit(PLAIN_WORD), 0)
    scanned = (
        rows.withColumn("n_words", F.regexp_count("text", F.lit(ANY_CASE_WORD)).cast("long"))
        # A text without any keyword is never cut into words.
        .withColumn("words", F.when(F.col("text").rlike(gate), words))
        .withColumn("keyword", F.explode_outer(F.array_intersect("words", F.array(*map(F.lit, keywords)))))
        .withColumn("line", F.when(F.col("keyword").isNotNull(), F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))))
        .select("row", "doc_id", "n_words", "line", "keyword")
        .join(table, "keyword", "left")
    )
    # Text between the matches of a rule, and the matches: their spaces are the words before each.
    between, matches = F.split("line", F.col("pattern"), -1), F.regexp_extract_all("line", F.col("pattern"), 0)
    hits = (
        scanned.withColumn("matches", F.when(F.regexp_like("line", F.col("pattern")), matches))
        .withColumn(
            "hit",
            F.explode_outer(
                F.when(
                    F.size("matches") > 0,
                    F.zip_with(between, F.col("matches"), lambda b, m: F.struct(_spaces(b).alias("before"), _spaces(m).alias("inside"), m.isNull().alias("tail"))),
                )
            ),
        )
        .where("hit IS NULL OR NOT hit.tail")
        .select("row", "doc_id", "n_words", "rule", "label", "rank", "weight", "base", "hit.before", "hit.inside", F.monotonically_increasing_id().alias("place"))
        .withColumn("label", F.when(F.col("before").isNotNull(), F.col("label")))
    )
    running = Window.partitionBy("row", "rule").orderBy("place")
    total = F.sum(F.col("before") + F.col("inside")).over(running)
    found = hits.withColumn("last", total - 1).withColumn("first", F.col("last") - F.col("inside"))
    # Whatever encloses a detection comes before it here, unless it is of a worse rank.
    order = Window.partitionBy("row").orderBy(F.col("first").asc_nulls_last(), F.desc("last"), "rank", "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = [F.coalesce(F.max(F.when(F.col("rank") == r, F.col("last"))).over(order), F.lit(-1)) for r in range(4)]
    enclosed = F.element_at(F.array(*(F.greatest(*reach[: r + 1]) if r else reach[0] for r in range(4))), F.col("rank") + 1) >= F.col("last")
    stands = F.col("label").isNotNull() & (F.col("base") | ~F.col("enclosed"))
    in_base = F.col("label").isNotNull() & F.col("base")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    return (
        found.withColumn("enclosed", F.coalesce(enclosed, F.lit(False)))
        .groupBy("row", "doc_id", "n_words")
        .agg(
            F.count_if(in_base).alias("n_base"), F.min(F.when(in_base, F.col("first"))).cast("long").alias("first_word"),
            F.max(F.when(in_base, F.col("first"))).cast("long").alias("last_word"), joined(in_base).alias("base_labels"), joined(stands).alias("labels"),
            F.coalesce(F.max(F.when(stands, F.col("weight"))), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )
