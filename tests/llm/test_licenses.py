import re
from re import _parser

from vigilmesh.llm import licenses
from vigilmesh.llm.queries import QUERIES

RULES = licenses.rules()


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    line, found = " " + " ".join(words) + " ", []
    for number, rule in enumerate(RULES):
        if rule.keyword in words:
            for m in re.finditer(f"(?<= )({rule.pattern})(?= )", line):
                found.append((line[: m.start()].count(" ") - 1, line[: m.end()].count(" ") - 1, rule, number))
    base = [(f, r.label) for f, _, r, _ in found if r.base]
    stands = []
    for f, l, r, n in found:
        inside = any(
            g <= f and l <= m and (q.rank < r.rank or q.rank == r.rank and ((g, m) != (f, l) or k < n)) and k != n
            or (g, m, k) != (f, l, n) and k == n and g <= f and l <= m
            for g, m, q, k in found
        )
        if r.base or not inside:
            stands.append(r)
    starts = [f for f, _ in base]
    return (
        len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({b for _, b in base})),
        ",".join(sorted({r.label for r in stands})), max((r.weight for r in stands), default=0.0),
    )


def fields(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score


TEXTS = [
    None, "", " ", "plain words only", "MIT License", "the mit-license, and (MIT) license again", "mit licensex smit license", "mit  \n license",
    "GNU General Public License, version 3.", "gnu lesser general public license version 2.1 or later", "general public license general public license",
    "Licensed under the Apache License, Version 2.0 (the License)", "apache license apache license 2.0 mit license", "É mit license É",
    "SPDX-License-Identifier: Apache-2.0", "Copyright (c) 2020 all rights reserved", "Creative Commons Attribution-ShareAlike 4.0 International",
    "permission is hereby granted, free of charge, to any person obtaining a copy of this software", "distributed under the foo bar license",
    "x " * 20000 + "mit license " * 300 + "gpl v3", "Kelvin mit license İ", "This work is licensed under the GNU General Public License, version 3.",
]


def test_brute_force(spark):
    rows = [(i, t, "x", 0.5, "y", 1) for i, t in enumerate(TEXTS)] + [(None, "mit license", "x", 0.5, "y", 1), (4, TEXTS[4], "x", 0.5, "y", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, labels string, score double, row string, rank int")
    out = licenses.scan(frame).collect()
    assert len(out) == len(rows)
    for r in out:
        assert fields(r) == brute(TEXTS[r.doc_id] if r.doc_id is not None else "mit license"), r
    assert licenses.scan(frame.limit(0)).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    out = QUERIES["op4_license_scan"](spark, folder).collect()
    assert len(out) == len(texts)
    assert [r.doc_id for r in out if fields(r) != brute(texts[r.doc_id])] == []
    assert sum(r.n_base for r in out) > 5


def test_rules_are_many_and_sound():
    assert 200 <= len(RULES) and {r.rank for r in RULES} == {0, 1, 2, 3}
    for rule in RULES:
        re.compile(rule.pattern)


def shortest(parsed):
    """The shortest match of each way through a parsed pattern."""
    ways = [""]
    for kind, value in parsed:
        kind = str(kind)
        if kind == "LITERAL":
            more = [chr(value)]
        elif kind == "BRANCH":
            more = [x for branch in value[1] for x in shortest(branch)]
        elif kind == "SUBPATTERN":
            more = shortest(value[-1])
        elif kind == "MAX_REPEAT":
            more = [x * value[0] for x in shortest(value[2])]
        else:
            more = ["2"]
        ways = [a + b for a in ways for b in more]
    return ways


def test_keyword_is_in_every_match():
    for rule in licenses.rules():
        assert "-" not in rule.pattern.replace("[0-9]", ""), rule
        assert all(rule.keyword in way.split() for way in shortest(_parser.parse(rule.pattern))), rule


def test_phrases_without_the_family_word(spark):
    rows = [(1, "Creative Commons Zero"), (2, "under the PSF license"), (3, "SPDX-License-Identifier: ODC-By-1.0")]
    found = {r.doc_id: set(r.labels.split(",")) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "cc0" in found[1] and "python" in found[2] and "odc-by-1.0" in found[3]
