import pytest

from tests.oracle_check import compare, connect, table_of
from vigilmesh.llm import urls
from vigilmesh.llm.queries import ORACLES, QUERIES

LOG = [
    ("example.com", "block", "add", 10), ("example.com", "block", "remove", 20), ("EXAMPLE.com", "block", "add", 30),
    ("good.example.com", "allow", "add", 12), ("good.example.com/Bad", "block", "add", 15), ("good.example.com/bad/worse", "allow", "add", 15),
    ("other.net", "block", "remove", 5), ("other.net", "block", "add", 5), ("both.org", "block", "add", 1), ("both.org", "allow", "add", 1),
    (None, "block", "add", 1), ("", "block", "add", 1), ("x.org", None, "add", 1), ("y.org", "block", "drop", 1), ("z.org", "block", "add", None),
]
CAPTURES = [
    (1, "http://example.com/", 9, 0, "none"), (2, "http://example.com/", 10, 1, "block"), (3, "http://example.com", 20, 0, "none"),
    (4, "https://A.b.Example.COM:8080/x?y#z", 31, 1, "block"), (5, "http://good.example.com/bad/x", 15, 3, "block"),
    (6, "http://good.example.com/badx", 15, 2, "allow"), (7, "http://user@good.example.com/bad/worse/1", 40, 4, "allow"),
    (8, "http://other.net/", 7, 0, "none"), (9, "http://both.org", 2, 2, "allow"), (10, None, 12, 0, "none"), (11, "", 12, 0, "none"),
    (12, "not a url", 12, 0, "none"), (13, "http://example.com", None, 0, "none"), (14, "http://notexample.com/", 12, 0, "none"),
    (15, "http://good.example.com/" + "a/" * 3000, 13, 2, "allow"), (None, "http://example.com/", 12, 1, "block"), (2, "http://example.com/", 10, 1, "block"),
]


def test_hand_cases(spark):
    log = spark.createDataFrame([(*r, 1) for r in LOG], "rule string, list string, action string, day long, page_id int")
    frame = spark.createDataFrame([(i, u, d, "x", 2) for i, u, d, _, _ in CAPTURES], "page_id long, url string, day long, rule string, host int")
    got = sorted((r.page_id or 0, r.n_active, r.verdict) for r in urls.verdicts(frame, log).collect())
    assert got == sorted((i or 0, n, v) for i, _, _, n, v in CAPTURES)
    assert urls.verdicts(frame.limit(0), log).count() == 0
    assert urls.verdicts(frame, log.limit(0)).where("verdict = 'none'").count() == len(CAPTURES)


@pytest.mark.parametrize("scale", ["0.001", "0.01"])
def test_oracle(spark, scale):
    folder = f"/root/testdata/sf{scale}"
    got = QUERIES["op1_url_filters"](spark, folder).toArrow()
    assert not compare("op1", got, table_of(connect(folder), ORACLES["op1_url_filters"]))
    assert len(set(got.column("verdict").to_pylist())) == 3
