"""Run registered queries against their DuckDB oracles and compare names, types and values.

    python -m tests.oracle_check [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

import __spark_entry__ as contract
from vigilmesh.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def kind(arrow_type) -> str:
    text = str(arrow_type)
    if text.startswith(("int", "uint")):
        return "int"
    if text.startswith(("double", "float")):
        return "float"
    if "string" in text:
        return "string"
    return text


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def table_of(connection, text: str):
    return connection.execute(text).to_arrow_table()


def connect(folder: str):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def compare(name: str, spark_table, oracle_table) -> list[str]:
    problems = []
    left, right = sorted(spark_table.column_names), sorted(oracle_table.column_names)
    if left != right:
        return [f"columns {left} != {right}"]
    for column in left:
        a, b = kind(spark_table.schema.field(column).type), kind(oracle_table.schema.field(column).type)
        if a != b and "null" not in (a, b):
            problems.append(f"{column}: type {a} != {b}")
    rows = [sorted(zip(*[map(normal, t.column(c).to_pylist()) for c in left])) for t in (spark_table, oracle_table)]
    if len(rows[0]) != len(rows[1]):
        problems.append(f"rows {len(rows[0])} != {len(rows[1])}")
    different = [(a, b) for a, b in zip(*rows) if a != b]
    if different:
        problems.append(f"{len(different)} rows differ; columns {left}; first {different[0]}")
    return problems


def main(argv: list[str]) -> int:
    sf = "0.01"
    if "--sf" in argv:
        at = argv.index("--sf")
        sf = argv[at + 1]
        argv = argv[:at] + argv[at + 2 :]
    folder = f"/root/testdata/sf{sf}"
    spark = local_session()
    connection = connect(folder)
    oracles = contract.oracle_sql()
    bad = 0
    for name, build in contract.queries().items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        begun = time.time()
        try:
            got = build(spark, folder).toArrow()
            took = time.time() - begun
            problems = compare(name, got, table_of(connection, oracles[name])) if name in oracles else []
            note = "" if name in oracles else " (no oracle)"
        except Exception as error:  # report and go on with the next query
            problems, note, took, got = [f"{type(error).__name__}: {str(error)[:900]}"], "", time.time() - begun, None
        bad += bool(problems)
        rows = got.num_rows if got is not None else -1
        print(f"{'FAIL' if problems else 'ok  '} {name} rows={rows} {took:.2f}s{note}", flush=True)
        for problem in problems:
            print("     ", problem[:1500], flush=True)
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
