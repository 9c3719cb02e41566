"""Compare registered queries with their DuckDB texts: python tests/oracle.py SF [name-part ...]"""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb

sys.path.insert(0, "/root/repo")

from skytable.fixtures import TABLES

ROOT = "/root/testdata"


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(value) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(plain(row[i]) for i in order) for row in data), key=repr
    )


def compare(spark, con, sf_dir, name, build, sql):
    """None when equal, else a short text about the first difference."""
    df = build(spark, sf_dir)
    got_columns, got = rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    want_columns, want = rows([d[0] for d in result.description], result.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; first {got[:1]} / {want[:1]}"
    for a, b in zip(got, want):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{sum(x != y for x, y in zip(got, want))} of {len(got)} differ: {a} != {b}"
    return None


def main(sf: str, parts: list[str]) -> int:
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from skytable.session import local_session

    spark = local_session("oracle", 8)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"{ROOT}/sf{sf}"
    con = duck(sf_dir)
    bad = 0
    oracles = entry.oracle_sql()
    for name, build in entry.queries().items():
        if parts and not any(name == p or name.startswith(p + "_") or p in name.split(":") for p in parts):
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, sf_dir, name, build, oracles[name])
                note = "ok" if problem is None else f"BAD {problem[:700]}"
            else:
                note = f"rows {build(spark, sf_dir).count()}"
        except Exception as error:  # report and go on with the next query
            note = f"BAD {type(error).__name__}: {str(error)[:900]}"
        bad += note.startswith("BAD")
        print(f"{name:32s} {time.time() - start:6.1f}s {note}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
