"""Run registered queries next to their DuckDB oracle and compare values.

    python -m tests.oracle [sf] [name ...]
"""
from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path("/root/testdata")
TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/sf{sf}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    if hasattr(v, "item"):
        return norm(v.item())
    if isinstance(v, dict):
        return tuple(norm(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf: str, name: str, plan, sql: str | None) -> tuple[bool, str]:
    df = plan(spark, str(ROOT / f"sf{sf}"))
    got_cols = df.columns
    got = rows_of(got_cols, [tuple(r) for r in df.collect()])
    if sql is None:
        return True, f"{len(got)} rows (no oracle)"
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    if sorted(got_cols) != sorted(rel.columns):
        return False, f"columns {sorted(got_cols)} != {sorted(rel.columns)}"
    kinds = {c: t for c, t in df.dtypes}
    for c, t in zip(rel.columns, rel.types):
        k = kinds[c].split("(")[0].split("<")[0]
        fam = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
        if k in fam and str(t) != fam[k]:
            return False, f"type of {c}: {k} vs {t}"
    if len(got) != len(want):
        only_g = [r for r in got if r not in set(want)][:2]
        only_w = [r for r in want if r not in set(got)][:2]
        return False, f"{len(got)} rows vs {len(want)}; cols {sorted(got_cols)} spark-only {only_g} sql-only {only_w}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return False, f"{len(bad)}/{len(got)} rows differ, cols {sorted(got_cols)}: {bad[0][0]} vs {bad[0][1]}"
    return True, f"{len(got)} rows"


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from contactflow.session import local_session

    sf = argv[0] if argv else "0.01"
    wanted = argv[1:]
    spark = local_session(8)
    con = connect(sf)
    qs, sqls = queries(), oracle_sql()
    names = [n for n in qs if not wanted or any(n.startswith(w) for w in wanted)]
    bad = 0
    for n in names:
        t = time.time()
        try:
            ok, msg = compare(spark, con, sf, n, qs[n], sqls.get(n))
        except Exception as e:  # report and go on
            ok, msg = False, f"{type(e).__name__}: {str(e)[:700]}"
        bad += not ok
        flag = "ok  " if ok else "FAIL"
        empty = "  <-- EMPTY" if msg.startswith("0 rows") else ""
        print(f"{flag} {time.time() - t:6.2f}s {n}: {msg}{empty}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
