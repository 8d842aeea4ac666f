"""Run registered queries in Spark beside their SQL in DuckDB and compare columns, types, counts and values."""

from __future__ import annotations

import sys
import time

from .inputs import TABLES
from .registry import oracle_sql, queries

_KINDS = {"bigint": "int64", "int": "int32", "string": "text", "double": "double", "boolean": "bool",
          "BIGINT": "int64", "INTEGER": "int32", "VARCHAR": "text", "DOUBLE": "double", "BOOLEAN": "bool"}


def _norm(value):
    return round(value, 6) if isinstance(value, float) else value


def compare(spark, duck, name: str, fn, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    started = time.time()
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for r in df.collect()]
    took = time.time() - started
    if sql is None:
        return True, f"rows={len(rows)} spark={took:.1f}s (no SQL)"
    duck.execute(f"select * from ({sql}) q limit 0")
    got = {d[0]: str(d[1]) for d in duck.description}
    started = time.time()
    duck.execute(sql)
    names = [d[0] for d in duck.description]
    raw = duck.fetchall()
    slow = time.time() - started
    if sorted(names) != cols:
        return False, f"columns {cols} against {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = [tuple(_norm(r[i]) for i in at) for r in raw]
    kinds = {f.name: _KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    theirs = {n: _KINDS.get(got[n], got[n]) for n in names}
    if kinds != theirs:
        return False, f"types {({c: (kinds[c], theirs[c]) for c in cols if kinds[c] != theirs[c]})}"
    key = lambda r: tuple((x is None, str(x)) for x in r)
    rows.sort(key=key)
    want.sort(key=key)
    if rows != want:
        extra = next(((a, b) for a, b in zip(rows, want) if a != b), None)
        return False, f"rows {len(rows)} against {len(want)}; first difference {extra} in {cols}"
    return True, f"rows={len(rows)} spark={took:.1f}s sql={slow:.1f}s"


def connect(sf_dir: str):
    import duckdb
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return duck


def main(sf_dir: str, *only: str) -> int:
    from tallyline.session import build_session
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                  "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    duck, checks, bad = connect(sf_dir), oracle_sql(), 0
    for name, fn in queries().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        try:
            ok, note = compare(spark, duck, name, fn, checks.get(name), sf_dir)
        except Exception as e:  # report and go on with the next query
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
