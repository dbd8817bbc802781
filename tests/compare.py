"""Run registered queries next to their SQL twins and report differences.

    python tests/compare.py <folder> [name prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SPARK_TYPES = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def database(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def compare(spark, con, name: str, fn, sql: str | None, folder: str) -> tuple[bool, str]:
    t0 = time.time()
    df = fn(spark, folder)
    cols = sorted(df.columns)
    rows = [tuple(cell(r[c]) for c in cols) for r in df.select(*cols).collect()]
    took = time.time() - t0
    if sql is None:
        return True, f"{len(rows)} rows, no SQL, {took:.1f}s"
    t0 = time.time()
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    types = {d[0]: str(d[1]) for d in rel.description}
    if sorted(names) != cols:
        return False, f"columns {cols} vs {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = [tuple(cell(r[i]) for i in order) for r in rel.fetchall()]
    sql_took = time.time() - t0
    bad = {c: (types[c], df.schema[c].dataType.simpleString()) for c in cols if SPARK_TYPES.get(types[c]) != df.schema[c].dataType.simpleString()}
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a, b = sorted(rows, key=key), sorted(want, key=key)
    if a != b:
        sa, sb = set(a), set(b)
        return False, f"{len(a)} vs {len(b)} rows; only spark {sorted(sa - sb, key=key)[:2]} only sql {sorted(sb - sa, key=key)[:2]} cols {cols}"
    note = f" TYPES {bad}" if bad else ""
    return not bad, f"{len(rows)} rows, spark {took:.1f}s sql {sql_took:.1f}s{note}"


def main() -> int:
    import __spark_entry__ as entry
    from ledgerlens.session import local_session

    folder, prefixes = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), database(folder)
    sqls, failed = entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            ok, note = compare(spark, con, name, fn, sqls.get(name), folder)
        except Exception as exc:
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:600]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)
    return len(failed)


if __name__ == "__main__":
    sys.exit(main())
