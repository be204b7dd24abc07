"""Run a named query on Spark and its oracle SQL on DuckDB; compare like the driver does.

Row count, column names, and the multiset of rows (columns sorted by name, rows sorted)
must be equal.  Values are compared exactly; floats by their repr.

    python tests/oracle_compare.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duckdb_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return repr(float(v))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return repr(v)


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda t: tuple("" if x is None else x for x in t)), [columns[i] for i in order]


_TYPE_MAP = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
    "timestamp": "TIMESTAMP WITH TIME ZONE",
    "date": "DATE",
}


def _duck_types(con, sql: str) -> dict[str, str]:
    return {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    from __spark_entry__ import oracle_sql, queries

    t0 = time.time()
    sdf = queries()[name](spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    sql = oracle_sql().get(name)
    if sql is None:
        return True, f"{name}: rows-only ({len(srows)} rows, {t1 - t0:.1f}s)"
    res = con.execute(sql)
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    s_sorted, s_cols = rows_of(sdf.columns, srows)
    o_sorted, o_cols = rows_of(ocols, orows)
    if s_cols != o_cols:
        return False, f"{name}: columns differ spark={s_cols} oracle={o_cols}"
    duck = _duck_types(con, sql)
    bad_types = {c: (t, duck[c]) for c, t in sdf.dtypes if _TYPE_MAP.get(t, t) != duck[c]}
    if bad_types:
        return False, f"{name}: column types differ {bad_types}"
    if len(s_sorted) != len(o_sorted):
        return False, f"{name}: row count spark={len(s_sorted)} oracle={len(o_sorted)}"
    bad = [(a, b) for a, b in zip(s_sorted, o_sorted) if a != b]
    if bad:
        return False, f"{name}: {len(bad)} rows differ, e.g. spark={bad[0][0]} oracle={bad[0][1]} cols={s_cols}"
    return True, f"{name}: OK ({len(s_sorted)} rows, {t1 - t0:.1f}s)"


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    from campaign_analytics.session import build_session
    from __spark_entry__ import queries

    spark = build_session("local[8]", 8)
    con = duckdb_connection(sf_dir)
    names = names or list(queries())
    failed = 0
    for n in names:
        try:
            ok, msg = compare(spark, con, n, sf_dir)
        except Exception as exc:  # report and continue
            ok, msg = False, f"{n}: ERROR {type(exc).__name__}: {str(exc)[:400]}"
        failed += not ok
        print(("PASS " if ok else "FAIL ") + msg, flush=True)
    print(f"{len(names) - failed}/{len(names)} passed")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
