"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tests/oracle_check.py [sf_dir] [key ...]
Compares row count, column names and an order-insensitive hash of the values
(floats rounded to 6 places). Prints one line per key and a summary.
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from revlens.plans.registry import ORACLE, QUERIES, load_all  # noqa: E402
from revlens.sources.driver import BASE_TABLES  # noqa: E402


_SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN",
                  "double": "DOUBLE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        return f"{round(v, 6):.6f}"
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def digest(rows, cols):
    lines = sorted("\x1f".join(_norm(r[c]) for c in cols) for r in rows)
    return hashlib.md5("\n".join(lines).encode()).hexdigest()


def compare(spark, con, sf_dir, key):
    t0 = time.time()
    sdf = QUERIES[key](spark, sf_dir)
    srows = [r.asDict() for r in sdf.collect()]
    scols = sorted(sdf.columns)
    t1 = time.time()
    if key not in ORACLE:
        return dict(key=key, rows=len(srows), status="no-oracle", secs=round(t1 - t0, 2))
    cur = con.execute(ORACLE[key])
    dcols = sorted(d[0] for d in cur.description)
    names = [d[0] for d in cur.description]
    drows = [dict(zip(names, r)) for r in cur.fetchall()]
    ok_cols = scols == dcols
    duck_types = {d[0]: str(d[1]).upper() for d in cur.description}
    spark_types = dict(sdf.dtypes)
    type_diff = {
        c: (spark_types[c], duck_types.get(c))
        for c in scols
        if c in duck_types and _SPARK_TO_DUCK.get(spark_types[c], spark_types[c].upper()) != duck_types[c]
    }
    ok_rows = len(srows) == len(drows)
    ok_hash = ok_cols and digest(srows, scols) == digest(drows, dcols)
    status = "OK" if (ok_cols and ok_rows and ok_hash) else "MISMATCH"
    return dict(key=key, rows=len(srows), oracle_rows=len(drows), cols=ok_cols, hash=ok_hash,
                status=status, secs=round(t1 - t0, 2), type_diff=type_diff, scols=scols, dcols=dcols)


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:]
    from revlens.session import local_session

    spark = local_session()
    load_all()
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    bad = 0
    for key in keys or list(QUERIES):
        try:
            res = compare(spark, con, sf_dir, key)
        except Exception as e:  # report and continue
            res = dict(key=key, status="ERROR", error=str(e)[:600])
        if res["status"] not in ("OK", "no-oracle"):
            bad += 1
        print(res, flush=True)
    print(f"DONE {len(keys or QUERIES) - bad} ok / {bad} bad")


if __name__ == "__main__":
    main(sys.argv)
