"""Run registered queries in Spark and their SQL oracles in DuckDB; compare results.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb
import numpy as np

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return ("~null",)
    if isinstance(v, float) and math.isnan(v):
        return ("~null",)
    if isinstance(v, (bool, np.bool_)):
        return int(v)
    if isinstance(v, (int, np.integer)):
        return float(v)
    if isinstance(v, (float, np.floating, decimal.Decimal)):
        return round(float(v), 6) + 0.0
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if hasattr(v, "toArray"):
        return tuple(_norm(x) for x in v.toArray())
    return str(v)


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "float": "FLOAT", "timestamp_ntz": "TIMESTAMP",
                 "array<double>": "DOUBLE[]", "array<float>": "FLOAT[]", "date": "DATE"}


def _spark_type(t):
    return SPARK_TO_DUCK.get(t, t)


def _duck_type(t):
    return str(t).upper()


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=repr)


def compare(spark, name, fn, sql, sf_dir, con):
    t = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = list(sdf.columns)
    t_spark = time.time() - t
    res = {"name": name, "spark_rows": len(srows), "spark_sec": round(t_spark, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    res["oracle_rows"] = len(drows)
    if sorted(scols) != sorted(dcols):
        res["status"] = f"COLUMNS {sorted(scols)} vs {sorted(dcols)}"
        return res
    stypes = dict(sdf.dtypes)
    dtypes = dict(zip(dcols, [_duck_type(d[1]) for d in cur.description]))
    bad_types = {c: (stypes[c], dtypes[c]) for c in scols if _spark_type(stypes[c]) != dtypes[c]}
    if bad_types:
        res["types"] = bad_types
    a, b = rows_of(scols, srows), rows_of(dcols, drows)
    if len(a) != len(b):
        res["status"] = "ROWCOUNT"
        return res
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
        res["status"] = f"VALUES {diff}"
        return res
    res["status"] = "ok"
    return res


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from flawscope.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    spark = build_session(8, 8)
    con = duck(sf_dir)
    qs, oracles = E.queries(), E.oracle_sql()
    bad = 0
    for name in names or sorted(qs):
        try:
            res = compare(spark, name, qs[name], oracles.get(name), sf_dir, con)
        except Exception as e:  # noqa: BLE001
            res = {"name": name, "status": f"ERROR {type(e).__name__}: {str(e)[:300]}"}
        if res["status"] not in ("ok", "rows-only") or res.get("types"):
            bad += 1
        print(res, flush=True)
    print("BAD", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
