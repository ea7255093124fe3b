"""Run catalog queries in Spark and their SQL in DuckDB; compare rows,
column names and an order-insensitive hash of the values (as the driver)."""

from __future__ import annotations

import hashlib
import math
import sys
import time

import duckdb

SF_DIR = "/root/testdata/sf0.01"


def duck(sf_dir: str):
    con = duckdb.connect()
    from kestrel.sources.tables import TABLES
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return repr(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16]


_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
          "boolean": "BOOLEAN", "date": "DATE", "float": "FLOAT", "array<float>": "FLOAT[]",
          "array<string>": "VARCHAR[]", "timestamp": "TIMESTAMP WITH TIME ZONE",
          "timestamp_ntz": "TIMESTAMP"}


def type_diffs(df, res):
    spark_t = {f.name: _TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    duck_t = {d[0]: str(d[1]) for d in res.description}
    return {c: (spark_t[c], duck_t.get(c)) for c in spark_t if spark_t[c] != duck_t.get(c)}


def compare(spark, name, fn, sql, con, sf_dir=SF_DIR):
    t0 = time.time()
    df = fn(spark, sf_dir)
    srows = [tuple(r) for r in df.collect()]
    scols = df.columns
    t1 = time.time()
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    tdiff = type_diffs(df, res)
    ok_cols = sorted(scols) == sorted(dcols)
    ok_n = len(srows) == len(drows)
    ok_h = ok_cols and digest(scols, srows) == digest(dcols, drows)
    return dict(name=name, rows=len(srows), duck_rows=len(drows), cols=ok_cols, count=ok_n,
                hash=ok_h, types=tdiff, spark_s=round(t1 - t0, 2), scols=scols, dcols=dcols,
                srows=srows, drows=drows)


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from __spark_entry__ import oracle_sql, queries
    from kestrel.session import get_spark
    spark = get_spark(master="local[8]")
    con = duck(SF_DIR)
    only = set(sys.argv[1:])
    qs, sqls = queries(), oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        if name not in sqls:
            df = fn(spark, SF_DIR)
            print(f"{name:28s} rows-only {df.count()}")
            continue
        try:
            r = compare(spark, name, fn, sqls[name], con)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"{name:28s} ERROR {type(e).__name__}: {str(e)[:400]}")
            continue
        flag = "OK " if (r["cols"] and r["count"] and r["hash"]) else "BAD"
        bad += flag == "BAD"
        print(f"{name:28s} {flag} rows={r['rows']}/{r['duck_rows']} cols={r['cols']} hash={r['hash']} t={r['spark_s']}s" + (f" TYPES {r['types']}" if r['types'] else ""))
        if flag == "BAD":
            print("   spark cols", r["scols"], "duck cols", r["dcols"])
            s = sorted(map(str, r["srows"]))[:3]
            d = sorted(map(str, r["drows"]))[:3]
            print("   spark", s)
            print("   duck ", d)
    print("bad:", bad)
