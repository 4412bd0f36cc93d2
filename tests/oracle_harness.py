"""Local mirror of the driver's correctness gate: Spark query vs DuckDB oracle.

Compares column names, row counts and the order-insensitive multiset of normalised rows.
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def compare(spark_df, sql: str, con) -> tuple[bool, str]:
    scols = spark_df.columns
    srows = [tuple(r) for r in spark_df.collect()]
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    if sorted(scols) != sorted(dcols):
        return False, f"columns differ: spark={sorted(scols)} duck={sorted(dcols)}"
    if len(srows) != len(drows):
        return False, f"row count spark={len(srows)} duck={len(drows)}"
    a, b = _rows(scols, srows), _rows(dcols, drows)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return False, f"values differ ({sum(1 for x, y in zip(a, b) if x != y)} rows), e.g. {diff}"
    return True, f"{len(srows)} rows"


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import time

    from __spark_entry__ import oracle_sql, queries
    from revline.session import get_session
    sf = sys.argv[1] if len(sys.argv) > 1 and sys.argv[1].startswith("/") else "/root/testdata/sf0.01"
    plain = "--plain" in sys.argv
    names = [a for a in sys.argv[1:] if not a.startswith("/") and not a.startswith("--")]
    if plain:  # a session like the driver's: only the documented settings, another time zone
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8") \
            .config("spark.sql.session.timeZone", "America/Los_Angeles").config("spark.ui.enabled", "false") \
            .getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    else:
        spark = get_session()
    con = duck(sf)
    qs, os_ = queries(), oracle_sql()
    bad = 0
    for name in names or sorted(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"{name:28s} BAD build error: {type(e).__name__}: {str(e)[:300]}", flush=True)
            continue
        if name not in os_:
            n = df.count()
            print(f"{name:28s} ROWS-ONLY {n} rows  {time.time()-t0:.1f}s", flush=True)
            continue
        try:
            ok, msg = compare(df, os_[name], con)
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"error: {type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(f"{name:28s} {'OK ' if ok else 'BAD'} {msg}  {time.time()-t0:.1f}s", flush=True)
    print("FAILED", bad)
