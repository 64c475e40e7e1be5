"""Side-by-side check of a Spark query against its DuckDB oracle, in the driver's manner:
row count, column names, and an order-insensitive hash of rounded values."""

from __future__ import annotations

import hashlib
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, digits: int):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        r = round(v, digits)
        return 0.0 if r == 0 else r
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if hasattr(v, "asDict"):
        return tuple(_norm(x, digits) for x in v)
    return v


def rows_hash(columns, rows, digits: int = 6):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    canon = sorted(repr(tuple(_norm(r[i], digits) for i in order)) for r in rows)
    return hashlib.sha256("\n".join(canon).encode()).hexdigest()


def compare(spark_df, con, sql: str, digits: int = 6):
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    out = {
        "rows": (len(s_rows), len(d_rows)),
        "columns_match": sorted(s_cols) == sorted(d_cols),
        "hash_match": rows_hash(s_cols, s_rows, digits) == rows_hash(d_cols, d_rows, digits),
    }
    if not out["columns_match"]:
        out["columns"] = (sorted(s_cols), sorted(d_cols))
    if not out["hash_match"]:
        order_s = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
        order_d = sorted(range(len(d_cols)), key=lambda i: d_cols[i])
        ss = sorted(repr(tuple(_norm(r[i], digits) for i in order_s)) for r in s_rows)
        dd = sorted(repr(tuple(_norm(r[i], digits) for i in order_d)) for r in d_rows)
        only_s = sorted(set(ss) - set(dd))[:3]
        only_d = sorted(set(dd) - set(ss))[:3]
        out["only_spark"] = only_s
        out["only_duck"] = only_d
    out["ok"] = out["rows"][0] == out["rows"][1] and out["columns_match"] and out["hash_match"]
    return out
