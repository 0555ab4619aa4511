"""Compare a Spark result with its DuckDB twin: column names, row count and an order-insensitive
multiset of normalised rows (floats are already rounded by the catalogue)."""

from __future__ import annotations

import math

import duckdb

from emberwatch.plans import catalog
from emberwatch.sources.tables import TABLES


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in records), key=repr)


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(name: str, spark, sf_dir: str, con) -> tuple[bool, str]:
    sdf = catalog.run(name, spark, sf_dir)
    scols = sdf.columns
    rows = sdf.collect()
    srows = [tuple(r) for r in rows]
    sql = catalog.oracle(name)
    if sql is None:
        try:
            catalog.CATALOG[name].check(rows)
        except AssertionError as why:
            return False, str(why)
        return True, f"{len(srows)} rows (checked without a twin)"
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    if sorted(scols) != sorted(dcols):
        return False, f"columns differ: {sorted(scols)} vs {sorted(dcols)}"
    a, b = rows_of(scols, srows), rows_of(dcols, drows)
    if a != b:
        sa, sb = set(a), set(b)
        return False, (f"{len(a)} vs {len(b)} rows; spark-only {list(sa - sb)[:2]}; duck-only {list(sb - sa)[:2]}")
    return True, f"{len(a)} rows"
