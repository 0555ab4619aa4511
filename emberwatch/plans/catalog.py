"""The query catalogue: every registered query is a (spark, sf_dir) -> DataFrame callable with an
optional DuckDB twin. Double columns are rounded to 7 digits on both sides so float noise in the
last bits does not break the value hash."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The test durations of the queries suit sf0.01; series at sf0.1 are ten times denser, so the bench divides by 10.
DURATION_DIV = int(os.environ.get("EMBERWATCH_DURATION_DIV", "1"))

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    name: str
    fn: QueryFn
    sql: str | None
    doubles: Sequence[str] = field(default_factory=tuple)
    bench: bool = False
    check: Callable | None = None  # assertions over the rows of a query without a twin


CATALOG: dict[str, Entry] = {}


def register(name: str, sql: str | None = None, *, doubles: Sequence[str] = (), bench: bool = False, check: Callable | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in CATALOG:
            raise ValueError(f"duplicate query {name}")
        if sql is None and check is None:
            raise ValueError(f"{name} needs a DuckDB twin or a check of its rows")
        CATALOG[name] = Entry(name, fn, sql, tuple(doubles), bench, check)
        return fn
    return deco


def round7(c):
    """Half-up to 7 digits with plain IEEE arithmetic, bit-identical in Spark and DuckDB."""
    return (F.floor(c * F.lit(10000000.0) + F.lit(0.5)).cast("double") / F.lit(10000000.0))


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberwatch.session import ship_package

    ship_package(spark)
    e = CATALOG[name]
    df = e.fn(spark, sf_dir)
    if e.doubles:
        df = df.select(*[round7(F.col(c)).alias(c) if c in e.doubles else F.col(c) for c in df.columns])
    return df


def oracle(name: str) -> str | None:
    e = CATALOG[name]
    if e.sql is None:
        return None
    if not e.doubles:
        return e.sql
    rep = ", ".join(f"floor({c} * 10000000.0 + 0.5) / 10000000.0 AS {c}" for c in e.doubles)
    return f"SELECT * REPLACE ({rep}) FROM (\n{e.sql}\n) AS q"


def load_all() -> dict[str, Entry]:
    # importing the query modules fills CATALOG
    from emberwatch.plans import (  # noqa: F401
        q_detect,
        q_serve,
        q_correlate,
        q_knowledge,
        q_retrieve,
        q_score,
        q_notify,
        q_ingest,
        q_events,
        q_stream,
    )
    return CATALOG
