"""Ingest transforms I-01..I-08: log level, level filter, label fallback, service canonicalisation,
sample dedup, catalogue filter, nested stream flattening and the high-water mark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch import constants as K
from emberwatch.functions.columns import detect_level, service_label
from emberwatch.operators.suppress import suppress


def with_level(df: DataFrame, *, line: str = "message") -> DataFrame:
    """I-01."""
    return df.withColumn("level", detect_level(line))


def keep_levels(df: DataFrame, *, levels: Sequence[str] = tuple(K.LOG_LEVELS_KEPT), max_chars: int = 500,
                message: str = "message") -> DataFrame:
    """I-02: keep ERROR/FATAL/WARN lines, truncated to max_chars."""
    return df.where(F.col("level").isin(*levels)).withColumn(message, F.substring(message, 1, max_chars))


def with_service_label(df: DataFrame, *, labels: str = "labels") -> DataFrame:
    """I-03."""
    return df.withColumn("service", service_label(labels))


def canonical_service(df: DataFrame, services: Sequence[str] = tuple(K.SERVICES), *, raw: str = "raw_service") -> DataFrame:
    """I-04: first catalogue entry contained in the raw name (catalogue order); rows with none are dropped."""
    cands = F.filter(F.array(*[F.lit(s) for s in services]), lambda s: F.col(raw).contains(s))
    return df.withColumn("source_service", F.element_at(cands, 1)).where(F.size(cands) > 0)


def dedup_samples(df: DataFrame, *, ttl_s: float = K.SCRAPE_DEDUP_S) -> DataFrame:
    """I-05: keep a (service, metric) sample only when >= ttl since the last kept one (D-06 fold)."""
    return suppress(df, keys=["source_service", "metric_name"], ts="ts", tie="event_id", ttl_s=ttl_s)


def known_series(df: DataFrame, services: Sequence[str] = tuple(K.SERVICES),
                 metrics: Sequence[str] = tuple(K.METRIC_NAMES)) -> DataFrame:
    """I-06: catalogue filter (an `isin` on literals; pushes to the scan)."""
    return df.where(F.col("source_service").isin(*services) & F.col("metric_name").isin(*metrics))


def flatten_streams(df: DataFrame, *, labels: str = "labels", values: str = "values") -> DataFrame:
    """I-07: (labels, [[ns, line], ...]) -> one row per line with service, level, ts (ms), message."""
    rows = df.select(labels, F.posexplode(values).alias("pos", "pair"))
    ns = F.col("pair").getItem(0).cast("long")
    line = F.col("pair").getItem(1)
    return rows.select(service_label(labels).alias("service"), F.col("pos").cast("long").alias("pos"),
                       ns.alias("ts_ns"), F.expr("cast(pair[0] as bigint) div 1000000").alias("ts"),
                       detect_level(line).alias("level"),
                       F.substring(line, 1, 500).alias("message"))


def high_water(df: DataFrame, *, col: str = "ts_ns", start: int = 0, group: Sequence[str] = ()) -> DataFrame:
    """I-08: new cursor = max(col) + 1, never below `start` (unchanged when there is no new row)."""
    agg = F.greatest(F.coalesce(F.max(col) + 1, F.lit(start)), F.lit(start)).alias("cursor")
    return df.groupBy(*group).agg(agg) if group else df.agg(agg)
