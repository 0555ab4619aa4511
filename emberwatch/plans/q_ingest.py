"""Registered ingest queries (I-01..I-04, I-06..I-08) with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberwatch import constants as K
from emberwatch.functions.columns import detect_level, epoch_ms
from emberwatch.operators import ingest as I
from emberwatch.plans.catalog import register
from emberwatch.sources import adapters as A
from emberwatch.sources.tables import table

_LEVEL = A._level_sql("message")


@register("i01_detect_level", A.with_adapters(f"SELECT event_id, {_LEVEL} AS level FROM logs", "logs"))
def q_level(spark, sf):
    return A.logs(spark, sf).select("event_id", detect_level("message").alias("level"))


@register("i02_keep_levels", A.with_adapters(
    "SELECT event_id, source_service, level, substr(message, 1, 500) AS message, ts FROM logs "
    "WHERE level IN ('ERROR', 'FATAL', 'WARN')", "logs"))
def q_keep(spark, sf):
    return I.keep_levels(A.logs(spark, sf)).select("event_id", "source_service", "level", "message", "ts")


def _labelled(spark, sf):
    ev = table(spark, sf, "events")
    s = A.svc("user_id")
    k = F.col("event_id") % 4
    labels = (F.when(k == 0, F.create_map(F.lit("service"), s))
               .when(k == 1, F.create_map(F.lit("app"), s))
               .when(k == 2, F.create_map(F.lit("job"), s))
               .otherwise(F.create_map().cast("map<string,string>")))
    return ev.select("event_id", labels.alias("labels"))


@register("i03_service_label", f"""
    SELECT event_id, coalesce(labels['service'], labels['app'], labels['job'], 'unknown') AS service FROM (
        SELECT event_id, CASE event_id % 4 WHEN 0 THEN MAP {{'service': {A._svc_sql('user_id')}}}
                                           WHEN 1 THEN MAP {{'app': {A._svc_sql('user_id')}}}
                                           WHEN 2 THEN MAP {{'job': {A._svc_sql('user_id')}}}
                                           ELSE MAP {{}}::MAP(VARCHAR, VARCHAR) END AS labels FROM events)""")
def q_label(spark, sf):
    return I.with_service_label(_labelled(spark, sf)).select("event_id", "service")


def _raw_names(spark, sf):
    ev = table(spark, sf, "events")
    raw = F.when(F.col("user_id") % 7 == 0, F.concat(F.lit("legacy-"), F.col("event_type")))\
           .otherwise(F.concat(F.lit("k8s-"), A.svc("user_id"), F.lit("-"), (F.col("event_id") % 100).cast("string")))
    return ev.select("event_id", "event_type", raw.alias("raw_service"))


_RAW_SQL = f"""SELECT event_id, event_type, CASE WHEN user_id % 7 = 0 THEN 'legacy-' || event_type
        ELSE 'k8s-' || {A._svc_sql('user_id')} || '-' || (event_id % 100)::VARCHAR END AS raw_service FROM events"""
_SVCS = "[" + ", ".join(f"'{s}'" for s in K.SERVICES) + "]"
_CANON_SQL = f"""SELECT event_id, event_type, list_filter({_SVCS}, lambda s: contains(raw_service, s))[1] AS source_service
    FROM ({_RAW_SQL}) WHERE len(list_filter({_SVCS}, lambda s: contains(raw_service, s))) > 0"""


@register("i04_canonical_service", f"SELECT event_id, source_service FROM ({_CANON_SQL})")
def q_canon(spark, sf):
    return I.canonical_service(_raw_names(spark, sf)).select("event_id", "source_service")


_METRIC_OF = ("CASE event_type WHEN 'click' THEN 'service_cpu_percent' WHEN 'purchase' THEN 'service_memory_percent' "
              "WHEN 'error' THEN 'service_error_rate_percent' WHEN 'view' THEN 'service_latency_p99_ms' "
              "ELSE 'signup_count' END")


@register("i06_known_series", f"""
    SELECT event_id, source_service, metric_name FROM (SELECT event_id, source_service, {_METRIC_OF} AS metric_name
        FROM ({_CANON_SQL})) WHERE source_service IN ({", ".join(f"'{s}'" for s in K.SERVICES)})
        AND metric_name IN ({", ".join(f"'{m}'" for m in K.METRIC_NAMES)})""")
def q_known(spark, sf):
    c = I.canonical_service(_raw_names(spark, sf))
    et = F.col("event_type")
    name = (F.when(et == "click", "service_cpu_percent").when(et == "purchase", "service_memory_percent")
             .when(et == "error", "service_error_rate_percent").when(et == "view", "service_latency_p99_ms")
             .otherwise("signup_count"))
    return I.known_series(c.select("event_id", "source_service", name.alias("metric_name")))


def _streams(spark, sf):
    lg = A.logs(spark, sf)
    ns = F.col("ts") * 1_000_000 + (F.col("event_id") % 1000)
    lg = lg.select("source_service", (F.col("event_id") / 100).cast("long").alias("chunk"), "event_id",
                   F.array(ns.cast("string"), F.col("message")).alias("pair"))
    g = lg.groupBy("source_service", "chunk").agg(F.sort_array(F.collect_list(F.struct("event_id", "pair"))).alias("v"))
    return g.select(F.create_map(F.lit("app"), F.col("source_service")).alias("labels"),
                    F.transform("v", lambda x: x["pair"]).alias("values"), "chunk")


@register("i07_flatten_streams", A.with_adapters(f"""
    SELECT source_service AS service, (ts * 1000000 + event_id % 1000) AS ts_ns,
           (ts * 1000000 + event_id % 1000) // 1000000 AS ts, {A._level_sql('message')} AS level,
           substr(message, 1, 500) AS message FROM logs""", "logs"))
def q_flatten(spark, sf):
    return I.flatten_streams(_streams(spark, sf)).select("service", "ts_ns", "ts", "level", "message")


@register("i08_high_water", A.with_adapters(
    "SELECT source_service, greatest(coalesce(max(ts * 1000000 + event_id % 1000) + 1, 0), 0) AS cursor "
    "FROM logs GROUP BY 1", "logs"))
def q_high_water(spark, sf):
    lg = A.logs(spark, sf).withColumn("ts_ns", F.col("ts") * 1_000_000 + (F.col("event_id") % 1000))
    return I.high_water(lg, col="ts_ns", start=0, group=["source_service"])
