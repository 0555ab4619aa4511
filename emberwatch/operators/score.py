"""Scoring and report facts: F-01 hypothesis confidence, F-02 ranking, F-03 bands (see functions),
F-07 evidence pack, F-08 SLA breach facts, F-09 default remediation steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch import constants as K
from emberwatch.operators.knowledge import py_list_repr
from emberwatch.operators.rangejoin import range_max


def confidence(df: DataFrame, *, similar: str = "similar_count", deployment: str = "deployment_correlated",
               runbook: str = "has_runbook", competing: str = "competing", evidence: str = "evidence") -> DataFrame:
    """F-01: 0.50; similar incidents +0.15 (>= 3: another +0.10) else -0.15; deployment +0.20; runbook +0.05;
    more than 2 competing hypotheses -0.10; >= 4 evidence items +0.05; clamp to [0, 1]; round 3.
    The additions run in the reference's order so the double sums are identical."""
    s = F.lit(0.5)
    s = F.when(F.col(similar) > 0, s + F.lit(0.15)).otherwise(s - F.lit(0.15))
    s = F.when(F.col(similar) >= 3, s + F.lit(0.10)).otherwise(s)
    s = F.when(F.col(deployment), s + F.lit(0.20)).otherwise(s)
    s = F.when(F.col(runbook), s + F.lit(0.05)).otherwise(s)
    s = F.when(F.col(competing) > 2, s - F.lit(0.10)).otherwise(s)
    s = F.when(F.size(evidence) >= 4, s + F.lit(0.05)).otherwise(s)
    return df.withColumn("confidence", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), s)), 3))


def rank(df: DataFrame, *, keep: int = 4, group: str = "incident_id", order: str = "rank") -> DataFrame:
    """F-02: the first `keep` hypotheses (input order), sorted by confidence desc, stable on input order,
    renumbered from 1."""
    w0 = Window.partitionBy(group).orderBy(order)
    first = df.withColumn("__i", F.row_number().over(w0)).where(F.col("__i") <= keep)
    w = Window.partitionBy(group).orderBy(F.col("confidence").desc(), F.col("__i").asc())
    return first.withColumn("rank", F.row_number().over(w).cast("long")).drop("__i")


def top_candidate(ranked: DataFrame, *, group: str = "incident_id") -> DataFrame:
    """F-02: the rank-1 hypothesis and its confidence per incident."""
    return ranked.groupBy(group).agg(
        F.max_by("hypothesis", F.struct(-F.col("rank"))).alias("top_root_cause"),
        F.max_by("confidence", F.struct(-F.col("rank"))).alias("top_confidence"),
        F.count("*").alias("candidates"))


def evidence_pack(incidents: DataFrame, hits: DataFrame, *, per_section: int = 3, chars: int = 400) -> DataFrame:
    """F-07: the whole evidence text of each request: incident header (services, type, severity, description), correlation
    signals with two evidence lines each, the deployment block if there is one, and up to `per_section` chunks of each
    search ('[title] (relevance x.xx)' and the first `chars` characters), sections in the fixed order.

    `incidents`: query_id, affected_services, anomaly_type, severity, description, correlation_signals (array of
    signal_type, strength, description, evidence), deployment_context (struct or null). `hits`: query_id, collection,
    chunk_id, rank, score, title, content. Absent texts are empty; a request without hits keeps its first blocks."""
    titles = dict(K.SECTION_TITLES)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    empty = F.array().cast("array<string>")
    signal = lambda s: F.concat(
        F.lit("- ["), F.coalesce(s["signal_type"], F.lit("")), F.lit("] (strength "), F.format_string("%.2f", F.coalesce(s["strength"], F.lit(0.0))),
        F.lit("): "), F.coalesce(s["description"], F.lit("")),
        F.array_join(F.transform(F.slice(F.coalesce(s["evidence"], empty), 1, 2), lambda e: F.concat(F.lit("\n    Evidence: "), e)), ""))
    signals = F.when(F.size(F.coalesce("correlation_signals", F.array())) > 0, F.array_join(F.transform("correlation_signals", signal), "\n")
                     ).otherwise(F.lit("- No correlation signals"))
    d = F.col("deployment_context")
    part = lambda name, absent="": F.coalesce(d[name].cast("string"), F.lit(absent))
    deployment = F.when(d.isNotNull(), F.concat(
        F.lit("\n\n=== RECENT DEPLOYMENT ===\nService: "), part("service_name"), F.lit(" "), part("version"), F.lit("\nDelta: "),
        part("time_delta_minutes", "?"), F.lit(" minutes before incident\nChange type: "), part("change_type"), F.lit("\nKnown risks: "),
        py_list_repr(F.coalesce(d["known_risks"], empty)), F.lit("\nCorrelation confidence: "),
        F.format_string("%.2f", F.coalesce(d["correlation_confidence"], F.lit(0.0))))).otherwise(F.lit(""))
    header = F.concat(
        F.lit("=== INCIDENT DETAILS ===\nIncident ID: "), text("query_id"), F.lit("\nService: "), F.array_join(F.coalesce("affected_services", empty), ", "),
        F.lit("\nAnomaly Type: "), text("anomaly_type"), F.lit("\nSeverity: "), text("severity"), F.lit("\nDescription: "), text("description"),
        F.lit("\n\n=== CORRELATION SIGNALS ===\n"), signals, deployment)

    w = Window.partitionBy("query_id", "collection").orderBy("rank", "chunk_id")
    top = hits.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= per_section)
    line = F.concat(F.lit("["), text("title"), F.lit("] (relevance "), F.format_string("%.2f", F.col("score")), F.lit(")\n"),
                    F.substring(text("content"), 1, chars), F.lit("\n"))
    order = F.array_position(F.array(*[F.lit(c) for c in K.BUDGET_ORDER]), F.col("collection"))
    title = F.create_map(*[F.lit(x) for pair in titles.items() for x in pair])[F.col("collection")]
    sections = top.groupBy("query_id", "collection").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__n", line.alias("l")))), lambda x: x["l"]), "\n").alias("body"))
    sections = sections.select("query_id", order.alias("o"), F.concat(F.lit("\n\n=== "), title, F.lit(" ===\n"), F.col("body")).alias("sec"))
    packs = sections.groupBy("query_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "sec"))), lambda x: x["sec"]), "").alias("sections"))
    return incidents.select("query_id", header.alias("header")).join(packs, "query_id", "left").select(
        "query_id", F.concat(F.col("header"), F.coalesce(F.col("sections"), F.lit(""))).alias("context"))


def sla_breach(resolved: DataFrame, metrics: DataFrame, registry: DataFrame, *, max_span_ms: int) -> DataFrame:
    """F-08: peak p99 latency and error rate during [detection, resolution] against the registry SLA.
    `max_span_ms` bounds resolution - detection (the recovery limit), which sizes the buckets of maxima."""
    r = resolved.select("incident_id", "source_service", "detection_time", "resolved_at")
    asked = r.select("*", F.explode(F.array(F.lit("service_latency_p99_ms"), F.lit("service_error_rate_percent"))).alias("m_metric"))
    m = metrics.select(F.col("source_service").alias("m_service"), "metric_name", F.col("ts").alias("m_ts"), "metric_value")
    peaks = range_max(asked, m.where(F.col("metric_name").isin("service_latency_p99_ms", "service_error_rate_percent")),
                      ids=["incident_id", "m_metric"], point_keys=["source_service", "m_metric"], row_keys=["m_service", "metric_name"],
                      start="detection_time", end="resolved_at", row_ts="m_ts", value="metric_value", out="peak", span_ms=int(max_span_ms))
    of = lambda name: F.max(F.when(F.col("m_metric") == name, F.col("peak")))
    peaks = peaks.groupBy("incident_id").agg(of("service_latency_p99_ms").alias("peak_p99_ms"),
                                             of("service_error_rate_percent").alias("peak_error_rate_pct"))
    reg = registry.select(F.col("service_name").alias("__svc"), "sla_p99_latency_ms", "sla_error_rate_pct")
    out = r.join(peaks, "incident_id", "left").join(reg, F.col("source_service") == F.col("__svc"), "left").drop("__svc")
    return out.select(
        "incident_id", "source_service", "peak_p99_ms", "peak_error_rate_pct", "sla_p99_latency_ms",
        "sla_error_rate_pct",
        F.coalesce(F.col("peak_p99_ms") > F.col("sla_p99_latency_ms"), F.lit(False)).alias("p99_breached"),
        F.coalesce(F.col("peak_error_rate_pct") > F.col("sla_error_rate_pct"), F.lit(False)).alias("error_breached"))


STEP_FIELDS = ("step_id", "priority", "action", "rationale", "risk_level", "rollback", "owner", "expected_outcome")


def _step_cells(service: Column, *more: Column) -> Column:
    """The fallback steps of a service as an array of structs; `more`: fields that every step gets."""
    cells = []
    for i, step in enumerate(K.DEFAULT_STEPS, 1):
        texts = [F.replace(F.lit(v), F.lit("{service}"), service).alias(k) for k, v in step.items()]
        cells.append(F.struct(F.lit(i).cast("long").alias("step_id"), *texts, *more))
    return F.array(*cells)


def default_steps(rca: DataFrame, registry: DataFrame, *, per: DataFrame | None = None) -> DataFrame:
    """F-09: the two fallback steps for an RCA, owned by the primary service's on-call rotation, with the escalation path
    and the estimated time of the plan.

    With `per` (a frame with `incident_id`): each of its rows whose incident has an RCA, with the steps of all its RCAs as
    one sorted array `steps` (structs of STEP_FIELDS), their `escalation_path`, `estimated_resolution_time` and sorted
    `runbook_refs`. Services and owners are grouped and joined; the texts are written into the joined rows, so no step's
    text is sorted or shuffled."""
    reg = registry.select(F.col("service_name").alias("__svc"), "on_call_rotation")
    j = rca.join(reg, F.col("service") == F.col("__svc"), "left")
    owner = F.coalesce(F.col("on_call_rotation"), F.lit(K.DEFAULT_ON_CALL))
    if per is None:
        return j.select("incident_id", "service", owner.alias("owner"), F.array(owner).alias("escalation_path"),
                        F.lit(K.DEFAULT_RESOLUTION_TIME).alias("estimated_resolution_time"), F.inline(_step_cells(F.col("service"))))
    asked = j.groupBy("incident_id").agg(F.collect_list(F.struct(F.col("service").alias("s"), owner.alias("o"))).alias("__asked"), F.first(owner).alias("__owner"))
    both = per.join(asked, "incident_id")
    cells = F.flatten(F.transform("__asked", lambda x: _step_cells(x["s"], x["o"].alias("owner"))))
    steps = F.sort_array(F.transform(cells, lambda x: F.struct(*[x[c].alias(c) for c in STEP_FIELDS])))
    refs = F.sort_array(F.array_distinct(F.filter(F.transform(cells, lambda x: x["runbook_source"]), lambda x: x.isNotNull())))
    return both.select(*per.columns, steps.alias("steps"), F.array("__owner").alias("escalation_path"),
                       F.lit(K.DEFAULT_RESOLUTION_TIME).alias("estimated_resolution_time"), refs.alias("runbook_refs"))
