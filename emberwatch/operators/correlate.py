"""Correlation operators C-01..C-17 and recovery F-04.

Per-incident replays of the reference become range joins (service + time bucket equi-key, see
`rangejoin`); every per-incident list is cut to its first k rows with `row_number() <= k`, which
Catalyst turns into a partial WindowGroupLimit before the shuffle, so no unbounded list is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch import constants as K
from emberwatch.operators.rangejoin import first_rows, range_join, range_max
from emberwatch.operators.suppress import suppress

MIN = 60_000

_ANOM = ["incident_id", "source_service", "detection_time"]


def _anoms(anoms: DataFrame) -> DataFrame:
    return anoms.select(*_ANOM)


def telemetry(anoms: DataFrame, metrics: DataFrame, *, minutes: float = K.CORRELATION_WINDOW_MIN,
              keep: int = 10) -> DataFrame:
    """C-02 (long form): per incident and metric, the first `keep` values in the window before
    detection, in time order: (incident_id, metric_name, pos, metric_value)."""
    m = metrics.select(F.col("source_service").alias("m_service"), "metric_name", "metric_value",
                       F.col("ts").alias("m_ts"), F.col("event_id").alias("m_event_id"))
    series = m.select("m_service", "metric_name").distinct().toDF("s_service", "s_metric")  # one row a series
    asked = _anoms(anoms).join(series, F.col("source_service") == F.col("s_service"))
    found = first_rows(asked, m, point_keys=["s_service", "s_metric"], row_keys=["m_service", "metric_name"], point_ts="detection_time",
                       row_ts="m_ts", tie="m_event_id", before_ms=int(minutes * MIN), keep=keep)
    return found.select("incident_id", "metric_name", "pos", "metric_value")


def window_peak(anoms: DataFrame, metrics: DataFrame, *, metric: str, minutes: float, out: str) -> DataFrame:
    """Max of one metric of the service over the whole window before detection, by bucket maxima."""
    m = (metrics.where(F.col("metric_name") == metric)
                .select(F.col("source_service").alias("p_service"), F.col("ts").alias("p_ts"), "metric_value"))
    a = _anoms(anoms).withColumn("__from", F.col("detection_time") - int(minutes * MIN))
    return range_max(a, m, ids=["incident_id"], point_keys=["source_service"], row_keys=["p_service"], start="__from", end="detection_time",
                     row_ts="p_ts", value="metric_value", out=out, span_ms=int(minutes * MIN))


def telemetry_map(long_form: DataFrame) -> DataFrame:
    """C-02 (map form): incident_id -> map(metric -> values in time order)."""
    per_metric = long_form.groupBy("incident_id", "metric_name").agg(
        F.sort_array(F.collect_list(F.struct("pos", "metric_value"))).alias("vals"))
    per_metric = per_metric.select("incident_id", "metric_name",
                                   F.transform("vals", lambda v: v["metric_value"]).alias("values"))
    return per_metric.groupBy("incident_id").agg(
        F.map_from_entries(F.collect_list(F.struct("metric_name", "values"))).alias("recent_metrics"))


def recent_errors(anoms: DataFrame, logs: DataFrame, *, minutes: float = K.CORRELATION_WINDOW_MIN,
                  n: int = 20) -> DataFrame:
    """C-03: ERROR/FATAL messages of the service in the window, first n in time order (long form)."""
    lg = (logs.where(F.col("level").isin("ERROR", "FATAL"))
              .select(F.col("source_service").alias("l_service"), "message", F.col("ts").alias("l_ts"),
                      F.col("event_id").alias("l_event_id")))
    found = first_rows(_anoms(anoms), lg, point_keys=["source_service"], row_keys=["l_service"], point_ts="detection_time", row_ts="l_ts",
                       tie="l_event_id", before_ms=int(minutes * MIN), keep=n)
    return found.select("incident_id", "pos", "message")


def recent_deployments(anoms: DataFrame, deploys: DataFrame, *, minutes: float = K.DEPLOY_WINDOW_MIN) -> DataFrame:
    """C-04: deployments of the service in [t - window, t], newest first (rank 1 = newest; id tie-break)."""
    d = deploys.select(F.col("id").alias("deployment_id"), F.col("service_name").alias("d_service"), "version",
                       "change_type", "known_risks", "deployed_at")
    j = range_join(_anoms(anoms), d, left_keys=["source_service"], right_keys=["d_service"],
                   left_ts="detection_time", right_ts="deployed_at", before_ms=int(minutes * MIN))
    w = Window.partitionBy("incident_id").orderBy(F.col("deployed_at").desc(), F.col("deployment_id").desc())
    return j.withColumn("rank", F.row_number().over(w).cast("long")).drop("d_service")


def asof_deployment(anoms: DataFrame, deploys: DataFrame, *, minutes: float = K.DEPLOY_WINDOW_MIN) -> DataFrame:
    """C-05: the latest deployment of the service within the window before detection."""
    return recent_deployments(anoms, deploys, minutes=minutes).where(F.col("rank") == 1).drop("rank")


def deployment_confidence(df: DataFrame, *, span_min: float = K.DEPLOY_WINDOW_MIN,
                          risk_bonus: float = 0.15) -> DataFrame:
    """C-06: max(0, 1 - delta_min/span), + bonus when risks are known, cap 1, round 3."""
    delta = (F.col("detection_time") - F.col("deployed_at")) / F.lit(float(MIN))
    conf = F.greatest(F.lit(0.0), F.lit(1.0) - delta / F.lit(float(span_min)))
    conf = F.when(F.size("known_risks") > 0, F.least(F.lit(1.0), conf + F.lit(risk_bonus))).otherwise(conf)
    return (df.withColumn("correlation_confidence_raw", conf)
              .withColumn("correlation_confidence", F.round(conf, 3))
              .withColumn("time_delta_minutes", delta.cast("long")))


def downstream(registry: DataFrame) -> DataFrame:
    """C-07: first-degree downstream services, in list order."""
    return registry.select("service_name", F.posexplode("downstream_services").alias("pos", "downstream"))\
                   .withColumn("pos", F.col("pos").cast("long"))


def upstream_of(registry: DataFrame) -> DataFrame:
    """C-08: for every service X, the services whose downstream list holds X."""
    d = downstream(registry)
    return d.select(F.col("downstream").alias("service_name"), F.col("service_name").alias("dependent"))


def cascade(anoms: DataFrame, registry: DataFrame, metrics: DataFrame, *,
            minutes: float = K.CORRELATION_WINDOW_MIN, max_deps: int = 5, limit: float = 5.0) -> DataFrame:
    """C-09: of the first `max_deps` downstreams, those whose max error rate in the window is > limit.
    Only error-rate rows are joined and they are reduced to one max per (incident, downstream)."""
    deps = downstream(registry).where(F.col("pos") < max_deps)
    a = _anoms(anoms).join(deps, F.col("source_service") == deps.service_name)\
                     .drop("service_name")
    er = (metrics.where(F.col("metric_name") == "service_error_rate_percent")
                 .select(F.col("source_service").alias("e_service"), F.col("ts").alias("e_ts"), "metric_value"))
    a = a.withColumn("__from", F.col("detection_time") - int(minutes * MIN))
    peak = range_max(a, er, ids=["incident_id", "downstream", "pos"], point_keys=["downstream"], row_keys=["e_service"], start="__from",
                     end="detection_time", row_ts="e_ts", value="metric_value", out="peak_error_rate", span_ms=int(minutes * MIN))
    return peak.where(F.col("peak_error_rate") > limit)


def cascade_lists(casc: DataFrame) -> DataFrame:
    """Cascade services per incident in downstream-list order."""
    return casc.groupBy("incident_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "downstream"))), lambda s: s["downstream"])
        .alias("cascade"))


def _tier_text(crit: Column, table, unknown: str) -> Column:
    out = F.lit(unknown)
    for tier, text in reversed(table):
        out = F.when(crit == tier, F.lit(text)).otherwise(out)
    return out


def blast_radius(df: DataFrame, registry: DataFrame) -> DataFrame:
    """C-10: affected = [service] + cascade; criticality from the registry (P1 when absent); impact text by tier.
    `df` has incident_id, source_service, cascade (array, may be null). The registry is a bounded dimension."""
    reg = registry.select(F.col("service_name").alias("__svc"), "criticality")
    j = df.join(reg, F.col("source_service") == F.col("__svc"), "left").drop("__svc")
    crit = F.coalesce(F.col("criticality"), F.lit(K.DEFAULT_CRITICALITY))
    return j.select(
        "*",
        F.concat(F.array("source_service"), F.coalesce(F.col("cascade"), F.array().cast("array<string>")))
        .alias("blast_affected"),
        crit.alias("primary_service_criticality"),
        _tier_text(crit, K.USER_IMPACT, K.UNKNOWN_USER_IMPACT).alias("estimated_user_impact"),
        _tier_text(crit, K.REVENUE_IMPACT, K.UNKNOWN_REVENUE_IMPACT).alias("estimated_revenue_impact"),
    ).drop("criticality")


_SIGNAL = "struct<signal_type:string,strength:double,description:string,evidence:array<string>>"


def signal_temporal() -> Column:
    """C-11: deployment proximity when confidence > 0.3 (needs deployment columns)."""
    ev = F.concat(
        F.array(F.concat(F.lit("Version: "), F.col("version")), F.concat(F.lit("Change type: "), F.col("change_type"))),
        F.transform(F.slice(F.coalesce(F.col("known_risks"), F.array().cast("array<string>")), 1, 3),
                    lambda r: F.concat(F.lit("Risk: "), r)))
    s = F.struct(
        F.lit("TEMPORAL_PROXIMITY").alias("signal_type"),
        F.col("correlation_confidence").cast("double").alias("strength"),
        F.concat(F.lit("Deployment "), F.col("deployment_service"), F.lit(" "), F.col("version"), F.lit(" "),
                 F.col("time_delta_minutes").cast("string"), F.lit(" minutes before anomaly onset")).alias("description"),
        ev.alias("evidence"))
    return F.when(F.col("correlation_confidence") > 0.3, s)


def signal_cascade() -> Column:
    """C-12: strength min(.9, .5 + .1 n)."""
    n = F.size("cascade")
    s = F.struct(
        F.lit("DEPENDENCY_CASCADE").alias("signal_type"),
        F.least(F.lit(0.9), F.lit(0.5) + F.lit(0.1) * n).alias("strength"),
        F.concat(F.lit("Downstream services showing degradation: "), F.array_join("cascade", ", ")).alias("description"),
        F.transform("cascade", lambda c: F.concat(F.lit("Affected: "), c)).alias("evidence"))
    return F.when(F.col("cascade").isNotNull() & (n > 0), s)


def signal_resource() -> Column:
    """C-13: DB connections peak > 80 (format %.0f, half-even like Python)."""
    peak = F.col("db_peak")
    txt = F.bround(peak, 0).cast("long").cast("string")
    s = F.struct(
        F.lit("RESOURCE_CONTENTION").alias("signal_type"),
        F.lit(0.7).alias("strength"),
        F.concat(F.lit("DB connection pool near saturation: "), txt, F.lit(" connections")).alias("description"),
        F.array(F.concat(F.lit("Peak connections: "), txt)).alias("evidence"))
    return F.when(peak > 80, s)


def signal_errors() -> Column:
    """C-14: >= 3 recent errors, strength min(.9, .4 + .05 n)."""
    n = F.size("recent_errors")
    s = F.struct(
        F.lit("ERROR_AMPLIFICATION").alias("signal_type"),
        F.least(F.lit(0.9), F.lit(0.4) + F.lit(0.05) * n).alias("strength"),
        F.concat(n.cast("string"), F.lit(" error log events in the correlation window")).alias("description"),
        F.slice("recent_errors", 1, 3).alias("evidence"))
    return F.when(F.col("recent_errors").isNotNull() & (n >= 3), s)


def signals_col() -> Column:
    """C-15: the present signals, in the fixed order temporal, cascade, resource, errors."""
    arr = F.array(signal_temporal().cast(_SIGNAL), signal_cascade().cast(_SIGNAL),
                  signal_resource().cast(_SIGNAL), signal_errors().cast(_SIGNAL))
    return F.filter(arr, lambda s: s.isNotNull())


def affected_col() -> Column:
    """C-16: {service} union cascade, as a sorted set."""
    return F.array_sort(F.array_distinct(F.concat(F.array("source_service"),
                                                  F.coalesce(F.col("cascade"), F.array().cast("array<string>")))))


def recovery(anoms: DataFrame, metrics: DataFrame, *, n: int = 3, tol: float = 0.30,
             limit_min: float = 30, bucket_s: float = 86400) -> DataFrame:
    """F-04: watch the trigger metric after detection; recovered at the first sample (within the limit)
    where the mean of the last n values of the series is within tol of the baseline (a null or zero baseline
    stands for that mean itself, so the first full window recovers); otherwise resolved by timeout at detection + limit. One window over each series, one range join."""
    from emberwatch.operators.detect import series_stats

    # the last-n mean per series, split by time bucket with a halo (no gap resets: one segment)
    m = (series_stats(metrics, gap_s=1e15, size=n, min_samples=n, pcts=(), bucket_s=bucket_s, current=True)
                .select(F.col("source_service").alias("r_service"), F.col("metric_name").alias("r_metric"),
                        F.col("ts").alias("r_ts"), "recent_mean", "recent_n"))
    a = anoms.select("incident_id", "source_service", "trigger_metric", "detection_time", "baseline_value")
    j = range_join(a, m, left_keys=["source_service", "trigger_metric"], right_keys=["r_service", "r_metric"],
                   left_ts="detection_time", right_ts="r_ts", before_ms=0, after_ms=int(limit_min * MIN),
                   lower_inclusive=False)
    base = F.when(F.coalesce(F.col("baseline_value"), F.lit(0.0)) == 0, F.col("recent_mean")).otherwise(F.col("baseline_value"))
    ok = (F.col("recent_n") >= n) & (base > 0) & (F.abs(F.col("recent_mean") - base) / base < tol)
    hit = j.where(ok).groupBy("incident_id").agg(F.min("r_ts").alias("recovered_at"))
    out = a.join(hit, "incident_id", "left")
    return out.select(
        "incident_id", "source_service", "trigger_metric", "detection_time",
        F.coalesce(F.col("recovered_at"), F.col("detection_time") + F.lit(int(limit_min * MIN))).alias("resolved_at"),
        F.col("recovered_at").isNotNull().alias("recovered"),
    )


def incident_lock(anoms: DataFrame, recoveries: DataFrame | None = None, *, ttl_s: float = K.INCIDENT_LOCK_S) -> DataFrame:
    """C-01: one open incident per service; an admitted anomaly locks its service until
    min(detection + ttl, its resolution). Resolution is computed for every candidate first (it does
    not depend on the lock), then the D-06 fold runs with that per-row lock end."""
    a = anoms
    if recoveries is not None:
        rec = recoveries.select("incident_id", F.col("resolved_at").alias("__released"))
        a = a.join(rec, "incident_id", "left")
        a = a.withColumn("__until", F.least(F.col("detection_time") + F.lit(int(ttl_s * 1000)),
                                            F.coalesce(F.col("__released"), F.col("detection_time")
                                                       + F.lit(int(ttl_s * 1000)))))
        kept = suppress(a, keys=["source_service"], ts="detection_time", tie="incident_id", until="__until",
                        ttl_s=ttl_s)
        return kept.drop("__released", "__until")
    return suppress(a, keys=["source_service"], ts="detection_time", tie="incident_id", ttl_s=ttl_s)


def correlate(anoms: DataFrame, metrics: DataFrame, logs: DataFrame, deploys: DataFrame, registry: DataFrame, *,
              minutes: float = K.CORRELATION_WINDOW_MIN, deploy_minutes: float = K.DEPLOY_WINDOW_MIN,
              lock_s: float = K.INCIDENT_LOCK_S, recovery_min: float = 30, errors_kept: int = 5) -> DataFrame:
    """C-17: anomalies -> opened incidents with signals, blast radius, deployment context, telemetry."""
    from emberwatch.session import materialize

    # anomalies are a small fraction of the telemetry: compute them once and cut the lineage, so the
    # branches below neither recompute nor re-analyse the detection plan
    anoms = materialize(anoms)
    rec = recovery(anoms, metrics, limit_min=recovery_min)
    adm = incident_lock(anoms, rec, ttl_s=lock_s)
    base = materialize(adm.select("incident_id", "anomaly_type", "severity", "source_service", "detection_time"))

    tel = telemetry(base, metrics, minutes=minutes)
    tmap = telemetry_map(tel)
    db_peak = window_peak(base, metrics, metric="service_db_connections", minutes=minutes, out="db_peak")
    errs = recent_errors(base, logs, minutes=minutes).groupBy("incident_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "message"))), lambda s: s["message"])
        .alias("recent_errors"))
    dep = deployment_confidence(asof_deployment(base, deploys, minutes=deploy_minutes), span_min=deploy_minutes)
    dep = dep.select("incident_id", "deployment_id", F.col("source_service").alias("deployment_service"), "version",
                     "change_type", "known_risks", "deployed_at", "correlation_confidence", "time_delta_minutes")
    casc = cascade_lists(cascade(base, registry, metrics, minutes=minutes))

    j = (base.join(tmap, "incident_id", "left").join(db_peak, "incident_id", "left")
             .join(errs, "incident_id", "left").join(dep, "incident_id", "left")
             .join(casc, "incident_id", "left"))
    j = blast_radius(j, registry)
    return j.select(
        "incident_id", "anomaly_type", "severity", "source_service", "detection_time",
        affected_col().alias("affected_services"),
        signals_col().alias("correlation_signals"),
        F.struct(F.col("blast_affected").alias("affected_services"), "primary_service_criticality",
                 "estimated_user_impact", "estimated_revenue_impact").alias("blast_radius"),
        F.when(F.col("deployment_id").isNotNull(),
               F.struct("deployment_id", F.col("deployment_service").alias("service_name"), "version",
                        "deployed_at", "change_type", "correlation_confidence", "time_delta_minutes",
                        "known_risks")).alias("deployment_context"),
        "recent_metrics",
        F.slice(F.coalesce(F.col("recent_errors"), F.array().cast("array<string>")), 1, errors_kept)
        .alias("recent_errors"),
        F.coalesce(F.col("cascade"), F.array().cast("array<string>")).alias("cascade"),
    )
