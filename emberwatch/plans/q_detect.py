"""Registered detection queries (D-01..D-13, I-05, I-06) with DuckDB twins.

Durations use the test values for the generated tables (FIXTURES.md §3): events there are spaced
minutes to hours apart, so the reference's seconds-scale windows would select nothing.
"""

from __future__ import annotations

from emberwatch import constants as K
from emberwatch.operators import detect as D
from emberwatch.operators.suppress import suppress, suppress_sql
from emberwatch.plans.catalog import DURATION_DIV, register
from emberwatch.sources import adapters as A

H = 3600 // DURATION_DIV
GAP_S = 12 * H          # baseline gap (reference 3600 s)
TTL_S = 24 * H          # dedup TTL (reference 300 s)
SAMPLE_TTL_S = 2 * H    # sample dedup (reference 14 s)
BURST_GAP_S = 2 * H     # burst counter gap (reference 60 s)
HOLD_SCALE = 6 * H / 60  # 1-2 min alert holds become 6-12 h

_METRIC_LIST = ", ".join(f"'{m}'" for m in K.METRIC_NAMES)
_SER = "PARTITION BY source_service, metric_name"
_ORD = "ORDER BY ts, event_id"


def _seg_sql(gap_s: float, src: str = "metrics") -> str:
    return f"""SELECT * EXCLUDE (__prev), sum(CASE WHEN __prev IS NULL OR ts - __prev >= {int(gap_s * 1000)}
               THEN 1 ELSE 0 END) OVER ({_SER} {_ORD} ROWS UNBOUNDED PRECEDING)::BIGINT AS segment
        FROM (SELECT *, lag(ts) OVER ({_SER} {_ORD}) AS __prev FROM {src}
              WHERE metric_name IN ({_METRIC_LIST}))"""


def _stats_sql(gap_s: float) -> str:
    w = f"PARTITION BY source_service, metric_name, segment {_ORD}"
    pct = ", ".join(
        f"__win[least(floor(len(__win) * {p} / 100), len(__win) - 1)::BIGINT + 1] AS p{p}_value" for p in (50, 95, 99))
    return f"""SELECT * EXCLUDE (__win),
            CASE WHEN n_prior < {K.MIN_SAMPLES} THEN 0.0 WHEN coalesce(baseline_std, 0.0) < 1e-9 THEN 0.0
                 ELSE (metric_value - baseline_mean) / baseline_std END AS zscore, {pct}
        FROM (SELECT *, count(metric_value) OVER w1 AS n_prior, avg(metric_value) OVER w1 AS baseline_mean,
                     stddev_pop(metric_value) OVER w1 AS baseline_std,
                     list_sort(list(metric_value) OVER w0) AS __win
              FROM ({_seg_sql(gap_s)})
              WINDOW w1 AS ({w} ROWS BETWEEN 49 PRECEDING AND 1 PRECEDING),
                     w0 AS ({w} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))"""


def _severity_sql(metric: str, z: str) -> str:
    crit = " ".join(f"WHEN {metric} = '{m}' THEN {c}" for m, c, _ in K.SEVERITY_THRESHOLDS)
    high = " ".join(f"WHEN {metric} = '{m}' THEN {h}" for m, _, h in K.SEVERITY_THRESHOLDS)
    return (f"(CASE WHEN {z} >= (CASE {crit} ELSE {K.DEFAULT_CRITICAL_SIGMA} END) THEN 'CRITICAL' "
            f"WHEN {z} >= (CASE {high} ELSE {K.DEFAULT_HIGH_SIGMA} END) THEN 'HIGH' ELSE 'MEDIUM' END)")


def _type_sql(metric: str) -> str:
    cases = " ".join(f"WHEN {metric} = '{m}' THEN '{t}'" for m, t, _ in K.MONITORED_METRICS)
    return f"(CASE {cases} ELSE 'UNKNOWN' END)"


def _spikes_sql(gap_s: float) -> str:
    return (f"SELECT *, {_type_sql('metric_name')} AS anomaly_type FROM ({_stats_sql(gap_s)}) "
            f"WHERE zscore >= {K.SIGMA_THRESHOLD} AND metric_name IN ({_METRIC_LIST})")


def _anomaly_select(window_ms: int = K.BASELINE_WINDOW * 10 * 1000) -> str:
    return f"""substr(sha256(concat_ws(':', source_service, metric_name, ts::VARCHAR)), 1, 32) AS incident_id,
        anomaly_type, {_severity_sql('metric_name', 'zscore')} AS severity, source_service,
        [source_service] AS affected_services, ts AS detection_time, metric_name AS trigger_metric,
        metric_value AS observed_value, baseline_mean AS baseline_value, zscore AS deviation_sigma,
        least(1.0::DOUBLE, zscore / 10.0) AS anomaly_score, p50_value, p95_value, p99_value,
        ts - {window_ms} AS window_start, ts AS window_end,
        printf('%s deviation: %.1fσ above baseline', metric_name, round(zscore, 1)) AS description"""


def anomalies_body(gap_s: float, ttl_s: float) -> str:
    """D-13 as SQL over a `metrics` CTE."""
    kept = suppress_sql(_spikes_sql(gap_s), keys=["source_service", "anomaly_type", "metric_name"],
                        tie="event_id", ttl_ms=int(ttl_s * 1000))
    return f"SELECT {_anomaly_select()} FROM {kept}"


def detect_sql(gap_s: float, ttl_s: float) -> str:
    return A.with_adapters(anomalies_body(gap_s, ttl_s), "metrics")


_ANOM_DOUBLES = ("observed_value", "baseline_value", "deviation_sigma", "anomaly_score",
                 "p50_value", "p95_value", "p99_value")


def _metrics_stats(spark, sf, **how):
    m = A.metrics(spark, sf).where(D.F.col("metric_name").isin(K.METRIC_NAMES))
    return D.series_stats(m, gap_s=GAP_S, **how)


@register("d01_segments", A.with_adapters(
    f"SELECT event_id, source_service, metric_name, ts, segment FROM ({_seg_sql(GAP_S)})", "metrics"))
def q_segments(spark, sf):
    return _metrics_stats(spark, sf, number=True).select("event_id", "source_service", "metric_name", "ts", "segment")


@register("d02_baseline", A.with_adapters(
    f"SELECT event_id, n_prior, baseline_mean, baseline_std FROM ({_stats_sql(GAP_S)})", "metrics"),
    doubles=("baseline_mean", "baseline_std"))
def q_baseline(spark, sf):
    return _metrics_stats(spark, sf).select("event_id", "n_prior", "baseline_mean", "baseline_std")


@register("d03_zscore", A.with_adapters(
    f"SELECT event_id, source_service, metric_name, zscore FROM ({_stats_sql(GAP_S)})", "metrics"),
    doubles=("zscore",))
def q_zscore(spark, sf):
    return _metrics_stats(spark, sf).select("event_id", "source_service", "metric_name", "zscore")


@register("d04_spikes", A.with_adapters(
    f"SELECT event_id, source_service, metric_name, ts, metric_value, zscore FROM ({_spikes_sql(GAP_S)})",
    "metrics"), doubles=("zscore",))
def q_spikes(spark, sf):
    return D.spikes(_metrics_stats(spark, sf)).select("event_id", "source_service", "metric_name", "ts",
                                                     "metric_value", "zscore")


@register("d05_severity", A.with_adapters(
    f"SELECT event_id, metric_name, zscore, {_severity_sql('metric_name', 'zscore')} AS severity "
    f"FROM ({_spikes_sql(GAP_S)})", "metrics"), doubles=("zscore",))
def q_severity(spark, sf):
    return D.severity(D.spikes(_metrics_stats(spark, sf))).select("event_id", "metric_name", "zscore", "severity")


@register("d06_suppress", A.with_adapters(
    "SELECT event_id, source_service, anomaly_type, metric_name, ts FROM "
    + suppress_sql(_spikes_sql(GAP_S), keys=["source_service", "anomaly_type", "metric_name"], tie="event_id",
                   ttl_ms=TTL_S * 1000), "metrics"))
def q_suppress(spark, sf):
    s = D.spikes(_metrics_stats(spark, sf)).withColumn("anomaly_type", D.default_type_col("metric_name"))
    s = s.select("event_id", "source_service", "anomaly_type", "metric_name", "ts")
    return suppress(s, keys=["source_service", "anomaly_type", "metric_name"], tie="event_id", ttl_s=TTL_S)


@register("d07_percentiles", A.with_adapters(
    f"SELECT event_id, p50_value, p95_value, p99_value FROM ({_stats_sql(GAP_S)})", "metrics"),
    doubles=("p50_value", "p95_value", "p99_value"))
def q_percentiles(spark, sf):
    return _metrics_stats(spark, sf).select("event_id", "p50_value", "p95_value", "p99_value")


@register("d08_anomaly_score", A.with_adapters(
    f"SELECT event_id, least(1.0::DOUBLE, zscore / 10.0) AS anomaly_score FROM ({_spikes_sql(GAP_S)})", "metrics"),
    doubles=("anomaly_score",))
def q_score(spark, sf):
    from emberwatch.functions.columns import anomaly_score
    return D.spikes(_metrics_stats(spark, sf)).select("event_id", anomaly_score("zscore").alias("anomaly_score"))


@register("d09_default_type", A.with_adapters(
    f"SELECT metric_name, {_type_sql('metric_name')} AS anomaly_type, count(*) AS n FROM metrics GROUP BY 1, 2",
    "metrics"))
def q_default_type(spark, sf):
    return (A.metrics(spark, sf).groupBy("metric_name").count()
            .select("metric_name", D.default_type_col("metric_name").alias("anomaly_type"), D.F.col("count").alias("n")))


def _bursts_sql(gap_s: float, ttl_s: float) -> str:
    gap = int(gap_s * 1000)
    err = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_service, burst ORDER BY ts, event_id)::BIGINT
                AS error_count FROM (SELECT * EXCLUDE (__prev), sum(CASE WHEN __prev IS NULL OR ts - __prev >= {gap}
                THEN 1 ELSE 0 END) OVER (PARTITION BY source_service ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
                AS burst FROM (SELECT *, lag(ts) OVER (PARTITION BY source_service ORDER BY ts, event_id) AS __prev
                FROM logs WHERE level IN ('ERROR', 'FATAL')))) WHERE error_count >= {K.BURST_COUNT}"""
    kept = suppress_sql(err, keys=["source_service"], tie="event_id", ttl_ms=int(ttl_s * 1000))
    return A.with_adapters(f"""SELECT source_service, ts AS detection_time, 'ERROR_RATE_SPIKE' AS anomaly_type,
        CASE WHEN level = 'ERROR' THEN 'HIGH' ELSE 'CRITICAL' END AS severity, 'log_error_burst' AS trigger_metric,
        {K.BURST_SCORE}::DOUBLE AS anomaly_score, error_count,
        'Log error burst detected: ' || error_count::VARCHAR || ' errors in 60s. Latest: ' || substr(message, 1, 100)
            AS description FROM {kept}""", "logs")


@register("d10_log_bursts", _bursts_sql(BURST_GAP_S, TTL_S), doubles=("anomaly_score",))
def q_log_bursts(spark, sf):
    return D.log_bursts(A.logs(spark, sf), gap_s=BURST_GAP_S, ttl_s=TTL_S)


def _rules_sql() -> str:
    rows = ", ".join(f"('{m}', {lim}::DOUBLE, {h}::BIGINT, '{a}')" for m, lim, h, a in K.ALERT_RULES)
    return f"SELECT * FROM (VALUES {rows}) AS t(metric_name, \"limit\", hold_s, alert)"


@register("d12_sustained_alerts", A.with_adapters(f"""
    SELECT source_service, metric_name, alert, start_ts, end_ts, samples, peak_value,
           start_ts + (hold_s * {1000 * HOLD_SCALE})::BIGINT AS fired_at
    FROM (SELECT source_service, metric_name, alert, island, hold_s, min(ts) AS start_ts, max(ts) AS end_ts,
                 count(*) AS samples, max(metric_value) AS peak_value
          FROM (SELECT m.*, r.alert, r.hold_s, r."limit", m.metric_value > r."limit" AS __breach,
                       sum(CASE WHEN m.metric_value > r."limit" THEN 0 ELSE 1 END) OVER (
                           PARTITION BY m.source_service, m.metric_name ORDER BY m.ts, m.event_id
                           ROWS UNBOUNDED PRECEDING) AS island
                FROM metrics m JOIN ({_rules_sql()}) r USING (metric_name))
          WHERE __breach GROUP BY ALL)
    WHERE end_ts - start_ts >= hold_s * {1000 * HOLD_SCALE}""", "metrics"), doubles=("peak_value",))
def q_sustained(spark, sf):
    return D.sustained_alerts(A.metrics(spark, sf), D.alert_rules(spark), hold_scale=HOLD_SCALE)


@register("d13_detect", detect_sql(GAP_S, TTL_S), doubles=_ANOM_DOUBLES, bench=True)
def q_detect(spark, sf):
    return D.detect(A.metrics(spark, sf), gap_s=GAP_S, ttl_s=TTL_S)


@register("i05_dedup_samples", A.with_adapters(
    "SELECT event_id, source_service, metric_name, ts FROM "
    + suppress_sql("SELECT event_id, source_service, metric_name, ts FROM metrics",
                   keys=["source_service", "metric_name"], tie="event_id", ttl_ms=SAMPLE_TTL_S * 1000), "metrics"))
def q_dedup_samples(spark, sf):
    m = A.metrics(spark, sf).select("event_id", "source_service", "metric_name", "ts")
    return suppress(m, keys=["source_service", "metric_name"], tie="event_id", ttl_s=SAMPLE_TTL_S)
