"""Registered correlation and recovery queries (C-01..C-17, F-04, F-06) with DuckDB twins.

Inputs: anomalies from D-13 at the test durations, the metric/log/deployment adapters and the
registry. Test windows: telemetry 24 h (ref. 30 min), deployments 24 h with decay over 24 h
(ref. 60 min), incident lock 72 h (ref. 1,800 s), recovery limit 24 h (ref. 30 min).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from emberwatch.operators import correlate as C
from emberwatch.operators import detect as D
from emberwatch.operators.serve import mttr_col
from emberwatch.operators.suppress import suppress_sql
from emberwatch.plans.catalog import DURATION_DIV, register
from emberwatch.plans.q_detect import GAP_S, TTL_S, anomalies_body
from emberwatch.sources import adapters as A

WIN_MIN = 24 * 60 // DURATION_DIV
DEP_MIN = 24 * 60 // DURATION_DIV
LOCK_S = 72 * 3600 // DURATION_DIV
REC_MIN = 24 * 60 // DURATION_DIV
W = WIN_MIN * 60_000
DW = DEP_MIN * 60_000
REC = REC_MIN * 60_000
LOCK = LOCK_S * 1000

_ADAPTERS = ("metrics", "logs", "deployments", "registry")


def _sql(body: str, **extra: str) -> str:
    ctes = {"anoms": anomalies_body(GAP_S, TTL_S)}
    ctes.update(extra)
    return A.with_adapters(body, *_ADAPTERS, extra=ctes)


def _anoms(spark, sf):
    return D.detect(A.metrics(spark, sf), gap_s=GAP_S, ttl_s=TTL_S)


# ---------------------------------------------------------------- SQL builders (parameterised by source CTE)

def tel_sql(src: str) -> str:
    return f"""SELECT incident_id, metric_name, pos, metric_value FROM (
        SELECT a.incident_id, m.metric_name, m.metric_value,
               row_number() OVER (PARTITION BY a.incident_id, m.metric_name ORDER BY m.ts, m.event_id)::BIGINT AS pos
        FROM {src} a JOIN metrics m ON m.source_service = a.source_service
             AND m.ts >= a.detection_time - {W} AND m.ts <= a.detection_time) WHERE pos <= 10"""


def err_sql(src: str, n: int = 20) -> str:
    return f"""SELECT incident_id, pos, message FROM (
        SELECT a.incident_id, l.message,
               row_number() OVER (PARTITION BY a.incident_id ORDER BY l.ts, l.event_id)::BIGINT AS pos
        FROM {src} a JOIN logs l ON l.source_service = a.source_service AND l.level IN ('ERROR', 'FATAL')
             AND l.ts >= a.detection_time - {W} AND l.ts <= a.detection_time) WHERE pos <= {n}"""


def dep_sql(src: str) -> str:
    return f"""SELECT a.incident_id, a.source_service, a.detection_time, d.id AS deployment_id, d.version,
            d.change_type, d.known_risks, d.deployed_at,
            row_number() OVER (PARTITION BY a.incident_id ORDER BY d.deployed_at DESC, d.id DESC)::BIGINT AS rank
        FROM {src} a JOIN deployments d ON d.service_name = a.source_service
             AND d.deployed_at >= a.detection_time - {DW} AND d.deployed_at <= a.detection_time"""


def conf_sql(src: str) -> str:
    delta = "((detection_time - deployed_at) / 60000.0)"
    base = f"greatest(0.0::DOUBLE, 1.0::DOUBLE - {delta} / {float(DEP_MIN)})"
    return f"""SELECT *, conf AS correlation_confidence_raw, round(conf, 3) AS correlation_confidence,
            trunc({delta})::BIGINT AS time_delta_minutes
        FROM (SELECT * EXCLUDE (rank), CASE WHEN len(known_risks) > 0 THEN least(1.0::DOUBLE, {base} + 0.15::DOUBLE)
                     ELSE {base} END AS conf
              FROM ({dep_sql(src)}) WHERE rank = 1)"""


def _down_sql(source: str) -> str:
    return f"""SELECT service_name, (pos - 1)::BIGINT AS pos, downstream FROM (
    SELECT service_name, unnest(downstream_services) AS downstream,
           unnest(generate_series(1, len(downstream_services))) AS pos FROM {source})"""


_DOWN_SQL = _down_sql("registry")


def casc_sql(src: str) -> str:
    return f"""SELECT a.incident_id, dd.downstream, dd.pos, max(m.metric_value) AS peak_error_rate
        FROM {src} a JOIN ({_DOWN_SQL}) dd ON dd.service_name = a.source_service AND dd.pos < 5
        JOIN metrics m ON m.source_service = dd.downstream AND m.metric_name = 'service_error_rate_percent'
             AND m.ts >= a.detection_time - {W} AND m.ts <= a.detection_time
        GROUP BY a.incident_id, dd.downstream, dd.pos HAVING max(m.metric_value) > 5.0"""


def casc_list_sql(src: str) -> str:
    return f"SELECT incident_id, list(downstream ORDER BY pos) AS cascade FROM ({casc_sql(src)}) GROUP BY 1"


def dbpeak_sql(src: str) -> str:
    return f"""SELECT a.incident_id, max(m.metric_value) AS db_peak FROM {src} a JOIN metrics m
        ON m.source_service = a.source_service AND m.metric_name = 'service_db_connections'
        AND m.ts >= a.detection_time - {W} AND m.ts <= a.detection_time GROUP BY 1"""


def errlist_sql(src: str) -> str:
    return f"SELECT incident_id, list(message ORDER BY pos) AS errs FROM ({err_sql(src)}) GROUP BY 1"


def signals_sql(src: str) -> str:
    """Long form (incident_id, ord, signal_type, strength, description, evidence)."""
    return f"""
        SELECT incident_id, 1 AS ord, 'TEMPORAL_PROXIMITY' AS signal_type, correlation_confidence AS strength,
               'Deployment ' || source_service || ' ' || version || ' ' || time_delta_minutes::VARCHAR
                   || ' minutes before anomaly onset' AS description,
               array_to_string(list_concat(['Version: ' || version, 'Change type: ' || change_type],
                   list_transform(known_risks[1:3], lambda r: 'Risk: ' || r)), '|') AS evidence
        FROM ({conf_sql(src)}) WHERE correlation_confidence > 0.3
        UNION ALL
        SELECT incident_id, 2, 'DEPENDENCY_CASCADE', least(0.9::DOUBLE, 0.5::DOUBLE + 0.1::DOUBLE * len(cascade)),
               'Downstream services showing degradation: ' || array_to_string(cascade, ', '),
               array_to_string(list_transform(cascade, lambda c: 'Affected: ' || c), '|')
        FROM ({casc_list_sql(src)}) WHERE len(cascade) > 0
        UNION ALL
        SELECT incident_id, 3, 'RESOURCE_CONTENTION', 0.7::DOUBLE,
               'DB connection pool near saturation: ' || round_even(db_peak, 0)::BIGINT::VARCHAR || ' connections',
               'Peak connections: ' || round_even(db_peak, 0)::BIGINT::VARCHAR
        FROM ({dbpeak_sql(src)}) WHERE db_peak > 80
        UNION ALL
        SELECT incident_id, 4, 'ERROR_AMPLIFICATION', least(0.9::DOUBLE, 0.4::DOUBLE + 0.05::DOUBLE * len(errs)),
               len(errs)::VARCHAR || ' error log events in the correlation window', array_to_string(errs[1:3], '|')
        FROM ({errlist_sql(src)}) WHERE len(errs) >= 3"""


_RM_SQL = """SELECT source_service, metric_name, ts, avg(metric_value) OVER w AS recent_mean,
        count(metric_value) OVER w AS recent_n FROM metrics
        WINDOW w AS (PARTITION BY source_service, metric_name ORDER BY ts, event_id
                     ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""


def rec_sql(src: str) -> str:
    return f"""SELECT a.incident_id, a.source_service, a.trigger_metric, a.detection_time,
            coalesce(min(r.ts), a.detection_time + {REC}) AS resolved_at, min(r.ts) IS NOT NULL AS recovered
        FROM {src} a LEFT JOIN ({_RM_SQL}) r ON r.source_service = a.source_service
             AND r.metric_name = a.trigger_metric AND r.ts > a.detection_time AND r.ts <= a.detection_time + {REC}
             AND r.recent_n >= 3
             AND (CASE WHEN coalesce(a.baseline_value, 0) = 0 THEN r.recent_mean > 0 ELSE a.baseline_value > 0
                  AND abs(r.recent_mean - a.baseline_value) / a.baseline_value < 0.3 END)
        GROUP BY a.incident_id, a.source_service, a.trigger_metric, a.detection_time"""


def lock_sql(src: str) -> str:
    staged = f"""SELECT a.*, least(a.detection_time + {LOCK}, coalesce(r.resolved_at, a.detection_time + {LOCK}))
                    AS __until FROM {src} a LEFT JOIN ({rec_sql(src)}) r USING (incident_id)"""
    return suppress_sql(staged, keys=["source_service"], ts="detection_time", tie="incident_id", ttl_ms=0,
                        until="__until", select="* EXCLUDE (__until)")


# ---------------------------------------------------------------- registrations

@register("c01_incident_lock", _sql(f"SELECT incident_id, source_service, detection_time FROM {lock_sql('anoms')}"))
def q_lock(spark, sf):
    a = _anoms(spark, sf)
    rec = C.recovery(a, A.metrics(spark, sf), limit_min=REC_MIN)
    return C.incident_lock(a, rec, ttl_s=LOCK_S).select("incident_id", "source_service", "detection_time")


@register("c02_telemetry", _sql(tel_sql("anoms")), doubles=("metric_value",))
def q_telemetry(spark, sf):
    return C.telemetry(_anoms(spark, sf), A.metrics(spark, sf), minutes=WIN_MIN)


@register("c03_recent_errors", _sql(err_sql("anoms")))
def q_errors(spark, sf):
    return C.recent_errors(_anoms(spark, sf), A.logs(spark, sf), minutes=WIN_MIN)


@register("c04_recent_deployments", _sql(dep_sql("anoms")))
def q_recent_deploys(spark, sf):
    return C.recent_deployments(_anoms(spark, sf), A.deployments(spark, sf), minutes=DEP_MIN)


@register("c05_asof_deployment", _sql(f"SELECT * EXCLUDE (rank) FROM ({dep_sql('anoms')}) WHERE rank = 1"))
def q_asof(spark, sf):
    return C.asof_deployment(_anoms(spark, sf), A.deployments(spark, sf), minutes=DEP_MIN)


@register("c06_deployment_confidence", _sql(
    f"SELECT incident_id, deployment_id, correlation_confidence_raw, correlation_confidence, time_delta_minutes "
    f"FROM ({conf_sql('anoms')})"), doubles=("correlation_confidence_raw", "correlation_confidence"))
def q_conf(spark, sf):
    d = C.deployment_confidence(C.asof_deployment(_anoms(spark, sf), A.deployments(spark, sf), minutes=DEP_MIN),
                                span_min=DEP_MIN)
    return d.select("incident_id", "deployment_id", "correlation_confidence_raw", "correlation_confidence",
                    "time_delta_minutes")


@register("c07_downstream", A.with_adapters(_down_sql("service_catalog"), "edges", "service_catalog"))
def q_down(spark, sf):
    return C.downstream(A.service_catalog(spark, sf))


@register("c08_upstream_of", A.with_adapters(
    f"SELECT downstream AS service_name, service_name AS dependent FROM ({_down_sql('service_catalog')})", "edges", "service_catalog"))
def q_up(spark, sf):
    return C.upstream_of(A.service_catalog(spark, sf))


@register("c09_cascade", _sql(casc_sql("anoms")), doubles=("peak_error_rate",))
def q_cascade(spark, sf):
    return C.cascade(_anoms(spark, sf), A.registry(spark), A.metrics(spark, sf), minutes=WIN_MIN)


_TIER_USER = " ".join(f"WHEN '{t}' THEN '{x}'" for t, x in C.K.USER_IMPACT)
_TIER_REV = " ".join(f"WHEN '{t}' THEN '{x}'" for t, x in C.K.REVENUE_IMPACT)


@register("c10_blast_radius", _sql(f"""
    SELECT a.incident_id, list_concat([a.source_service], coalesce(c.cascade, []::VARCHAR[])) AS blast_affected,
           coalesce(r.criticality, 'P1') AS primary_service_criticality,
           CASE coalesce(r.criticality, 'P1') {_TIER_USER} ELSE '{C.K.UNKNOWN_USER_IMPACT}' END AS estimated_user_impact,
           CASE coalesce(r.criticality, 'P1') {_TIER_REV} ELSE '{C.K.UNKNOWN_REVENUE_IMPACT}' END
               AS estimated_revenue_impact
    FROM anoms a LEFT JOIN ({casc_list_sql('anoms')}) c USING (incident_id)
    LEFT JOIN registry r ON r.service_name = a.source_service"""))
def q_blast(spark, sf):
    a = _anoms(spark, sf)
    casc = C.cascade_lists(C.cascade(a, A.registry(spark), A.metrics(spark, sf), minutes=WIN_MIN))
    b = C.blast_radius(a.select("incident_id", "source_service").join(casc, "incident_id", "left"), A.registry(spark))
    return b.select("incident_id", "blast_affected", "primary_service_criticality", "estimated_user_impact",
                    "estimated_revenue_impact")


def _signal_frame(spark, sf):
    """Per-candidate inputs for the four signals."""
    a = _anoms(spark, sf)
    m = A.metrics(spark, sf)
    base = a.select("incident_id", "source_service", "detection_time")
    dep = C.deployment_confidence(C.asof_deployment(base, A.deployments(spark, sf), minutes=DEP_MIN),
                                  span_min=DEP_MIN)
    dep = dep.select("incident_id", F.col("source_service").alias("deployment_service"), "version", "change_type",
                     "known_risks", "correlation_confidence", "time_delta_minutes")
    casc = C.cascade_lists(C.cascade(base, A.registry(spark), m, minutes=WIN_MIN))
    dbp = C.window_peak(base, m, metric="service_db_connections", minutes=WIN_MIN, out="db_peak")
    errs = C.recent_errors(base, A.logs(spark, sf), minutes=WIN_MIN).groupBy("incident_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "message"))), lambda s: s["message"])
        .alias("recent_errors"))
    return (base.join(dep, "incident_id", "left").join(casc, "incident_id", "left")
                .join(dbp, "incident_id", "left").join(errs, "incident_id", "left"))


def _signals_long(spark, sf):
    s = _signal_frame(spark, sf).select("incident_id", F.posexplode(C.signals_col()).alias("i", "sig"))
    return s.select("incident_id", "sig.signal_type", "sig.strength", "sig.description",
                    F.array_join("sig.evidence", "|").alias("evidence"))


def _sig_query(kind: str | None):
    where = f"WHERE signal_type = '{kind}'" if kind else ""
    return _sql(f"SELECT incident_id, signal_type, strength, description, evidence FROM ({signals_sql('anoms')}) {where}")


for _name, _kind in (("c11_signal_temporal", "TEMPORAL_PROXIMITY"), ("c12_signal_cascade", "DEPENDENCY_CASCADE"),
                     ("c13_signal_resource", "RESOURCE_CONTENTION"), ("c14_signal_errors", "ERROR_AMPLIFICATION"),
                     ("c15_signals", None)):
    def _q(spark, sf, _k=_kind):
        out = _signals_long(spark, sf)
        return out.where(F.col("signal_type") == _k) if _k else out
    register(_name, _sig_query(_kind), doubles=("strength",))(_q)


@register("c16_affected", _sql(f"""
    SELECT a.incident_id, list_sort(list_distinct(list_concat([a.source_service], coalesce(c.cascade, []::VARCHAR[]))))
           AS affected_services
    FROM anoms a LEFT JOIN ({casc_list_sql('anoms')}) c USING (incident_id)"""))
def q_affected(spark, sf):
    a = _anoms(spark, sf)
    casc = C.cascade_lists(C.cascade(a, A.registry(spark), A.metrics(spark, sf), minutes=WIN_MIN))
    return a.select("incident_id", "source_service").join(casc, "incident_id", "left")\
            .select("incident_id", C.affected_col().alias("affected_services"))


def correlate_flat(df):
    """Scalar projection of C-17 output for comparison."""
    sig = F.col("correlation_signals")
    return df.select(
        "incident_id", "source_service", "detection_time", "affected_services",
        F.array_join(F.transform(sig, lambda s: s["signal_type"]), ",").alias("signal_types"),
        F.aggregate(sig, F.lit(0.0), lambda acc, s: acc + s["strength"]).alias("signal_strength"),
        F.col("blast_radius.primary_service_criticality").alias("criticality"),
        F.col("blast_radius.estimated_user_impact").alias("user_impact"),
        F.col("deployment_context.deployment_id").alias("deployment_id"),
        F.col("deployment_context.correlation_confidence").alias("deployment_confidence"),
        F.size("recent_errors").cast("long").alias("n_recent_errors"),
        F.when(F.col("recent_metrics").isNull(), F.lit(0)).otherwise(F.size(F.map_keys("recent_metrics")))
        .cast("long").alias("n_metrics"),
        F.array_join("cascade", ",").alias("cascade"),
    )


@register("c17_correlate", _sql(f"""
    SELECT a.incident_id, a.source_service, a.detection_time,
           list_sort(list_distinct(list_concat([a.source_service], coalesce(c.cascade, []::VARCHAR[]))))
               AS affected_services,
           coalesce(s.signal_types, '') AS signal_types, coalesce(s.signal_strength, 0.0) AS signal_strength,
           coalesce(r.criticality, 'P1') AS criticality,
           CASE coalesce(r.criticality, 'P1') {_TIER_USER} ELSE '{C.K.UNKNOWN_USER_IMPACT}' END AS user_impact,
           d.deployment_id, d.correlation_confidence AS deployment_confidence,
           len(coalesce(e.errs, []::VARCHAR[])[1:5])::BIGINT AS n_recent_errors,
           coalesce(t.n_metrics, 0)::BIGINT AS n_metrics,
           array_to_string(coalesce(c.cascade, []::VARCHAR[]), ',') AS cascade
    FROM adm a
    LEFT JOIN ({casc_list_sql('adm')}) c USING (incident_id)
    LEFT JOIN (SELECT incident_id, string_agg(signal_type, ',' ORDER BY ord) AS signal_types,
                      sum(strength ORDER BY ord) AS signal_strength
               FROM ({signals_sql('adm')}) GROUP BY 1) s USING (incident_id)
    LEFT JOIN registry r ON r.service_name = a.source_service
    LEFT JOIN ({conf_sql('adm')}) d USING (incident_id)
    LEFT JOIN ({errlist_sql('adm')}) e USING (incident_id)
    LEFT JOIN (SELECT incident_id, count(DISTINCT metric_name) AS n_metrics FROM ({tel_sql('adm')}) GROUP BY 1) t
        USING (incident_id)""", adm=f"SELECT * FROM {lock_sql('anoms')}"),
    doubles=("signal_strength", "deployment_confidence"), bench=True)
def q_correlate(spark, sf):
    m = A.metrics(spark, sf)
    out = C.correlate(_anoms(spark, sf), m, A.logs(spark, sf), A.deployments(spark, sf), A.registry(spark),
                      minutes=WIN_MIN, deploy_minutes=DEP_MIN, lock_s=LOCK_S, recovery_min=REC_MIN)
    return correlate_flat(out)


@register("f04_recovery", _sql(rec_sql("anoms")))
def q_recovery(spark, sf):
    return C.recovery(_anoms(spark, sf), A.metrics(spark, sf), limit_min=REC_MIN)


@register("f06_resolved_events", _sql(f"""
    SELECT incident_id, resolved_at, detection_time,
           (round((resolved_at - detection_time) / 1000.0)::BIGINT // 60) AS mttr_minutes,
           'AUTOMATIC_RECOVERY' AS resolution_method, [source_service] AS affected_services, recovered
    FROM ({rec_sql('anoms')})"""))
def q_resolved(spark, sf):
    r = C.recovery(_anoms(spark, sf), A.metrics(spark, sf), limit_min=REC_MIN)
    return r.select("incident_id", "resolved_at", "detection_time",
                    mttr_col("detection_time", "resolved_at").alias("mttr_minutes"),
                    F.lit("AUTOMATIC_RECOVERY").alias("resolution_method"),
                    F.array("source_service").alias("affected_services"), "recovered")
