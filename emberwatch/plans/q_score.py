"""Registered scoring queries (F-01..F-03, F-07..F-09) with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberwatch import constants as K
from emberwatch.functions.columns import band
from emberwatch.operators import correlate as C
from emberwatch.operators import score as S
from emberwatch.plans import q_correlate as QC
from emberwatch.plans import q_retrieve as QR
from emberwatch.plans.catalog import register
from emberwatch.plans.q_detect import GAP_S, TTL_S, anomalies_body
from emberwatch.sources import adapters as A


def _conf_expr() -> str:
    e = "0.5::DOUBLE"
    e = f"(CASE WHEN similar_count > 0 THEN {e} + 0.15::DOUBLE ELSE {e} - 0.15::DOUBLE END)"
    e = f"(CASE WHEN similar_count >= 3 THEN {e} + 0.10::DOUBLE ELSE {e} END)"
    e = f"(CASE WHEN deployment_correlated THEN {e} + 0.20::DOUBLE ELSE {e} END)"
    e = f"(CASE WHEN has_runbook THEN {e} + 0.05::DOUBLE ELSE {e} END)"
    e = f"(CASE WHEN competing > 2 THEN {e} - 0.10::DOUBLE ELSE {e} END)"
    e = f"(CASE WHEN len(evidence) >= 4 THEN {e} + 0.05::DOUBLE ELSE {e} END)"
    return f"round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, {e})), 3)"


CONF_SQL = f"SELECT incident_id, rank, hypothesis, {_conf_expr()} AS confidence FROM hypotheses"
RANK_SQL = f"""SELECT incident_id, hypothesis, confidence,
        row_number() OVER (PARTITION BY incident_id ORDER BY confidence DESC, rank ASC)::BIGINT AS rank
    FROM ({CONF_SQL}) WHERE rank <= 4"""


def _scored(spark, sf):
    return S.confidence(A.hypotheses(spark, sf)).select("incident_id", "rank", "hypothesis", "confidence")


@register("f01_confidence", A.with_adapters(CONF_SQL, "hypotheses"), doubles=("confidence",))
def q_confidence(spark, sf):
    return _scored(spark, sf)


@register("f02_rank", A.with_adapters(RANK_SQL, "hypotheses"), doubles=("confidence",))
def q_rank(spark, sf):
    return S.rank(_scored(spark, sf)).select("incident_id", "hypothesis", "confidence", "rank")


@register("f02_top_candidate", A.with_adapters(
    f"SELECT incident_id, arg_max(hypothesis, -rank) AS top_root_cause, arg_max(confidence, -rank) AS top_confidence, "
    f"count(*) AS candidates FROM ({RANK_SQL}) GROUP BY 1", "hypotheses"), doubles=("top_confidence",))
def q_top(spark, sf):
    return S.top_candidate(S.rank(_scored(spark, sf)))


@register("f03_band", A.with_adapters(
    f"SELECT incident_id, rank, confidence, CASE WHEN confidence >= 0.80 THEN 'HIGH' WHEN confidence >= 0.50 "
    f"THEN 'MEDIUM' ELSE 'LOW' END AS band FROM ({CONF_SQL})", "hypotheses"), doubles=("confidence",))
def q_band(spark, sf):
    return _scored(spark, sf).select("incident_id", "rank", "confidence", band("confidence").alias("band"))


_FIRSTS_SQL = "SELECT * FROM anoms QUALIFY row_number() OVER (PARTITION BY source_service ORDER BY incident_id) = 1"


def _pack_sql() -> str:
    nl = "chr(10)"
    titles = dict(K.SECTION_TITLES)
    order = "[" + ", ".join(f"'{t}'" for t in titles) + "]"
    head = "CASE collection " + " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in titles.items()) + " END"
    top = f"""SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY rank, chunk_id) AS n
              FROM ({QR.gather_sql()}) QUALIFY n <= 3"""
    line = (f"'[' || collection || ' ' || chunk_id::VARCHAR || '] (relevance ' || printf('%.2f', score) || ')' || {nl} "
            f"|| substr(content, 1, 400) || {nl}")
    secs = f"""SELECT query_id, list_position({order}, collection) AS o, {nl} || {nl} || '=== ' || {head} || ' ===' || {nl}
               || string_agg({line}, {nl} ORDER BY n) AS sec FROM ({top}) GROUP BY query_id, collection"""
    packs = f"SELECT query_id, string_agg(sec, '' ORDER BY o) AS sections FROM ({secs}) GROUP BY 1"
    ev = f"array_to_string(list_transform(string_split(evidence, '|')[1:2], lambda e: {nl} || '    Evidence: ' || e), '')"
    sigs = f"""SELECT incident_id, string_agg('- [' || signal_type || '] (strength ' || printf('%.2f', round(strength, 2)) || '): '
               || description || {ev}, {nl} ORDER BY ord) AS lines FROM ({QC.signals_sql('firsts')}) GROUP BY 1"""
    risks = "'[' || array_to_string(list_transform(d.known_risks, lambda r: chr(39) || r || chr(39)), ', ') || ']'"
    dep = f"""CASE WHEN d.deployment_id IS NULL THEN '' ELSE {nl} || {nl} || '=== RECENT DEPLOYMENT ===' || {nl} || 'Service: '
        || d.source_service || ' ' || d.version || {nl} || 'Delta: ' || d.time_delta_minutes::VARCHAR || ' minutes before incident'
        || {nl} || 'Change type: ' || d.change_type || {nl} || 'Known risks: ' || {risks} || {nl} || 'Correlation confidence: '
        || printf('%.2f', round(d.correlation_confidence, 2)) END"""
    return f"""SELECT q.query_id, '=== INCIDENT DETAILS ===' || {nl} || 'Incident ID: ' || q.query_id::VARCHAR || {nl} || 'Service: '
        || array_to_string(list_sort(list_distinct(list_concat([f.source_service], coalesce(c.cascade, []::VARCHAR[])))), ', ')
        || {nl} || 'Anomaly Type: ' || f.anomaly_type || {nl} || 'Severity: ' || f.severity || {nl} || 'Description: ' || f.description
        || {nl} || {nl} || '=== CORRELATION SIGNALS ===' || {nl} || coalesce(s.lines, '- No correlation signals') || {dep}
        || coalesce(p.sections, '') AS context
    FROM vector_queries q JOIN firsts f ON f.source_service = q.q_service
    LEFT JOIN ({QC.casc_list_sql('firsts')}) c ON c.incident_id = f.incident_id
    LEFT JOIN ({sigs}) s ON s.incident_id = f.incident_id LEFT JOIN ({QC.conf_sql('firsts')}) d ON d.incident_id = f.incident_id
    LEFT JOIN ({packs}) p ON p.query_id = q.query_id"""


@register("f07_evidence_pack", A.with_adapters(_pack_sql(), *QC._ADAPTERS, "vectors", "vector_queries",
                                               extra={"anoms": anomalies_body(GAP_S, TTL_S), "firsts": _FIRSTS_SQL}))
def q_evidence(spark, sf):
    """Each request asks on behalf of the first anomaly of its service, correlated with its context."""
    anoms = QC._anoms(spark, sf)
    first = anoms.groupBy("source_service").agg(F.min(F.struct("incident_id", *[c for c in anoms.columns if c not in ("incident_id", "source_service")])).alias("a"))
    first = first.select("source_service", "a.*")
    opened = C.correlate(first, A.metrics(spark, sf), A.logs(spark, sf), A.deployments(spark, sf), A.registry(spark), minutes=QC.WIN_MIN,
                         deploy_minutes=QC.DEP_MIN, lock_s=QC.LOCK_S, recovery_min=QC.REC_MIN)
    about = opened.join(first.select("incident_id", "description"), "incident_id").select(
        F.col("source_service").alias("q_service"), "affected_services", "anomaly_type", "severity", "description", "correlation_signals", "deployment_context")
    asked = A.vector_queries(spark, sf).select("query_id", "q_service").join(about, "q_service")
    hits = QR._gather(spark, sf).withColumn("title", F.concat_ws(" ", "collection", F.col("chunk_id").cast("string")))
    return S.evidence_pack(asked, hits)


@register("f08_sla_breach", QC._sql(f"""
    SELECT r.incident_id, r.source_service, p.peak_p99_ms, p.peak_error_rate_pct, g.sla_p99_latency_ms,
           g.sla_error_rate_pct, coalesce(p.peak_p99_ms > g.sla_p99_latency_ms, false) AS p99_breached,
           coalesce(p.peak_error_rate_pct > g.sla_error_rate_pct, false) AS error_breached
    FROM ({QC.rec_sql('anoms')}) r
    LEFT JOIN (SELECT r2.incident_id,
                      max(m.metric_value) FILTER (WHERE m.metric_name = 'service_latency_p99_ms') AS peak_p99_ms,
                      max(m.metric_value) FILTER (WHERE m.metric_name = 'service_error_rate_percent')
                          AS peak_error_rate_pct
               FROM ({QC.rec_sql('anoms')}) r2 JOIN metrics m ON m.source_service = r2.source_service
                    AND m.metric_name IN ('service_latency_p99_ms', 'service_error_rate_percent')
                    AND m.ts >= r2.detection_time AND m.ts <= r2.resolved_at
               GROUP BY 1) p USING (incident_id)
    LEFT JOIN registry g ON g.service_name = r.source_service"""),
    doubles=("peak_p99_ms", "peak_error_rate_pct", "sla_error_rate_pct"))
def q_sla(spark, sf):
    m = A.metrics(spark, sf)
    rec = C.recovery(QC._anoms(spark, sf), m, limit_min=QC.REC_MIN)
    return S.sla_breach(rec, m, A.registry(spark), max_span_ms=QC.REC)


_RCA_SQL = f"""SELECT t.incident_id, i.affected_services[1] AS service, t.top_root_cause, t.top_confidence
    FROM (SELECT incident_id, arg_max(hypothesis, -rank) AS top_root_cause, arg_max(confidence, -rank) AS top_confidence
          FROM ({RANK_SQL}) GROUP BY 1) t JOIN incidents i ON i.id = t.incident_id"""


def rca_frame(spark, sf):
    top = S.top_candidate(S.rank(_scored(spark, sf)))
    inc = A.incidents(spark, sf).select(F.col("id"), F.element_at("affected_services", 1).alias("service"))
    return top.join(inc, top.incident_id == inc.id).drop("id", "candidates")


_STEPS_SQL = ", ".join("{" + f"'step_id': {i}::BIGINT, " + ", ".join(
    f"'{k}': replace('{v}', '{{service}}', r.service)" for k, v in step.items()) + "}" for i, step in enumerate(K.DEFAULT_STEPS, 1))


@register("f09_default_steps", A.with_adapters(f"""
    SELECT r.incident_id, r.service, coalesce(g.on_call_rotation, '{K.DEFAULT_ON_CALL}') AS owner, s.step_id, s.priority, s.action,
           s.rationale, s.risk_level, s.rollback, s.expected_outcome, s.runbook_source,
           [coalesce(g.on_call_rotation, '{K.DEFAULT_ON_CALL}')] AS escalation_path, '{K.DEFAULT_RESOLUTION_TIME}' AS estimated_resolution_time
    FROM ({_RCA_SQL}) r LEFT JOIN registry g ON g.service_name = r.service,
    LATERAL (SELECT unnest([{_STEPS_SQL}], recursive := true)) s""", "hypotheses", "incidents", "registry"))
def q_steps(spark, sf):
    return S.default_steps(rca_frame(spark, sf), A.registry(spark))
