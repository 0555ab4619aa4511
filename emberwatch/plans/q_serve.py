"""Registered serving and table-maintenance queries (Q-01..Q-12, F-05, S-02, S-05..S-08, S-13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberwatch.operators import serve as Q
from emberwatch.operators import tables as S
from emberwatch.plans.catalog import register
from emberwatch.sources import adapters as A

INC_COLS = ("id, severity, anomaly_type, affected_services, status, detection_time, resolution_time, "
            "top_root_cause, rca_confidence, trigger_metric, baseline_value, description")
INC_D = ("rca_confidence", "baseline_value")
_MTTR_SQL = ("CASE WHEN resolution_time IS NOT NULL THEN "
             "(round((resolution_time - detection_time) / 1000.0)::BIGINT // 60) END")
_DAY = 86_400_000
_T0 = 1_704_067_200_000  # 2024-01-01, first day of the generated event stream


@register("q01_list_incidents", A.with_adapters(
    f"SELECT {INC_COLS} FROM incidents WHERE status = 'RESOLVED' "
    "ORDER BY detection_time DESC, id ASC LIMIT 50 OFFSET 10", "incidents"), doubles=INC_D)
def q_list(spark, sf):
    return Q.list_incidents(A.incidents(spark, sf), status="RESOLVED", limit=50, offset=10)


@register("q02_get_incident", A.with_adapters(f"SELECT {INC_COLS} FROM incidents WHERE id = 7", "incidents"),
          doubles=INC_D)
def q_get(spark, sf):
    return Q.get_incident(A.incidents(spark, sf), 7)


@register("q03_active_incidents", A.with_adapters(
    "SELECT id, severity, anomaly_type, affected_services, status, detection_time, top_root_cause, rca_confidence "
    "FROM incidents WHERE status <> 'RESOLVED' ORDER BY detection_time DESC, id", "incidents"),
    doubles=("rca_confidence",))
def q_active(spark, sf):
    return Q.active_incidents(A.incidents(spark, sf))


def _summary_sql(literal: bool) -> str:
    if literal:
        ae = "coalesce(n_ae, 0) * greatest(coalesce(n_en, 0), 1)"
        en = "coalesce(n_en, 0) * greatest(coalesce(n_ae, 0), 1)"
    else:
        ae, en = "coalesce(n_ae, 0)", "coalesce(n_en, 0)"
    return A.with_adapters(f"""
        SELECT i.id, i.severity, i.anomaly_type, i.affected_services, i.status, i.detection_time,
               i.resolution_time, {_MTTR_SQL} AS mttr_minutes, i.top_root_cause, i.rca_confidence,
               p.title AS postmortem_title, p.executive_summary AS postmortem_summary,
               ({ae})::BIGINT AS agent_event_count, ({en})::BIGINT AS email_count
        FROM incidents i
        LEFT JOIN postmortems p ON p.incident_id = i.id
        LEFT JOIN (SELECT incident_id, count(id) AS n_ae FROM agent_events GROUP BY 1) ae ON ae.incident_id = i.id
        LEFT JOIN (SELECT incident_id, count(id) AS n_en FROM emails GROUP BY 1) en ON en.incident_id = i.id""",
                           "incidents", "postmortems", "agent_events", "emails")


def _summary(spark, sf, literal):
    return Q.incident_summary(A.incidents(spark, sf), A.postmortems(spark, sf), A.agent_events(spark, sf),
                              A.emails(spark, sf), literal=literal)


@register("q04_incident_summary", _summary_sql(False), doubles=("rca_confidence",), bench=True)
def q_summary(spark, sf):
    return _summary(spark, sf, False)


@register("q04_incident_summary_literal", _summary_sql(True), doubles=("rca_confidence",))
def q_summary_literal(spark, sf):
    return _summary(spark, sf, True)


@register("q05_timeline", A.with_adapters(
    "SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY created_at, id)::BIGINT AS seq "
    "FROM agent_events", "agent_events"))
def q_timeline(spark, sf):
    return Q.timeline(A.agent_events(spark, sf))


@register("q06_registry", A.with_adapters("SELECT * FROM service_catalog ORDER BY criticality, service_name", "edges", "service_catalog"),
          doubles=("sla_error_rate_pct",))
def q_registry(spark, sf):
    return Q.registry(A.service_catalog(spark, sf))


@register("q07_kpis", A.with_adapters(f"""
    SELECT count(*) FILTER (WHERE status <> 'RESOLVED' AND severity = 'CRITICAL') AS critical_active,
           count(*) FILTER (WHERE status <> 'RESOLVED') AS active,
           count(*) FILTER (WHERE status = 'RESOLVED') AS resolved,
           floor(avg(CASE WHEN status = 'RESOLVED' AND mttr_minutes <> 0 THEN mttr_minutes END) + 0.5)::BIGINT
               AS avg_mttr_minutes
    FROM (SELECT *, {_MTTR_SQL} AS mttr_minutes FROM incidents ORDER BY detection_time DESC, id ASC LIMIT 50)""",
    "incidents"))
def q_kpis(spark, sf):
    return Q.kpis(A.incidents(spark, sf))


@register("q08_notifications", A.with_adapters("SELECT * FROM emails ORDER BY sent_at DESC, id", "emails"))
def q_notifications(spark, sf):
    return Q.notifications(A.emails(spark, sf))


@register("q09_postmortem_by_incident", A.with_adapters(
    "SELECT p.* FROM postmortems p WHERE p.incident_id IN (SELECT id FROM incidents WHERE status = 'RESOLVED')",
    "postmortems", "incidents"), doubles=("mttr_minutes",))
def q_postmortem(spark, sf):
    ids = A.incidents(spark, sf).where(F.col("status") == "RESOLVED").select(F.col("id").alias("incident_id"))
    return A.postmortems(spark, sf).join(ids, "incident_id", "left_semi")


@register("q10_resolve", A.with_adapters(f"""
    SELECT i.id, i.severity, i.anomaly_type, i.affected_services,
           CASE WHEN r.id IS NOT NULL THEN 'RESOLVED' ELSE i.status END AS status, i.detection_time,
           CASE WHEN r.id IS NOT NULL THEN r.requested_at ELSE i.resolution_time END AS resolution_time,
           i.top_root_cause, i.rca_confidence, i.trigger_metric, i.baseline_value, i.description
    FROM incidents i LEFT JOIN (
        SELECT incident_id AS id, min(created_at) AS requested_at FROM agent_events
        WHERE event_type = 'REMEDIATION_PLANNED' GROUP BY 1) r ON r.id = i.id AND i.status <> 'RESOLVED'""",
    "incidents", "agent_events"), doubles=INC_D)
def q_resolve(spark, sf):
    req = (A.agent_events(spark, sf).where(F.col("event_type") == "REMEDIATION_PLANNED")
           .select(F.col("incident_id").alias("id"), F.col("created_at").alias("requested_at")))
    return Q.resolve(A.incidents(spark, sf), req)


@register("q11_touching_service", A.with_adapters(
    f"SELECT {INC_COLS} FROM incidents WHERE list_contains(affected_services, 'payment-service')", "incidents"),
    doubles=INC_D)
def q_touching(spark, sf):
    return Q.touching(A.incidents(spark, sf), "payment-service")


@register("q12_agent_activity", A.with_adapters(
    "SELECT agent_name, event_type, count(*) AS events FROM agent_events GROUP BY 1, 2", "agent_events"))
def q_activity(spark, sf):
    return Q.activity(A.agent_events(spark, sf))


@register("f05_mttr", A.with_adapters(f"SELECT id, detection_time, resolution_time, {_MTTR_SQL} AS mttr_minutes "
                                      "FROM incidents", "incidents"))
def q_mttr(spark, sf):
    return Q.mttr(A.incidents(spark, sf)).select("id", "detection_time", "resolution_time", "mttr_minutes")


@register("s02_replay", A.with_adapters(
    f"SELECT * FROM metrics WHERE ts >= {_T0 + 5 * _DAY} AND ts <= {_T0 + 12 * _DAY} "
    "AND source_service = 'payment-service'", "metrics"))
def q_replay(spark, sf):
    bounds = (_T0 + 5 * _DAY, _T0 + 12 * _DAY)
    return S.replay(A.metrics(spark, sf, *bounds), *bounds, service="payment-service")


@register("s05_read_since", A.with_adapters(
    f"SELECT * FROM deployments WHERE deployed_at > {_T0 + 3 * _DAY} OR (deployed_at = {_T0 + 3 * _DAY} AND id > 0) "
    "ORDER BY deployed_at, id LIMIT 50", "deployments"))
def q_read_since(spark, sf):
    return S.read_since(A.deployments(spark, sf, _T0 + 3 * _DAY), (_T0 + 3 * _DAY, 0))


def _pm_candidates(spark, sf):
    """Regenerated postmortem rows for every resolved incident (the batch to write)."""
    inc = A.incidents(spark, sf).where(F.col("status") == "RESOLVED")
    return inc.select(
        F.col("id").alias("incident_id"),
        F.concat(F.lit("Postmortem v2 INC-"), F.col("id").cast("string")).alias("title"),
        F.concat(F.lit("# Postmortem v2\n"), F.col("description")).alias("full_markdown"),
        F.concat(F.lit("v2 summary "), F.col("id").cast("string")).alias("executive_summary"),
        F.col("top_root_cause").alias("root_cause"),
        Q.mttr_col().cast("double").alias("mttr_minutes"),
        F.col("resolution_time").alias("generated_at"),
    )


_PM_CAND_SQL = f"""SELECT id AS incident_id, 'Postmortem v2 INC-' || id::VARCHAR AS title,
    '# Postmortem v2' || chr(10) || description AS full_markdown, 'v2 summary ' || id::VARCHAR AS executive_summary,
    top_root_cause AS root_cause, ({_MTTR_SQL})::DOUBLE AS mttr_minutes, resolution_time AS generated_at
    FROM incidents WHERE status = 'RESOLVED'"""
_PM_COLS = "incident_id, title, full_markdown, executive_summary, root_cause, mttr_minutes, generated_at"


@register("s06_insert_if_absent", A.with_adapters(f"""
    SELECT {_PM_COLS} FROM postmortems
    UNION ALL
    SELECT {_PM_COLS} FROM ({_PM_CAND_SQL}) c WHERE c.incident_id NOT IN (SELECT incident_id FROM postmortems)""",
    "incidents", "postmortems"), doubles=("mttr_minutes",))
def q_insert_if_absent(spark, sf):
    return S.insert_if_absent(A.postmortems(spark, sf), _pm_candidates(spark, sf), keys=["incident_id"])


@register("s07_upsert_columns", A.with_adapters(f"""
    SELECT coalesce(t.incident_id, n.incident_id) AS incident_id,
           CASE WHEN t.incident_id IS NOT NULL THEN t.title ELSE n.title END AS title,
           CASE WHEN n.incident_id IS NOT NULL THEN n.full_markdown ELSE t.full_markdown END AS full_markdown,
           CASE WHEN n.incident_id IS NOT NULL THEN n.executive_summary ELSE t.executive_summary END
               AS executive_summary,
           CASE WHEN t.incident_id IS NOT NULL THEN t.root_cause ELSE n.root_cause END AS root_cause,
           CASE WHEN t.incident_id IS NOT NULL THEN t.mttr_minutes ELSE n.mttr_minutes END AS mttr_minutes,
           CASE WHEN t.incident_id IS NOT NULL THEN t.generated_at ELSE n.generated_at END AS generated_at
    FROM postmortems t FULL OUTER JOIN ({_PM_CAND_SQL}) n ON t.incident_id = n.incident_id""",
    "incidents", "postmortems"), doubles=("mttr_minutes",))
def q_upsert(spark, sf):
    return S.upsert_columns(A.postmortems(spark, sf), _pm_candidates(spark, sf), keys=["incident_id"],
                            update_cols=["full_markdown", "executive_summary"])


_ALLOWED = ("status", "resolution_time", "top_root_cause", "rca_confidence")


def _updates_sql() -> str:
    seq = "(seq_ts, seq_part, seq_supp, seq_line)"
    aggs = ", ".join(f"arg_max({c}, {seq}) FILTER (WHERE {c} IS NOT NULL) AS u_{c}" for c in _ALLOWED)
    cols = []
    for c in [x.strip() for x in INC_COLS.split(",")]:
        cols.append(f"coalesce(u.u_{c}, i.{c}) AS {c}" if c in _ALLOWED else f"i.{c}")
    return A.with_adapters(f"SELECT {', '.join(cols)} FROM incidents i LEFT JOIN "
                           f"(SELECT id, {aggs} FROM updates GROUP BY id) u ON u.id = i.id", "incidents", "updates")


@register("s08_apply_updates", _updates_sql(), doubles=INC_D)
def q_apply_updates(spark, sf):
    return S.apply_updates(A.incidents(spark, sf), A.updates(spark, sf), keys=["id"],
                           seq=["seq_ts", "seq_part", "seq_supp", "seq_line"], allowed=list(_ALLOWED))
