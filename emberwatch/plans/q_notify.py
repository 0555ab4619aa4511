"""Registered notification/report queries (N-01..N-07, S-12) with DuckDB twins.

The lifecycle stream is the union of the five event kinds the pipeline emits: anomalies (D-13),
RCA results (F-01/F-02), remediation plans (F-09), resolutions and postmortems."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberwatch import constants as K
from emberwatch.functions.columns import exec_summary, time_label
from emberwatch.operators.knowledge import WS_SQL
from emberwatch.operators import detect as D
from emberwatch.operators import notify as N
from emberwatch.operators.serve import mttr_col
from emberwatch.plans import q_score as QS
from emberwatch.plans.catalog import register
from emberwatch.plans.q_detect import GAP_S, TTL_S, anomalies_body
from emberwatch.session import stage
from emberwatch.sources import adapters as A

_NULLS = dict(severity="string", anomaly_type="string", service="string", anomaly_score="double",
              root_cause_candidates="array<string>", top_confidence="double", action_steps="array<string>",
              resolution_method="string", mttr_minutes="double", postmortem="string")


def _shape(df, **given):
    cols = [F.col("incident_id").cast("string").alias("incident_id")]
    for name, typ in _NULLS.items():
        cols.append((given[name] if name in given else F.lit(None)).cast(typ).alias(name))
    return df.select(*cols)


def lifecycle(spark, sf):
    anoms = D.detect(A.metrics(spark, sf), gap_s=GAP_S, ttl_s=TTL_S)
    inc = A.incidents(spark, sf)
    svc = F.element_at("affected_services", 1)
    a = _shape(anoms, severity=F.col("severity"), anomaly_type=F.col("anomaly_type"), service=F.col("source_service"),
               anomaly_score=F.col("anomaly_score"))
    rca = QS.rca_frame(spark, sf).join(inc.select("id", "anomaly_type"), F.col("incident_id") == F.col("id"))
    r = _shape(rca, anomaly_type=F.col("anomaly_type"), service=F.col("service"),
               root_cause_candidates=F.array("top_root_cause"), top_confidence=F.col("top_confidence"))
    plans = inc.where(F.col("status") == "RCA_COMPLETE").withColumn("incident_id", F.col("id"))
    p = _shape(plans, anomaly_type=F.col("anomaly_type"), service=svc,
               action_steps=F.array(F.concat(F.lit("Check health endpoint of "), svc),
                                    F.concat(F.lit("Rollback the most recent deployment to "), svc)))
    res = inc.where(F.col("status") == "RESOLVED").withColumn("incident_id", F.col("id"))
    rs = _shape(res, severity=F.col("severity"), anomaly_type=F.col("anomaly_type"), service=svc,
                resolution_method=F.lit("AUTOMATIC_RECOVERY"), mttr_minutes=mttr_col())
    pm = A.postmortems(spark, sf).join(inc.select(F.col("id").alias("incident_id"), "anomaly_type", "affected_services"),
                                       "incident_id")
    ps = _shape(pm, anomaly_type=F.col("anomaly_type"), service=svc, postmortem=F.col("full_markdown"))
    return a.unionByName(r).unionByName(p).unionByName(rs).unionByName(ps)


_MTTR = "(round((resolution_time - detection_time) / 1000.0)::BIGINT // 60)"
_LIFE_SQL = f"""
    SELECT incident_id, severity, anomaly_type, source_service AS service, anomaly_score,
           NULL::VARCHAR[] AS root_cause_candidates, NULL::DOUBLE AS top_confidence, NULL::VARCHAR[] AS action_steps,
           NULL::VARCHAR AS resolution_method, NULL::DOUBLE AS mttr_minutes, NULL::VARCHAR AS postmortem FROM anoms
    UNION ALL
    SELECT r.incident_id::VARCHAR, NULL, i.anomaly_type, r.service, NULL, [r.top_root_cause], r.top_confidence, NULL,
           NULL, NULL, NULL FROM ({QS._RCA_SQL}) r JOIN incidents i ON i.id = r.incident_id
    UNION ALL
    SELECT id::VARCHAR, NULL, anomaly_type, affected_services[1], NULL, NULL, NULL,
           ['Check health endpoint of ' || affected_services[1],
            'Rollback the most recent deployment to ' || affected_services[1]], NULL, NULL, NULL
    FROM incidents WHERE status = 'RCA_COMPLETE'
    UNION ALL
    SELECT id::VARCHAR, severity, anomaly_type, affected_services[1], NULL, NULL, NULL, NULL, 'AUTOMATIC_RECOVERY',
           {_MTTR}::DOUBLE, NULL FROM incidents WHERE status = 'RESOLVED'
    UNION ALL
    SELECT p.incident_id::VARCHAR, NULL, i.anomaly_type, i.affected_services[1], NULL, NULL, NULL, NULL, NULL, NULL,
           p.full_markdown FROM postmortems p JOIN incidents i ON i.id = p.incident_id"""

_KIND_SQL = """CASE WHEN anomaly_score IS NOT NULL AND action_steps IS NULL THEN 'anomaly'
    WHEN root_cause_candidates IS NOT NULL THEN 'rca' WHEN action_steps IS NOT NULL THEN 'plan'
    WHEN resolution_method IS NOT NULL THEN 'resolved'
    WHEN postmortem IS NOT NULL AND length(postmortem) > 100 THEN 'postmortem' END"""

_ROUTES_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"('{k}', '{t}', " + ("[" + ", ".join(f"'{x}'" for x in (K.ONCALL if r == "oncall" else K.ALL_RECIPIENTS)) + "]")
    + ")" for k, t, r in N.ROUTES) + ") AS t(kind, notification_type, recipients)"

_ROUTED_SQL = f"""SELECT e.*, r.notification_type, r.recipients FROM (
        SELECT *, {_KIND_SQL} AS kind FROM life WHERE incident_id IS NOT NULL) e
    JOIN ({_ROUTES_SQL}) r USING (kind)
    WHERE e.kind IS NOT NULL AND (e.kind <> 'anomaly' OR e.severity IN ('CRITICAL', 'HIGH'))"""

_SUBJECT_SQL = """CASE kind
    WHEN 'anomaly' THEN '🚨 [' || severity || '] INC-' || upper(substr(incident_id, 1, 8)) || ' — ' || anomaly_type
         || ' on ' || service
    WHEN 'rca' THEN '🔍 [INC-' || upper(substr(incident_id, 1, 8)) || '] Root Cause Analysis — '
         || floor(top_confidence * 100)::BIGINT::VARCHAR || '% confidence'
    WHEN 'plan' THEN '🛠️ [INC-' || upper(substr(incident_id, 1, 8)) || '] Remediation Plan — '
         || len(action_steps)::VARCHAR || ' steps'
    WHEN 'resolved' THEN '✅ [INC-' || upper(substr(incident_id, 1, 8)) || '] Resolved — ' || anomaly_type || ' on '
         || service || ' (' || round_even(mttr_minutes, 0)::BIGINT::VARCHAR || ' min)'
    ELSE '📋 [INC-' || upper(substr(incident_id, 1, 8)) || '] Postmortem Ready — ' || anomaly_type || ' on ' || service
    END"""


def _sql(body: str) -> str:
    return A.with_adapters(body, "metrics", "hypotheses", "incidents", "postmortems", "registry",
                           extra={"anoms": anomalies_body(GAP_S, TTL_S), "life": _LIFE_SQL})


@register("s12_route_kind", _sql(f"SELECT incident_id, kind FROM (SELECT *, {_KIND_SQL} AS kind FROM life "
                                 "WHERE incident_id IS NOT NULL) WHERE kind IS NOT NULL"))
def q_route_kind(spark, sf):
    return N.route_kind(lifecycle(spark, sf)).select("incident_id", "kind")


@register("n01_route", _sql(f"SELECT incident_id, kind, notification_type, recipients FROM ({_ROUTED_SQL})"))
def q_route(spark, sf):
    return N.route(lifecycle(spark, sf), N.routes_table(spark)).select("incident_id", "kind", "notification_type",
                                                                       "recipients")


@register("n02_subject", _sql(f"SELECT incident_id, kind, {_SUBJECT_SQL} AS subject FROM ({_ROUTED_SQL})"))
def q_subject(spark, sf):
    r = N.route(lifecycle(spark, sf), N.routes_table(spark))
    return r.select("incident_id", "kind", N.subject().alias("subject"))


_BODY_COLS = ["severity", "anomaly_type", "service", "top_confidence", "resolution_method", "mttr_minutes", "postmortem", *N.BODY_COLUMNS]


def _bodied(df, kind, **given):
    """A kind's events in the columns that its body reads."""
    types = {**_NULLS, **N.BODY_COLUMNS}
    cols = [F.col("incident_id").cast("string").alias("incident_id"), F.lit(kind).alias("kind")]
    return df.select(*cols, *[(given[c] if c in given else F.lit(None)).cast(types[c]).alias(c) for c in _BODY_COLS])


def body_events(spark, sf):
    c, svc = F.col, F.element_at("affected_services", 1)
    inc = A.incidents(spark, sf)
    anoms = D.detect(A.metrics(spark, sf), gap_s=GAP_S, ttl_s=TTL_S).where(c("severity").isin("CRITICAL", "HIGH"))
    a = _bodied(anoms, "anomaly", service=c("source_service"), **{x: c(x) for x in (
        "severity", "anomaly_type", "detection_time", "trigger_metric", "observed_value", "baseline_value", "deviation_sigma", "description", "affected_services")})
    about = inc.select("id", "anomaly_type", "affected_services", "detection_time")
    best = A.hypotheses(spark, sf).select("incident_id", F.col("hypothesis").alias("h"), "evidence")
    rca = stage(QS.rca_frame(spark, sf), "rca")  # read by two kinds
    top = rca.join(best, (best.incident_id == rca.incident_id) & (c("h") == c("top_root_cause"))).drop(best.incident_id)
    r = _bodied(top.join(about, c("incident_id") == c("id")), "rca", service=c("service"), blast_affected=c("affected_services"),
                generated_at=c("detection_time"), **{x: c(x) for x in ("anomaly_type", "top_root_cause", "top_confidence", "evidence")})
    waiting = inc.where(c("status") == "RCA_COMPLETE").withColumn("service", svc).withColumn("incident_id", c("id"))
    plan = QS.S.default_steps(rca, A.registry(spark), per=waiting)
    p = _bodied(plan, "plan", generated_at=c("detection_time"), estimated_time=c("estimated_resolution_time"), **{x: c(x) for x in (
        "anomaly_type", "service", "top_root_cause", "steps", "escalation_path", "runbook_refs")})
    done = inc.where(c("status") == "RESOLVED").withColumn("incident_id", c("id"))
    s = _bodied(done, "resolved", service=svc, resolved_at=c("resolution_time"), mttr_minutes=mttr_col(), **{x: c(x) for x in (
        "severity", "anomaly_type", "detection_time", "top_root_cause")})
    pm = A.postmortems(spark, sf).join(about.withColumnRenamed("id", "incident_id"), "incident_id")
    m = _bodied(pm, "postmortem", service=svc, postmortem=c("full_markdown"), **{x: c(x) for x in ("anomaly_type", "mttr_minutes", "generated_at")})
    return a.unionByName(r).unionByName(p).unionByName(s).unionByName(m)


def _body_sql(kind: str, **values: str) -> str:
    """The template of a kind written out as one concatenation."""
    import re

    parts = re.split(r"\{\{(\w+)\}\}", K.BODIES[kind])
    return " || ".join("'" + x.replace("'", "''") + "'" if i % 2 == 0 else f"coalesce(({values[x]})::VARCHAR, 'None')" for i, x in enumerate(parts))


def _items(arr: str, before: str = "<li>", after: str = "</li>") -> str:
    return f"array_to_string(list_transform({arr}, lambda x: '{before}' || x || '{after}'), '')"


def _label(ms: str) -> str:
    return f"CASE WHEN {ms} IS NULL OR {ms} = 0 THEN 'N/A' ELSE strftime(make_timestamp({ms} * 1000), '%Y-%m-%d %H:%M:%S') || ' UTC' END"


_SHORT = "upper(substr({}::VARCHAR, 1, 8))"
_STEP_SQL = "'<div>' || s.step_id::VARCHAR || '. ' || s.action || ' [' || replace(s.priority, '_', ' ') || ', risk ' || s.risk_level " \
            "|| ']<br>Rationale: ' || s.rationale || '<br>Expected: ' || s.expected_outcome || '<br>Rollback: ' || s.rollback " \
            "|| '<br>Owner: ' || s.owner || '</div>'"
_MTTR_BODY = "(round((i.resolution_time - i.detection_time) / 1000.0)::BIGINT // 60)"
_SUM_SQL = "'Incident ' || p.incident_id::VARCHAR || ' was resolved. Impact was limited. '"  # what the adapter's markdown says there
_BODIES_SQL = f"""
    SELECT incident_id, 'anomaly' AS kind, {_body_sql('anomaly', severity='severity', anomaly_type='anomaly_type', service='source_service',
        incident_id_short=_SHORT.format('incident_id'), detection_time=_label('detection_time'), trigger_metric='trigger_metric',
        observed_value="printf('%.2f', round(observed_value, 2))", baseline_value="printf('%.2f', round(baseline_value, 2))",
        deviation_sigma="printf('%.1f', round(deviation_sigma, 1))", description='description',
        affected_services="array_to_string(affected_services, ', ')", user_impact="'Under investigation'", revenue_impact="'Under investigation'",
        generated_at=_label('detection_time'))} AS body FROM anoms WHERE severity IN ('CRITICAL', 'HIGH')
    UNION ALL
    SELECT r.incident_id::VARCHAR, 'rca', {_body_sql('rca', incident_id_short=_SHORT.format('r.incident_id'), top_root_cause='r.top_root_cause',
        confidence_pct='floor(r.top_confidence * 100)::BIGINT',
        evidence_list=f"CASE WHEN len(h.evidence) > 0 THEN {_items('h.evidence[1:5]')} ELSE '<li>No evidence collected</li>' END",
        similar_incidents_html="'<p>No similar incidents found.</p>'", deployment_section="''",
        signals_list="'<li>Blast radius: [' || array_to_string(list_transform(i.affected_services, lambda x: chr(39) || x || chr(39)), ', ') || ']</li>'",
        generated_at=_label('i.detection_time'))}
    FROM ({QS._RCA_SQL}) r JOIN incidents i ON i.id = r.incident_id
    JOIN hypotheses h ON h.incident_id = r.incident_id AND h.hypothesis = r.top_root_cause
    UNION ALL
    SELECT i.id::VARCHAR, 'plan', {_body_sql('plan', incident_id_short=_SHORT.format('i.id'), top_root_cause='substr(i.top_root_cause, 1, 100)',
        estimated_time=f"'{K.DEFAULT_RESOLUTION_TIME}'", steps_html='t.steps', escalation_path='t.owner',
        runbook_refs_html="'<ul>' || t.refs || '</ul>'", generated_at=_label('i.detection_time'))}
    FROM incidents i JOIN (SELECT incident_id, min(owner) AS owner, string_agg({_STEP_SQL}, '' ORDER BY step_id) AS steps,
          {_items('list_sort(list(DISTINCT s.runbook_source))')} AS refs
        FROM (SELECT r.incident_id, coalesce(g.on_call_rotation, '{K.DEFAULT_ON_CALL}') AS owner,
                unnest([{QS._STEPS_SQL}], recursive := true) FROM ({QS._RCA_SQL}) r LEFT JOIN registry g ON g.service_name = r.service) s
        GROUP BY 1) t ON t.incident_id = i.id WHERE i.status = 'RCA_COMPLETE'
    UNION ALL
    SELECT i.id::VARCHAR, 'resolved', {_body_sql('resolved', anomaly_type='i.anomaly_type', service='i.affected_services[1]',
        incident_id_short=_SHORT.format('i.id'), severity='i.severity', mttr=_MTTR_BODY, resolution_method="'AUTOMATIC_RECOVERY'",
        top_root_cause="coalesce(i.top_root_cause, 'Under investigation')", detection_time=_label('i.detection_time'),
        resolved_at=_label('i.resolution_time'), generated_at=_label('i.resolution_time'))} FROM incidents i WHERE i.status = 'RESOLVED'
    UNION ALL
    SELECT p.incident_id::VARCHAR, 'postmortem', {_body_sql('postmortem', incident_id_short=_SHORT.format('p.incident_id'),
        anomaly_type='i.anomaly_type', service='i.affected_services[1]', severity="'HIGH'", mttr='round_even(p.mttr_minutes, 0)::BIGINT',
        affected_services='i.affected_services[1]', executive_summary=_SUM_SQL, full_markdown='substr(p.full_markdown, 1, 3000)',
        date=f"substr({_label('p.generated_at')}, 1, 10)", generated_at=_label('p.generated_at'))}
    FROM postmortems p JOIN incidents i ON i.id = p.incident_id"""


@register("n02_bodies", _sql(_BODIES_SQL))
def q_bodies(spark, sf):
    return N.with_bodies(body_events(spark, sf)).select("incident_id", "kind", "body")


@register("n03_exec_summary", A.with_adapters(f"""
    SELECT incident_id, CASE WHEN len(kept) > 0 THEN array_to_string(kept, ' ') || ' ' ELSE '' END AS exec_summary
    FROM (SELECT incident_id, list_filter(list_transform(body, lambda l: trim(l, {WS_SQL})),
                                          lambda l: l <> '') AS kept
          FROM (SELECT incident_id, CASE WHEN stop > 0 THEN after[1:stop - 1] ELSE after END AS body
                FROM (SELECT incident_id, after, coalesce(list_position(list_transform(after,
                                 lambda l: starts_with(l, '##')), true), 0) AS stop
                      FROM (SELECT incident_id, CASE WHEN start > 0 THEN lines[start + 1:] ELSE []::VARCHAR[] END
                                       AS after
                            FROM (SELECT incident_id, lines, coalesce(list_position(list_transform(lines,
                                             lambda l: starts_with(l, '## Executive Summary')), true), 0) AS start
                                  FROM (SELECT incident_id, string_split(full_markdown, chr(10)) AS lines
                                        FROM postmortems))))))""", "postmortems"))
def q_exec_summary(spark, sf):
    return A.postmortems(spark, sf).select("incident_id", exec_summary("full_markdown").alias("exec_summary"))


def _label_sql(ms: str) -> str:
    return (f"CASE WHEN {ms} IS NULL OR {ms} = 0 THEN 'N/A' ELSE "
            f"strftime(make_timestamp({ms} * 1000), '%Y-%m-%d %H:%M:%S') || ' UTC' END")


_TIMELINE_SQL = f"""
    SELECT incident_id, pos, '  ' || {_label_sql('created_at')} || ' [' || agent_name || '] ' || event_type || ': '
           || substr(coalesce(nullif(json_extract_string(payload, '$.top_hypothesis'), ''),
                              nullif(json_extract_string(payload, '$.metric'), ''),
                              nullif(json_extract_string(payload, '$.steps'), ''), ''), 1, 80) AS line
    FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY created_at, id)::BIGINT AS pos
          FROM agent_events) WHERE pos <= 20"""


@register("n04_timeline_facts", A.with_adapters(_TIMELINE_SQL, "agent_events"))
def q_timeline_facts(spark, sf):
    return N.timeline_facts(A.agent_events(spark, sf))


_WELL = "\n".join(f"- {x}" for x in K.REPORT_WENT_WELL)
_SERVICE = "coalesce(i.affected_services[1], 'unknown')"
_MINUTES = f"coalesce(CASE WHEN resolution_time IS NOT NULL THEN {_MTTR} END::VARCHAR, 'N/A')"
_CAUSE = "coalesce(nullif(i.top_root_cause, ''), 'Under investigation')"
_TIER = lambda table: "CASE coalesce(g.criticality, 'P1') " + " ".join(f"WHEN '{t}' THEN '{x}'" for t, x in table)


@register("n05_report", A.with_adapters(f"""
    SELECT i.id AS incident_id, '# Postmortem: ' || anomaly_type || ' on ' || {_SERVICE} || chr(10) || chr(10) || '**Date:** '
      || substr({_label_sql('detection_time')}, 1, 10) || chr(10) || '**Duration:** ' || {_MINUTES} || ' minutes' || chr(10)
      || '**Severity:** ' || severity || chr(10) || '**MTTR:** ' || {_MINUTES} || ' minutes' || chr(10) || '**Services:** '
      || array_to_string(affected_services, ', ') || chr(10) || '**Detected:** ' || {_label_sql('detection_time')} || chr(10)
      || '**Resolved:** ' || {_label_sql('resolution_time')} || '

---

## Executive Summary

' || severity || ' ' || anomaly_type || ' on ' || {_SERVICE} || ' at ' || {_label_sql('detection_time')} || '. ' || coalesce(description, '')
      || chr(10) || CASE WHEN resolution_time IS NULL THEN 'It is not resolved yet.' ELSE 'It was resolved after ' || {_MINUTES} || ' minutes.' END
      || ' Root cause: ' || {_CAUSE} || '

---

## Impact

- Affected services: ' || array_to_string(affected_services, ', ') || '
- Criticality: ' || coalesce(g.criticality, 'P1') || '
- Users: ' || {_TIER(K.USER_IMPACT)} ELSE '{K.UNKNOWN_USER_IMPACT}' END || '
- Revenue: ' || {_TIER(K.REVENUE_IMPACT)} ELSE '{K.UNKNOWN_REVENUE_IMPACT}' END || '

---

## Timeline

' || coalesce(t.timeline, '') || '

---

## Root Cause

**Primary Root Cause:** ' || {_CAUSE} || '

---

## Contributing Factors

' || coalesce(f.factors, '- None identified') || '

---

## What Went Well

{_WELL}

---

## What Could Be Improved

- Review alert thresholds to reduce time-to-detect
- Ensure runbooks are up-to-date for ' || anomaly_type || ' scenarios

---

## Action Items

| Action | Owner | Priority |
|---|---|---|
' || coalesce(a.actions, '') || '

---

Incident ID: ' || i.id::VARCHAR || chr(10) AS markdown
    FROM incidents i LEFT JOIN registry g ON g.service_name = i.affected_services[1]
    LEFT JOIN (SELECT incident_id, string_agg(line, chr(10) ORDER BY pos) AS timeline
      FROM ({_TIMELINE_SQL}) GROUP BY 1) t ON t.incident_id = i.id
    LEFT JOIN (SELECT incident_id, string_agg('- ' || hypothesis, chr(10) ORDER BY rank) AS factors FROM ({QS.RANK_SQL}) WHERE rank > 1
      GROUP BY 1) f ON f.incident_id = i.id
    LEFT JOIN (SELECT incident_id, string_agg('| ' || s.action || ' | ' || owner || ' | ' || s.priority || ' |', chr(10) ORDER BY step_id) AS actions
      FROM (SELECT r.incident_id, coalesce(g.on_call_rotation, '{K.DEFAULT_ON_CALL}') AS owner, unnest([{QS._STEPS_SQL}], recursive := true)
            FROM ({QS._RCA_SQL}) r LEFT JOIN registry g ON g.service_name = r.service) s GROUP BY 1) a ON a.incident_id = i.id""",
    "incidents", "agent_events", "registry", "hypotheses"))
def q_report(spark, sf):
    ranked = QS.S.rank(QS._scored(spark, sf))
    steps = QS.S.default_steps(QS.rca_frame(spark, sf), A.registry(spark))
    return N.report(A.incidents(spark, sf), N.timeline_facts(A.agent_events(spark, sf)), A.registry(spark), ranked, steps)


@register("n06_time_label", A.with_adapters(
    f"SELECT id, {_label_sql('detection_time')} AS detected, {_label_sql('resolution_time')} AS resolved "
    "FROM incidents", "incidents"))
def q_time_label(spark, sf):
    return A.incidents(spark, sf).select("id", time_label("detection_time").alias("detected"),
                                         time_label("resolution_time").alias("resolved"))


@register("n07_delivery_rows", _sql(
    f"SELECT incident_id, notification_type, recipients, {_SUBJECT_SQL} AS subject, "
    f"CASE WHEN len(recipients) > 0 THEN 'SENT' ELSE 'FAILED' END AS status FROM ({_ROUTED_SQL})"))
def q_delivery(spark, sf):
    r = N.route(lifecycle(spark, sf), N.routes_table(spark))
    st = F.when(F.size("recipients") > 0, F.lit("SENT")).otherwise(F.lit("FAILED"))
    return N.delivery_rows(r, st)
