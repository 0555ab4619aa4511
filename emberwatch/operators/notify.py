"""Notifications and report data N-01..N-07 and the lifecycle router S-12."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberwatch import constants as K
from emberwatch.functions.columns import exec_summary, fill, time_label
from emberwatch.operators.knowledge import py_list_repr

# Notification kinds, their type and recipients role.
ROUTES = [
    ("anomaly", "INCIDENT_OPENED", "oncall"),
    ("rca", "RCA_AVAILABLE", "oncall"),
    ("plan", "REMEDIATION_PLAN", "oncall"),
    ("resolved", "INCIDENT_RESOLVED", "all"),
    ("postmortem", "POSTMORTEM_READY", "all"),
]


def route_kind(df: DataFrame) -> DataFrame:
    """S-12: kind by which fields are present, in the order anomaly (unless `rca_candidates` or `action_steps` is
    there too) -> rca -> plan -> resolved -> postmortem (postmortem text over 100 characters); rows with no incident id or no kind are dropped."""
    absent = lambda c: F.col(c).isNull() if c in df.columns else F.lit(True)
    kind = (F.when(F.col("anomaly_score").isNotNull() & absent("rca_candidates")
                   & F.col("action_steps").isNull(), "anomaly")
             .when(F.col("root_cause_candidates").isNotNull(), "rca")
             .when(F.col("action_steps").isNotNull(), "plan")
             .when(F.col("resolution_method").isNotNull(), "resolved")
             .when(F.col("postmortem").isNotNull() & (F.length("postmortem") > 100), "postmortem"))
    return df.where(F.col("incident_id").isNotNull()).withColumn("kind", kind).where(F.col("kind").isNotNull())


def routes_table(spark) -> DataFrame:
    rows = [(k, t, K.ONCALL if r == "oncall" else K.ALL_RECIPIENTS) for k, t, r in ROUTES]
    return spark.createDataFrame(rows, "kind string, notification_type string, recipients array<string>")


def route(events: DataFrame, routes: DataFrame) -> DataFrame:
    """N-01: new anomalies notify only at CRITICAL/HIGH; recipients by kind (5-row table, broadcast: a shuffle by kind
    would put all events of a kind into one task)."""
    ev = route_kind(events)
    ev = ev.where((F.col("kind") != "anomaly") | F.col("severity").isin("CRITICAL", "HIGH"))
    return ev.join(F.broadcast(routes), "kind")


def _short(iid) -> F.Column:
    return F.upper(F.substring(F.col(iid).cast("string"), 1, 8))


def subject(kind: str = "kind") -> F.Column:
    """N-02: the subject line per kind."""
    s = _short("incident_id")
    k = F.col(kind)
    return (
        F.when(k == "anomaly", F.concat(F.lit("🚨 ["), F.col("severity"), F.lit("] INC-"), s, F.lit(" — "),
                                        F.col("anomaly_type"), F.lit(" on "), F.col("service")))
        .when(k == "rca", F.concat(F.lit("🔍 [INC-"), s, F.lit("] Root Cause Analysis — "),
                                   F.floor(F.col("top_confidence") * 100).cast("long").cast("string"),
                                   F.lit("% confidence")))
        .when(k == "plan", F.concat(F.lit("🛠️ [INC-"), s, F.lit("] Remediation Plan — "),
                                    F.size("action_steps").cast("string"), F.lit(" steps")))
        .when(k == "resolved", F.concat(F.lit("✅ [INC-"), s, F.lit("] Resolved — "), F.col("anomaly_type"),
                                        F.lit(" on "), F.col("service"), F.lit(" ("),
                                        F.bround(F.col("mttr_minutes"), 0).cast("long").cast("string"), F.lit(" min)")))
        .otherwise(F.concat(F.lit("📋 [INC-"), s, F.lit("] Postmortem Ready — "), F.col("anomaly_type"),
                            F.lit(" on "), F.col("service"))))


#: Columns that bodies read beside the subject's; a frame that lacks some has nulls there.
BODY_COLUMNS = dict(detection_time="long", resolved_at="long", generated_at="long", trigger_metric="string", observed_value="double",
                    baseline_value="double", deviation_sigma="double", description="string", affected_services="array<string>",
                    top_root_cause="string", evidence="array<string>", similar_incidents="array<string>",
                    deployment="struct<service_name:string,version:string,time_delta_minutes:bigint,correlation_confidence:double>",
                    blast_affected="array<string>", estimated_time="string", escalation_path="array<string>", runbook_refs="array<string>",
                    steps="array<struct<step_id:bigint,priority:string,action:string,rationale:string,risk_level:string,rollback:string,"
                          "owner:string,expected_outcome:string>>")


def body_context() -> dict[str, dict[str, F.Column]]:
    """N-02: what fills the placeholders of each kind's body, as text."""
    c = F.col
    none = F.array().cast("array<string>")
    lists = lambda name: F.coalesce(c(name), none)
    text = lambda name, absent="": F.coalesce(c(name).cast("string"), F.lit(absent))
    number = lambda name, digits: F.format_string(f"%.{digits}f", F.coalesce(c(name), F.lit(0.0)))
    items = lambda arr: F.array_join(F.transform(arr, lambda x: F.concat(F.lit("<li>"), x, F.lit("</li>"))), "")
    short, mttr = _short("incident_id"), F.bround(F.coalesce(c("mttr_minutes"), F.lit(0.0)), 0).cast("long").cast("string")
    d = c("deployment")
    deployment = F.when(d["service_name"].isNotNull(), F.concat(
        F.lit("<p>"), d["service_name"], F.lit(" "), F.coalesce(d["version"], F.lit("")), F.lit(" deployed "),
        F.coalesce(d["time_delta_minutes"].cast("string"), F.lit("?")), F.lit(" minutes before incident (confidence: "),
        F.bround(F.coalesce(d["correlation_confidence"], F.lit(0.0)) * 100, 0).cast("long").cast("string"), F.lit("%)</p>"))).otherwise(F.lit(""))
    step = lambda s: F.concat(
        F.lit("<div>"), s["step_id"].cast("string"), F.lit(". "), s["action"], F.lit(" ["), F.replace(s["priority"], F.lit("_"), F.lit(" ")),
        F.lit(", risk "), s["risk_level"], F.lit("]<br>Rationale: "), F.coalesce(s["rationale"], F.lit("")), F.lit("<br>Expected: "),
        F.coalesce(s["expected_outcome"], F.lit("")), F.lit("<br>Rollback: "), F.coalesce(s["rollback"], F.lit("N/A")), F.lit("<br>Owner: "),
        F.coalesce(s["owner"], F.lit("on-call")), F.lit("</div>"))
    evidence = items(F.slice(lists("evidence"), 1, 5))
    similar = F.array_join(F.transform(F.slice(lists("similar_incidents"), 1, 3), lambda x: F.concat(F.lit("<div>Historical: "), x, F.lit("</div>"))), "")
    refs = items(lists("runbook_refs"))
    path = F.array_join(lists("escalation_path"), " → ")
    about = {"incident_id_short": short, "service": text("service", "unknown"), "anomaly_type": text("anomaly_type")}
    summary = exec_summary(F.coalesce(c("postmortem"), F.lit("")))
    return {
        "anomaly": {**about, "severity": text("severity"), "detection_time": time_label("detection_time"), "trigger_metric": text("trigger_metric"),
                    "observed_value": number("observed_value", 2), "baseline_value": number("baseline_value", 2),
                    "deviation_sigma": number("deviation_sigma", 1), "description": text("description", "Anomaly detected."),
                    "affected_services": F.array_join(lists("affected_services"), ", "), "user_impact": F.lit("Under investigation"),
                    "revenue_impact": F.lit("Under investigation"), "generated_at": time_label("detection_time")},
        "rca": {**about, "top_root_cause": text("top_root_cause", "Under investigation"),
                "confidence_pct": F.floor(F.coalesce(c("top_confidence"), F.lit(0.0)) * 100).cast("string"),
                "evidence_list": F.when(evidence != "", evidence).otherwise(F.lit("<li>No evidence collected</li>")),
                "similar_incidents_html": F.when(similar != "", similar).otherwise(F.lit("<p>No similar incidents found.</p>")),
                "deployment_section": deployment, "signals_list": F.concat(F.lit("<li>Blast radius: "), py_list_repr(lists("blast_affected")), F.lit("</li>")),
                "generated_at": time_label("generated_at")},
        "plan": {**about, "top_root_cause": F.substring(text("top_root_cause"), 1, 100), "estimated_time": text("estimated_time", "Unknown"),
                 "steps_html": F.array_join(F.transform(F.coalesce(c("steps"), F.array().cast(BODY_COLUMNS["steps"])), step), ""),
                 "escalation_path": F.when(path != "", path).otherwise(F.lit("on-call")),
                 "runbook_refs_html": F.when(refs != "", F.concat(F.lit("<ul>"), refs, F.lit("</ul>"))).otherwise(F.lit("")),
                 "generated_at": time_label("generated_at")},
        "resolved": {**about, "severity": text("severity", "HIGH"), "mttr": mttr, "top_root_cause": text("top_root_cause", "Under investigation"),
                     "resolution_method": text("resolution_method", "AUTOMATIC_RECOVERY"), "detection_time": time_label("detection_time"),
                     "resolved_at": time_label("resolved_at"), "generated_at": time_label("resolved_at")},
        "postmortem": {**about, "severity": text("severity", "HIGH"), "mttr": mttr, "affected_services": text("service", "unknown"),
                       "executive_summary": F.when(summary != "", summary).otherwise(F.lit("See full postmortem below.")),
                       "full_markdown": F.substring(F.coalesce(c("postmortem"), F.lit("")), 1, 3000),
                       "date": F.substring(time_label("generated_at"), 1, 10), "generated_at": time_label("generated_at")},
    }


def with_bodies(notifs: DataFrame) -> DataFrame:
    """N-02: adds `body`, the kind's template with its placeholders filled. Values are not filled again, whatever they
    hold: each placeholder is cut out of the template first."""
    for name, kind in BODY_COLUMNS.items():
        if name not in notifs.columns:
            notifs = notifs.withColumn(name, F.lit(None).cast(kind))
    body = F.lit(None).cast("string")
    for kind, context in body_context().items():
        body = F.when(F.col("kind") == kind, fill(K.BODIES[kind], context)).otherwise(body)
    return notifs.withColumn("body", body)


def timeline_facts(ev: DataFrame, *, n: int = 20, chars: int = 80) -> DataFrame:
    """N-04: first n audit events per incident; detail = top_hypothesis, else metric, else steps."""
    w = Window.partitionBy("incident_id").orderBy("created_at", "id")
    first = ev.withColumn("pos", F.row_number().over(w).cast("long")).where(F.col("pos") <= n)
    detail = F.coalesce(*[F.nullif(F.get_json_object("payload", f"$.{k}"), F.lit("")) for k in
                          ("top_hypothesis", "metric", "steps")], F.lit(""))
    line = F.concat(F.lit("  "), time_label("created_at"), F.lit(" ["), F.col("agent_name"), F.lit("] "),
                    F.col("event_type"), F.lit(": "), F.substring(detail, 1, chars))
    return first.select("incident_id", "pos", line.alias("line"))


def report(inc: DataFrame, facts: DataFrame, registry: DataFrame, factors: DataFrame, steps: DataFrame) -> DataFrame:
    """N-05: the deterministic report per incident: title with type and service, date, duration, severity, MTTR, services,
    executive summary, impact by the service's tier (C-10), timeline, primary root cause, contributing factors, the two
    fixed lists and the action items.

    `factors`: incident_id, rank, hypothesis (ranked; the first is the primary cause, the others contribute). `steps`: the
    plan's steps (incident_id, step_id, action, owner, priority)."""
    from emberwatch.operators.correlate import blast_radius
    from emberwatch.operators.serve import mttr_col

    def lines(df, order, line, out):
        per = df.groupBy(F.col("incident_id").alias("__id")).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))).alias("__l"))
        return per.select("__id", F.array_join(F.transform("__l", lambda x: x["l"]), "\n").alias(out))

    tables = [lines(facts, "pos", F.col("line"), "timeline"),
              lines(factors.where("rank > 1"), "rank", F.concat(F.lit("- "), F.col("hypothesis")), "contributing"),
              lines(steps, "step_id", F.concat(F.lit("| "), F.col("action"), F.lit(" | "), F.col("owner"), F.lit(" | "), F.col("priority"), F.lit(" |")), "actions")]
    j = inc.withColumn("source_service", F.coalesce(F.element_at("affected_services", 1), F.lit("unknown")))
    j = blast_radius(j.withColumn("cascade", F.expr("slice(affected_services, 2, greatest(size(affected_services) - 1, 0))")), registry)
    for t in tables:
        j = j.join(t, F.col("id") == F.col("__id"), "left").drop("__id")
    service = F.col("source_service")
    minutes = F.coalesce(mttr_col().cast("string"), F.lit("N/A"))
    cause = F.coalesce(F.nullif("top_root_cause", F.lit("")), F.lit("Under investigation"))
    ended = F.when(F.col("resolution_time").isNotNull(), F.concat(F.lit("It was resolved after "), minutes, F.lit(" minutes."))
                   ).otherwise(F.lit("It is not resolved yet."))
    listed = lambda items: "\n".join(f"- {x}" for x in items)
    improve = F.replace(F.lit(listed(K.REPORT_IMPROVE)), F.lit("{type}"), F.col("anomaly_type"))
    parts = [
        "# Postmortem: ", F.col("anomaly_type"), " on ", service, "\n\n**Date:** ", F.substring(time_label("detection_time"), 1, 10),
        "\n**Duration:** ", minutes, " minutes\n**Severity:** ", F.col("severity"), "\n**MTTR:** ", minutes,
        " minutes\n**Services:** ", F.array_join("affected_services", ", "), "\n**Detected:** ", time_label("detection_time"),
        "\n**Resolved:** ", time_label("resolution_time"), "\n\n---\n\n## Executive Summary\n\n", F.col("severity"), " ", F.col("anomaly_type"),
        " on ", service, " at ", time_label("detection_time"), ". ", F.coalesce("description", F.lit("")), "\n", ended, " Root cause: ", cause,
        "\n\n---\n\n## Impact\n\n- Affected services: ", F.array_join("blast_affected", ", "), "\n- Criticality: ", F.col("primary_service_criticality"),
        "\n- Users: ", F.col("estimated_user_impact"), "\n- Revenue: ", F.col("estimated_revenue_impact"),
        "\n\n---\n\n## Timeline\n\n", F.coalesce(F.col("timeline"), F.lit("")),
        "\n\n---\n\n## Root Cause\n\n**Primary Root Cause:** ", cause,
        "\n\n---\n\n## Contributing Factors\n\n", F.coalesce("contributing", F.lit("- None identified")),
        "\n\n---\n\n## What Went Well\n\n", listed(K.REPORT_WENT_WELL), "\n\n---\n\n## What Could Be Improved\n\n", improve,
        "\n\n---\n\n## Action Items\n\n| Action | Owner | Priority |\n|---|---|---|\n", F.coalesce("actions", F.lit("")),
        "\n\n---\n\nIncident ID: ", F.col("id").cast("string"), "\n"]
    md = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    return j.select(F.col("id").alias("incident_id"), md.alias("markdown"))


def delivery_rows(notifs: DataFrame, status: F.Column) -> DataFrame:
    """N-07: delivery log rows; a status outside the enum is recorded as FAILED."""
    st = F.when(status.isin(*K.EMAIL_STATUSES), status).otherwise(F.lit("FAILED"))
    return notifs.select("incident_id", "notification_type", "recipients", subject().alias("subject"),
                         st.alias("status"))
