"""Serving queries Q-01..Q-12 and F-05 MTTR over the incident snapshot and its side tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.operators.tables import apply_updates

ACTIVE_COLS = ["id", "severity", "anomaly_type", "affected_services", "status", "detection_time",
               "top_root_cause", "rca_confidence"]


def mttr_col(detection_ms: str | Column = "detection_time", resolution_ms: str | Column = "resolution_time") -> Column:
    """F-05: whole minutes; seconds are rounded to an integer first, then divided by 60 (truncating)."""
    d = F.col(detection_ms) if isinstance(detection_ms, str) else detection_ms
    r = F.col(resolution_ms) if isinstance(resolution_ms, str) else resolution_ms
    secs = F.round((r - d) / F.lit(1000.0)).cast("long")
    return F.when(r.isNotNull(), (secs / 60).cast("long"))


def mttr(df: DataFrame) -> DataFrame:
    return df.withColumn("mttr_minutes", mttr_col())


def list_incidents(df: DataFrame, *, status: str | None = None, limit: int = 50, offset: int = 0,
                   max_limit: int = 200) -> DataFrame:
    """Q-01: newest first, id as tie-break. A page of more than `max_limit` rows is refused, as by the API."""
    if not 0 <= limit <= max_limit:
        raise ValueError(f"limit must be between 0 and {max_limit}")
    out = df.where(F.col("status") == status) if status else df
    out = out.orderBy(F.col("detection_time").desc(), F.col("id").asc())
    if offset:
        out = out.offset(int(offset))
    return out.limit(limit)


def get_incident(df: DataFrame, incident_id) -> DataFrame:
    """Q-02."""
    return df.where(F.col("id") == F.lit(incident_id))


def active_incidents(df: DataFrame) -> DataFrame:
    """Q-03: the active_incidents view."""
    return df.where(F.col("status") != "RESOLVED").select(*ACTIVE_COLS)\
             .orderBy(F.col("detection_time").desc(), F.col("id"))


def incident_summary(inc: DataFrame, pm: DataFrame, ev: DataFrame, mail: DataFrame, *,
                     literal: bool = False) -> DataFrame:
    """Q-04: incident + postmortem + audit and email counts.

    Each 1:N side is aggregated by incident first (map-side partial counts), so no row product is
    ever built. literal=True reproduces the view's fan-out counts from the same two aggregates:
    COUNT(ae) = n_ae * max(n_en, 1) and COUNT(en) = n_en * max(n_ae, 1)."""
    ae = ev.groupBy("incident_id").agg(F.count("id").alias("n_ae"))
    en = mail.groupBy("incident_id").agg(F.count("id").alias("n_en"))
    p = pm.select("incident_id", F.col("title").alias("postmortem_title"),
                  F.col("executive_summary").alias("postmortem_summary"))
    base = mttr(inc).select("id", "severity", "anomaly_type", "affected_services", "status", "detection_time",
                            "resolution_time", "mttr_minutes", "top_root_cause", "rca_confidence")
    j = (base.join(p, base.id == p.incident_id, "left").drop(p.incident_id)
             .join(ae, base.id == ae.incident_id, "left").drop(ae.incident_id)
             .join(en, base.id == en.incident_id, "left").drop(en.incident_id))
    n_ae = F.coalesce(F.col("n_ae"), F.lit(0))
    n_en = F.coalesce(F.col("n_en"), F.lit(0))
    if literal:
        ae_c = n_ae * F.greatest(n_en, F.lit(1))
        en_c = n_en * F.greatest(n_ae, F.lit(1))
    else:
        ae_c, en_c = n_ae, n_en
    return j.select(*[c for c in j.columns if c not in ("n_ae", "n_en")],
                    ae_c.cast("long").alias("agent_event_count"), en_c.cast("long").alias("email_count"))


def timeline(ev: DataFrame, incident_id=None) -> DataFrame:
    """Q-05: audit events in time order (id tie-break); all incidents when no id is given."""
    out = ev if incident_id is None else ev.where(F.col("incident_id") == F.lit(incident_id))
    w = Window.partitionBy("incident_id").orderBy("created_at", "id")
    return out.withColumn("seq", F.row_number().over(w).cast("long"))


def registry(df: DataFrame) -> DataFrame:
    """Q-06."""
    return df.orderBy("criticality", "service_name")


def kpis(inc: DataFrame, *, newest: int = 50) -> DataFrame:
    """Q-07: dashboard figures over the newest `newest` incidents: critical active, active, resolved,
    mean MTTR over resolved rows with a non-zero MTTR, rounded half up (null when there is none)."""
    top = mttr(inc).orderBy(F.col("detection_time").desc(), F.col("id").asc()).limit(newest)
    active = F.col("status") != "RESOLVED"
    resolved = F.col("status") == "RESOLVED"
    m = F.when(resolved & (F.col("mttr_minutes") != 0), F.col("mttr_minutes"))
    return top.agg(
        F.count(F.when(active & (F.col("severity") == "CRITICAL"), 1)).alias("critical_active"),
        F.count(F.when(active, 1)).alias("active"),
        F.count(F.when(resolved, 1)).alias("resolved"),
        F.floor(F.avg(m) + F.lit(0.5)).cast("long").alias("avg_mttr_minutes"),
    )


def notifications(mail: DataFrame, incident_id=None) -> DataFrame:
    """Q-08: newest first."""
    out = mail if incident_id is None else mail.where(F.col("incident_id") == F.lit(incident_id))
    return out.orderBy(F.col("sent_at").desc(), F.col("id"))


def postmortem(pm: DataFrame, incident_id) -> DataFrame:
    """Q-09."""
    return pm.where(F.col("incident_id") == F.lit(incident_id))


def resolve(inc: DataFrame, requests: DataFrame) -> DataFrame:
    """Q-10: manual resolve; only rows not already RESOLVED change. `requests` (id, requested_at)."""
    req = requests.groupBy("id").agg(F.min("requested_at").alias("requested_at"))
    open_req = (inc.select("id", "status").where(F.col("status") != "RESOLVED").join(req, "id")
                .select("id", F.lit("RESOLVED").alias("status"), F.col("requested_at").alias("resolution_time"),
                        F.col("requested_at").alias("seq")))
    return apply_updates(inc, open_req, keys=["id"], seq="seq", allowed=["status", "resolution_time"])


def touching(inc: DataFrame, service: str) -> DataFrame:
    """Q-11: incidents whose affected services contain `service`."""
    return inc.where(F.array_contains("affected_services", service))


def activity(ev: DataFrame) -> DataFrame:
    """Q-12: counters by agent and event type."""
    return ev.groupBy("agent_name", "event_type").agg(F.count("*").alias("events"))
