"""Adapters from the given tables to the event/table shapes the operators take.

Each adapter is one `select` (plus a filter), written twice: as a DataFrame here and as
DuckDB SQL in `ADAPTER_SQL`, so every oracle query runs on exactly the same input.
All times leave an adapter as epoch-ms bigint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberwatch import constants as K
from emberwatch.functions.columns import detect_level, epoch_ms, ntz_from_ms
from emberwatch.sources.tables import table

_CHANGE_TYPES = ["CODE", "CONFIG", "DEPENDENCY", "INFRASTRUCTURE"]
_AGENTS = {"A": "detection-agent", "N": "correlation-agent", "R": "investigation-agent"}


def _pick(values: list[str], idx: Column) -> Column:
    """values[idx] with a 0-based integer index column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def svc(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return _pick(K.SERVICES, c % 6)


def _between(ev: DataFrame, since_ms: int | None, until_ms: int | None) -> DataFrame:
    """Bounds on the stored timestamp itself (the bound is converted, not the column), so they reach the scan."""
    if since_ms is not None:
        ev = ev.where(F.col("ts") >= ntz_from_ms(F.lit(since_ms)))
    if until_ms is not None:
        ev = ev.where(F.col("ts") < ntz_from_ms(F.lit(until_ms + 1)))  # a stored time may have microseconds
    return ev


def metrics(spark: SparkSession, sf_dir: str, since_ms: int | None = None, until_ms: int | None = None) -> DataFrame:
    ev = _between(table(spark, sf_dir, "events").where(F.col("event_type") != "signup"), since_ms, until_ms)
    name = (
        F.when(F.col("event_type") == "view",
               F.when(F.col("user_id") % 4 < 2, "service_latency_p99_ms").otherwise("service_db_connections"))
        .when(F.col("event_type") == "click", "service_cpu_percent")
        .when(F.col("event_type") == "purchase", "service_memory_percent")
        .when(F.col("event_type") == "error", "service_error_rate_percent")
    )
    return ev.select(
        F.col("event_id"),
        svc("user_id").alias("source_service"),
        name.alias("metric_name"),
        F.col("value").alias("metric_value"),
        epoch_ms("ts").alias("ts"),
    )


def _log_message() -> Column:
    word = (
        F.when((F.col("event_type") == "error") & (F.col("event_id") % 10 == 0), "FATAL:")
        .when(F.col("event_type") == "error", "ERROR:")
        .when(F.col("event_type") == "click", "WARN:")
        .otherwise("ok:")
    )
    return F.concat(word, F.lit(" "), F.col("event_type"), F.lit(" "), F.coalesce(F.col("props"), F.lit("")))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    msg = _log_message()
    return ev.select(
        F.col("event_id"),
        svc("user_id").alias("source_service"),
        detect_level(msg).alias("level"),
        msg.alias("message"),
        epoch_ms("ts").alias("ts"),
    )


def deployments(spark: SparkSession, sf_dir: str, since_ms: int | None = None, until_ms: int | None = None) -> DataFrame:
    ev = _between(table(spark, sf_dir, "events").where(F.col("event_type") == "signup"), since_ms, until_ms)
    risks = F.when(F.col("event_id") % 3 == 0,
                   F.array(F.concat(F.lit("risk "), (F.col("event_id") % 5).cast("string")))
                   ).otherwise(F.array().cast("array<string>"))
    return ev.select(
        F.col("event_id").alias("id"),
        svc("user_id").alias("service_name"),
        F.concat(F.lit("v"), (F.col("event_id") % 7).cast("string"), F.lit("."), F.col("user_id").cast("string"))
        .alias("version"),
        F.lit("ci-cd-pipeline").alias("deployed_by"),
        _pick(_CHANGE_TYPES, F.col("event_id") % 4).alias("change_type"),
        F.coalesce(F.col("props"), F.lit("")).alias("description"),
        risks.alias("known_risks"),
        epoch_ms("ts").alias("deployed_at"),
    )


REGISTRY_SCHEMA = T.StructType([
    T.StructField("service_name", T.StringType()),
    T.StructField("team_owner", T.StringType()),
    T.StructField("criticality", T.StringType()),
    T.StructField("sla_p99_latency_ms", T.LongType()),
    T.StructField("sla_error_rate_pct", T.DoubleType()),
    T.StructField("on_call_rotation", T.StringType()),
    T.StructField("slack_channel", T.StringType()),
    T.StructField("upstream_services", T.ArrayType(T.StringType())),
    T.StructField("downstream_services", T.ArrayType(T.StringType())),
])


def registry(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    """The 6-row service registry (a fixed dimension), to be broadcast: a shuffle by service would put all rows of a service
    into one task."""
    return F.broadcast(spark.createDataFrame([tuple(r) for r in K.REGISTRY], REGISTRY_SCHEMA))


def service_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry as large as the tables: suppliers are services, and a service calls the one that follows it in an
    order's lines. Same columns as `registry`."""
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    li = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey")
    edges = (li.select(F.col("l_suppkey").alias("a"), F.lead("l_suppkey").over(w).alias("b"))
             .where(F.col("b").isNotNull() & (F.col("a") != F.col("b"))).distinct())
    name = lambda c: F.concat(F.lit("svc-"), F.col(c).cast("string"))
    names = lambda c: F.sort_array(F.collect_list(name(c)))
    down = edges.groupBy(F.col("a").alias("s_suppkey")).agg(names("b").alias("down"))
    up = edges.groupBy(F.col("b").alias("s_suppkey")).agg(names("a").alias("up"))
    none = F.array().cast("array<string>")
    key = F.col("s_suppkey")
    return (s.join(n, "s_nationkey", "left").join(down, "s_suppkey", "left").join(up, "s_suppkey", "left").select(
        name("s_suppkey").alias("service_name"),
        F.concat(F.lit("team "), F.coalesce(F.col("n_name"), F.lit("?"))).alias("team_owner"),
        F.when(F.col("s_acctbal") >= 6000, "CRITICAL").when(F.col("s_acctbal") >= 3000, "HIGH").otherwise("MEDIUM").alias("criticality"),
        (key % 10 * 100 + 100).cast("long").alias("sla_p99_latency_ms"),
        ((key % 4 + 1) / F.lit(2.0)).alias("sla_error_rate_pct"),
        F.concat(F.lit("oncall-"), (key % 7).cast("string")).alias("on_call_rotation"),
        F.concat(F.lit("#svc-"), key.cast("string")).alias("slack_channel"),
        F.coalesce("up", none).alias("upstream_services"), F.coalesce("down", none).alias("downstream_services")))


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    status = (F.when(F.col("o_orderstatus") == "F", "RESOLVED")
              .when(F.col("o_orderstatus") == "O", "DETECTING")
              .otherwise("RCA_COMPLETE"))
    severity = (F.when(F.col("o_orderpriority") == "1-URGENT", "CRITICAL")
                .when(F.col("o_orderpriority") == "2-HIGH", "HIGH")
                .when(F.col("o_orderpriority") == "3-MEDIUM", "MEDIUM")
                .otherwise("LOW"))
    det = epoch_ms("o_orderdate")
    has_rca = F.col("o_orderstatus") != "O"
    return o.select(
        key.alias("id"),
        severity.alias("severity"),
        _pick(K.ANOMALY_TYPES[:6], key % 6).alias("anomaly_type"),
        F.array(svc("o_custkey")).alias("affected_services"),
        status.alias("status"),
        det.alias("detection_time"),
        F.when(F.col("o_orderstatus") == "F", det + (key % 240) * 60000).alias("resolution_time"),
        F.when(has_rca, F.concat(F.lit("cause "), (key % 9).cast("string"))).alias("top_root_cause"),
        F.when(has_rca, (key % 101) / F.lit(100.0)).alias("rca_confidence"),
        _pick(K.METRIC_NAMES[:5], key % 5).alias("trigger_metric"),
        (F.col("o_totalprice") / 1000.0).alias("baseline_value"),
        F.concat(F.lit("incident "), key.cast("string")).alias("description"),
    )


def agent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("long").cast("string")
    flag = F.col("l_returnflag")
    agent = F.when(flag == "A", _AGENTS["A"]).when(flag == "N", _AGENTS["N"]).otherwise(_AGENTS["R"])
    etype = (F.when(flag == "A", "ANOMALY_DETECTED")
             .when(flag == "N", "CORRELATION_COMPLETE")
             .otherwise(F.when(F.col("l_linestatus") == "F", "RCA_COMPLETE").otherwise("REMEDIATION_PLANNED")))
    metric = _pick(K.METRIC_NAMES[:5], F.col("l_partkey") % 5)
    payload = (
        F.when(flag == "A", F.concat(F.lit('{"metric": "'), metric, F.lit('", "zscore": '), q, F.lit("}")))
        .when(flag == "N", F.concat(F.lit('{"signals_found": '), q, F.lit("}")))
        .otherwise(F.when(F.col("l_linestatus") == "F",
                          F.concat(F.lit('{"top_hypothesis": "hypothesis '), q, F.lit('"}')))
                   .otherwise(F.concat(F.lit('{"steps": '), q, F.lit("}"))))
    )
    return li.select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")])
        .alias("id"),
        F.col("l_orderkey").alias("incident_id"),
        agent.alias("agent_name"),
        etype.alias("event_type"),
        payload.alias("payload"),
        epoch_ms("l_shipdate").alias("created_at"),
    )


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where(F.col("l_linenumber") == 1)
    kind = (F.when(F.col("l_returnflag") == "A", "INCIDENT_OPENED")
            .when(F.col("l_returnflag") == "N", "RCA_COMPLETE").otherwise("INCIDENT_RESOLVED"))
    return li.select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey")]).alias("id"),
        F.col("l_orderkey").alias("incident_id"),
        kind.alias("notification_type"),
        F.when(F.col("l_returnflag") == "R", F.array(*[F.lit(x) for x in K.ALL_RECIPIENTS]))
        .otherwise(F.array(*[F.lit(x) for x in K.ONCALL])).alias("recipients"),
        F.concat(F.lit("[INC-"), F.col("l_orderkey").cast("string"), F.lit("] "), kind).alias("subject"),
        F.when(F.col("l_linestatus") == "F", "SENT").otherwise("FAILED").alias("status"),
        epoch_ms("l_shipdate").alias("sent_at"),
    )


def postmortems(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 2 == 0))
    key = F.col("o_orderkey")
    return o.select(
        key.alias("incident_id"),
        F.concat(F.lit("Postmortem INC-"), key.cast("string")).alias("title"),
        F.concat(F.lit("# Postmortem\n\n## Executive Summary\n\nIncident "), key.cast("string"),
                 F.lit(" was resolved.\n  Impact was limited.\n\n## Contributing Factors\n\n- factor "),
                 (key % 7).cast("string"), F.lit("\n- Action owner: team "), (key % 3).cast("string"),
                 F.lit("\n\n## Preventative Actions\n\n- add alert "), (key % 5).cast("string"),
                 F.lit("\n\n## Root Cause\n\ncause "), (key % 9).cast("string"), F.lit("\n")).alias("full_markdown"),
        F.concat(F.lit("Summary for incident "), key.cast("string")).alias("executive_summary"),
        F.concat(F.lit("cause "), (key % 9).cast("string")).alias("root_cause"),
        ((key % 240)).cast("double").alias("mttr_minutes"),
        epoch_ms("o_orderdate").alias("generated_at"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    vid = F.col("vec_id")
    return e.select(
        vid.alias("chunk_id"),
        (vid / 4).cast("long").alias("doc_id"),
        svc("label").alias("service_name"),
        _pick(K.ANOMALY_TYPES[:6], F.col("label") % 6).alias("anomaly_type"),
        _pick(K.BUDGET_ORDER, F.col("label") % 5).alias("collection"),
        F.lit("production").alias("environment"),
        (vid % 5 != 0).alias("resolved"),
        (vid * 3600).alias("epoch"),
        F.concat(F.lit("chunk "), vid.cast("string"), F.lit(" of doc "), (vid / 4).cast("long").cast("string"))
        .alias("content"),
        F.col("embedding"),
    )


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query side of top-k: the incident batch searching the corpus (every 50th vector)."""
    e = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 50 == 0)
    vid = F.col("vec_id")
    return e.select(
        vid.alias("query_id"),
        svc(F.col("label") + 1).alias("q_service"),
        F.array(svc(F.col("label") + 1)).alias("affected_services"),
        _pick(K.ANOMALY_TYPES[:6], F.col("label") % 6).alias("q_type"),
        (vid * 3600 + 7200).alias("query_epoch"),
        F.col("embedding").alias("query_vec"),
    )


def markdown_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    lines = F.split(F.col("text"), "\n")
    body = F.array_join(
        F.transform(lines, lambda x, i: F.when(i % 3 == 0, F.concat(F.lit("## "), x)).otherwise(x)), "\n\n")
    front = F.concat(
        F.lit("---\ntitle: \"doc "), F.col("doc_id").cast("string"), F.lit("\"\n"),
        F.lit("services: [\""), svc("doc_id"), F.lit("\"]\n"),
        F.lit("anomaly_types: [\""), _pick(K.ANOMALY_TYPES[:6], F.col("doc_id") % 6), F.lit("\"]\n"),
        F.lit("lang: "), F.col("lang"), F.lit("\nsource: "), F.col("source"), F.lit("\n---\n"),
    )
    return d.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("stem"),
        F.concat(front, body).alias("text"),
    )


def hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    n_ev = (F.col("o_custkey") % 6).cast("int")
    ev = F.when(n_ev > 0, F.transform(F.sequence(F.lit(0), n_ev - 1),
                                      lambda x: F.concat(F.lit("evidence "), x.cast("string"))))\
        .otherwise(F.array().cast("array<string>"))
    n = ((F.col("o_orderkey") % 4) + 1).cast("int")
    return o.select(
        F.col("o_orderkey").alias("incident_id"),
        F.explode(F.sequence(F.lit(1), n)).alias("rank"),
        ev.alias("evidence"),
        (F.col("o_custkey") % 5).alias("similar_count"),
        (F.col("o_orderkey") % 3 == 0).alias("deployment_correlated"),
        (F.col("o_custkey") % 2 == 0).alias("has_runbook"),
        n.cast("long").alias("competing"),
    ).withColumn("hypothesis", F.concat(F.lit("hypothesis "), F.col("rank").cast("string"), F.lit(" for "),
                                        F.col("incident_id").cast("string")))\
        .withColumn("rank", F.col("rank").cast("long"))


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial-update log for S-08; `severity` is present but not allow-listed."""
    li = table(spark, sf_dir, "lineitem")
    flag = F.col("l_returnflag")
    return li.select(
        F.col("l_orderkey").alias("id"),
        epoch_ms("l_shipdate").alias("seq_ts"),
        F.col("l_partkey").alias("seq_part"),
        F.col("l_suppkey").alias("seq_supp"),
        F.col("l_linenumber").cast("long").alias("seq_line"),
        F.when(flag == "R", "RESOLVED").when(flag == "A", "RCA_COMPLETE").alias("status"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("cause "), F.col("l_partkey").cast("string")))
        .alias("top_root_cause"),
        F.when(F.col("l_linenumber") % 3 == 0, (F.col("l_discount") * 10)).alias("rca_confidence"),
        F.when(flag == "R", epoch_ms("l_shipdate")).alias("resolution_time"),
        F.lit("LOW").alias("severity"),
    )


# ---------------------------------------------------------------- DuckDB twins

_SVC_SQL = "[" + ", ".join(f"'{s}'" for s in K.SERVICES) + "]"
_TYPES6_SQL = "[" + ", ".join(f"'{s}'" for s in K.ANOMALY_TYPES[:6]) + "]"
_COLL_SQL = "[" + ", ".join(f"'{s}'" for s in K.BUDGET_ORDER) + "]"
_METRICS5_SQL = "[" + ", ".join(f"'{s}'" for s in K.METRIC_NAMES[:5]) + "]"
_EPOCH = "epoch_ms({})"


def _svc_sql(expr: str) -> str:
    return f"{_SVC_SQL}[(({expr}) % 6) + 1]"


def _registry_values() -> str:
    rows = []
    for (name, team, crit, p99, err, oncall, slack, up, down) in K.REGISTRY:
        up_sql = "[" + ", ".join(f"'{u}'" for u in up) + "]::VARCHAR[]"
        down_sql = "[" + ", ".join(f"'{d}'" for d in down) + "]::VARCHAR[]"
        rows.append(f"('{name}', '{team}', '{crit}', {p99}::BIGINT, {err}::DOUBLE, '{oncall}', '{slack}', "
                    f"{up_sql}, {down_sql})")
    return ("SELECT * FROM (VALUES " + ", ".join(rows) + ") AS r(service_name, team_owner, criticality, "
            "sla_p99_latency_ms, sla_error_rate_pct, on_call_rotation, slack_channel, upstream_services, "
            "downstream_services)")


_LOG_MSG = ("(CASE WHEN event_type = 'error' AND event_id % 10 = 0 THEN 'FATAL:' WHEN event_type = 'error' "
            "THEN 'ERROR:' WHEN event_type = 'click' THEN 'WARN:' ELSE 'ok:' END || ' ' || event_type || ' ' "
            "|| coalesce(props, ''))")


def _level_sql(msg: str) -> str:
    u = f"upper({msg})"
    return (f"(CASE WHEN contains({u}, 'FATAL') OR contains({u}, 'PANIC') THEN 'FATAL' "
            f"WHEN contains({u}, 'ERROR') OR contains({u}, 'EXCEPTION') OR contains({u}, 'STACKTRACE') THEN 'ERROR' "
            f"WHEN contains({u}, 'WARN') THEN 'WARN' ELSE 'INFO' END)")


ADAPTER_SQL = {
    "metrics": f"""SELECT event_id, {_svc_sql('user_id')} AS source_service,
        CASE event_type WHEN 'view' THEN (CASE WHEN user_id % 4 < 2 THEN 'service_latency_p99_ms'
                                               ELSE 'service_db_connections' END)
             WHEN 'click' THEN 'service_cpu_percent' WHEN 'purchase' THEN 'service_memory_percent'
             WHEN 'error' THEN 'service_error_rate_percent' END AS metric_name,
        value AS metric_value, (epoch_us(ts) // 1000) AS ts
        FROM events WHERE event_type <> 'signup'""",
    "logs": f"""SELECT event_id, {_svc_sql('user_id')} AS source_service, {_level_sql(_LOG_MSG)} AS level,
        {_LOG_MSG} AS message, (epoch_us(ts) // 1000) AS ts FROM events""",
    "deployments": f"""SELECT event_id AS id, {_svc_sql('user_id')} AS service_name,
        'v' || (event_id % 7)::VARCHAR || '.' || user_id::VARCHAR AS version, 'ci-cd-pipeline' AS deployed_by,
        ['CODE', 'CONFIG', 'DEPENDENCY', 'INFRASTRUCTURE'][(event_id % 4) + 1] AS change_type,
        coalesce(props, '') AS description,
        CASE WHEN event_id % 3 = 0 THEN ['risk ' || (event_id % 5)::VARCHAR] ELSE []::VARCHAR[] END AS known_risks,
        (epoch_us(ts) // 1000) AS deployed_at
        FROM events WHERE event_type = 'signup'""",
    "registry": _registry_values(),
    "service_catalog": """SELECT 'svc-' || s_suppkey::VARCHAR AS service_name, 'team ' || coalesce(n_name, '?') AS team_owner,
        CASE WHEN s_acctbal >= 6000 THEN 'CRITICAL' WHEN s_acctbal >= 3000 THEN 'HIGH' ELSE 'MEDIUM' END AS criticality,
        (s_suppkey % 10 * 100 + 100)::BIGINT AS sla_p99_latency_ms, (s_suppkey % 4 + 1) / 2.0::DOUBLE AS sla_error_rate_pct,
        'oncall-' || (s_suppkey % 7)::VARCHAR AS on_call_rotation, '#svc-' || s_suppkey::VARCHAR AS slack_channel,
        coalesce(u.up, []::VARCHAR[]) AS upstream_services, coalesce(d.down, []::VARCHAR[]) AS downstream_services
        FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey
        LEFT JOIN (SELECT a, list('svc-' || b::VARCHAR ORDER BY 'svc-' || b::VARCHAR) AS down FROM edges GROUP BY a) d ON d.a = s_suppkey
        LEFT JOIN (SELECT b, list('svc-' || a::VARCHAR ORDER BY 'svc-' || a::VARCHAR) AS up FROM edges GROUP BY b) u ON u.b = s_suppkey""",
    "edges": """SELECT DISTINCT a, b FROM (SELECT l_suppkey AS a, lead(l_suppkey) OVER (PARTITION BY l_orderkey
        ORDER BY l_linenumber, l_suppkey) AS b FROM lineitem) WHERE b IS NOT NULL AND a <> b""",
    "incidents": f"""SELECT o_orderkey AS id,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH'
             WHEN '3-MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS severity,
        {_TYPES6_SQL}[(o_orderkey % 6) + 1] AS anomaly_type,
        [{_svc_sql('o_custkey')}] AS affected_services,
        CASE o_orderstatus WHEN 'F' THEN 'RESOLVED' WHEN 'O' THEN 'DETECTING' ELSE 'RCA_COMPLETE' END AS status,
        (epoch_us(o_orderdate) // 1000) AS detection_time,
        CASE WHEN o_orderstatus = 'F' THEN (epoch_us(o_orderdate) // 1000) + (o_orderkey % 240) * 60000 END
            AS resolution_time,
        CASE WHEN o_orderstatus <> 'O' THEN 'cause ' || (o_orderkey % 9)::VARCHAR END AS top_root_cause,
        CASE WHEN o_orderstatus <> 'O' THEN (o_orderkey % 101) / 100.0 END AS rca_confidence,
        {_METRICS5_SQL}[(o_orderkey % 5) + 1] AS trigger_metric,
        o_totalprice / 1000.0 AS baseline_value,
        'incident ' || o_orderkey::VARCHAR AS description
        FROM orders""",
    "agent_events": f"""SELECT concat_ws('-', l_orderkey::VARCHAR, l_partkey::VARCHAR, l_suppkey::VARCHAR,
            l_linenumber::VARCHAR) AS id,
        l_orderkey AS incident_id,
        CASE l_returnflag WHEN 'A' THEN 'detection-agent' WHEN 'N' THEN 'correlation-agent'
             ELSE 'investigation-agent' END AS agent_name,
        CASE WHEN l_returnflag = 'A' THEN 'ANOMALY_DETECTED' WHEN l_returnflag = 'N' THEN 'CORRELATION_COMPLETE'
             WHEN l_linestatus = 'F' THEN 'RCA_COMPLETE' ELSE 'REMEDIATION_PLANNED' END AS event_type,
        CASE WHEN l_returnflag = 'A' THEN '{{"metric": "' || {_METRICS5_SQL}[(l_partkey % 5) + 1]
                 || '", "zscore": ' || l_quantity::BIGINT::VARCHAR || '}}'
             WHEN l_returnflag = 'N' THEN '{{"signals_found": ' || l_quantity::BIGINT::VARCHAR || '}}'
             WHEN l_linestatus = 'F' THEN '{{"top_hypothesis": "hypothesis ' || l_quantity::BIGINT::VARCHAR || '"}}'
             ELSE '{{"steps": ' || l_quantity::BIGINT::VARCHAR || '}}' END AS payload,
        (epoch_us(l_shipdate) // 1000) AS created_at
        FROM lineitem""",
    "emails": """SELECT concat_ws('-', l_orderkey::VARCHAR, l_partkey::VARCHAR, l_suppkey::VARCHAR) AS id,
        l_orderkey AS incident_id,
        CASE l_returnflag WHEN 'A' THEN 'INCIDENT_OPENED' WHEN 'N' THEN 'RCA_COMPLETE'
             ELSE 'INCIDENT_RESOLVED' END AS notification_type,
        CASE WHEN l_returnflag = 'R' THEN """ + "[" + ", ".join(f"'{x}'" for x in K.ALL_RECIPIENTS) + "]"
        + " ELSE [" + ", ".join(f"'{x}'" for x in K.ONCALL) + """] END AS recipients,
        '[INC-' || l_orderkey::VARCHAR || '] ' || (CASE l_returnflag WHEN 'A' THEN 'INCIDENT_OPENED'
             WHEN 'N' THEN 'RCA_COMPLETE' ELSE 'INCIDENT_RESOLVED' END) AS subject,
        CASE WHEN l_linestatus = 'F' THEN 'SENT' ELSE 'FAILED' END AS status,
        (epoch_us(l_shipdate) // 1000) AS sent_at
        FROM lineitem WHERE l_linenumber = 1""",
    "postmortems": """SELECT o_orderkey AS incident_id, 'Postmortem INC-' || o_orderkey::VARCHAR AS title,
        '# Postmortem' || chr(10) || chr(10) || '## Executive Summary' || chr(10) || chr(10) || 'Incident '
            || o_orderkey::VARCHAR || ' was resolved.' || chr(10) || '  Impact was limited.' || chr(10) || chr(10)
            || '## Contributing Factors' || chr(10) || chr(10) || '- factor ' || (o_orderkey % 7)::VARCHAR || chr(10)
            || '- Action owner: team ' || (o_orderkey % 3)::VARCHAR || chr(10) || chr(10)
            || '## Preventative Actions' || chr(10) || chr(10) || '- add alert ' || (o_orderkey % 5)::VARCHAR
            || chr(10) || chr(10)
            || '## Root Cause' || chr(10) || chr(10) || 'cause ' || (o_orderkey % 9)::VARCHAR || chr(10)
            AS full_markdown,
        'Summary for incident ' || o_orderkey::VARCHAR AS executive_summary,
        'cause ' || (o_orderkey % 9)::VARCHAR AS root_cause,
        (o_orderkey % 240)::DOUBLE AS mttr_minutes, (epoch_us(o_orderdate) // 1000) AS generated_at
        FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0""",
    "vectors": f"""SELECT vec_id AS chunk_id, vec_id // 4 AS doc_id, {_svc_sql('label')} AS service_name,
        {_TYPES6_SQL}[(label % 6) + 1] AS anomaly_type,
        {_COLL_SQL}[(label % 5) + 1] AS collection, 'production' AS environment,
        vec_id % 5 <> 0 AS resolved, vec_id * 3600 AS epoch,
        'chunk ' || vec_id::VARCHAR || ' of doc ' || (vec_id // 4)::VARCHAR AS content, embedding
        FROM embeddings""",
    "vector_queries": f"""SELECT vec_id AS query_id, {_svc_sql('label + 1')} AS q_service,
        [{_svc_sql('label + 1')}] AS affected_services,
        {_TYPES6_SQL}[(label % 6) + 1] AS q_type, vec_id * 3600 + 7200 AS query_epoch,
        embedding AS query_vec
        FROM embeddings WHERE vec_id % 50 = 0""",
    "markdown_docs": f"""SELECT 'doc-' || doc_id::VARCHAR AS stem,
        '---' || chr(10) || 'title: "doc ' || doc_id::VARCHAR || '"' || chr(10)
        || 'services: ["' || {_svc_sql('doc_id')} || '"]' || chr(10)
        || 'anomaly_types: ["' || {_TYPES6_SQL}[(doc_id % 6) + 1] || '"]' || chr(10)
        || 'lang: ' || lang || chr(10) || 'source: ' || source || chr(10) || '---' || chr(10)
        || array_to_string(list_transform(string_split(text, chr(10)),
               lambda x, i: CASE WHEN (i - 1) % 3 = 0 THEN '## ' || x ELSE x END), chr(10) || chr(10)) AS text
        FROM documents""",
    "hypotheses": """SELECT incident_id, rank, evidence, similar_count, deployment_correlated, has_runbook,
        competing, 'hypothesis ' || rank::VARCHAR || ' for ' || incident_id::VARCHAR AS hypothesis
        FROM (SELECT o_orderkey AS incident_id, unnest(generate_series(1, (o_orderkey % 4) + 1)) AS rank,
                     list_transform(range(o_custkey % 6), lambda x: 'evidence ' || x::VARCHAR) AS evidence,
                     o_custkey % 5 AS similar_count, o_orderkey % 3 = 0 AS deployment_correlated,
                     o_custkey % 2 = 0 AS has_runbook, (o_orderkey % 4) + 1 AS competing
              FROM orders)""",
    "updates": """SELECT l_orderkey AS id, (epoch_us(l_shipdate) // 1000) AS seq_ts, l_partkey AS seq_part,
        l_suppkey AS seq_supp, l_linenumber::BIGINT AS seq_line,
        CASE l_returnflag WHEN 'R' THEN 'RESOLVED' WHEN 'A' THEN 'RCA_COMPLETE' END AS status,
        CASE WHEN l_linenumber % 2 = 0 THEN 'cause ' || l_partkey::VARCHAR END AS top_root_cause,
        CASE WHEN l_linenumber % 3 = 0 THEN l_discount * 10 END AS rca_confidence,
        CASE WHEN l_returnflag = 'R' THEN (epoch_us(l_shipdate) // 1000) END AS resolution_time,
        'LOW' AS severity
        FROM lineitem""",
}


def with_adapters(sql: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix a query with the adapter CTEs it names, then any extra named CTEs (in order)."""
    parts = [f"{n} AS ({ADAPTER_SQL[n]})" for n in names]
    parts += [f"{n} AS ({body})" for n, body in (extra or {}).items()]
    if not parts:
        return sql
    return "WITH " + ",\n".join(parts) + "\n" + sql
