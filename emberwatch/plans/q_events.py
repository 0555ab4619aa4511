"""Registered source/sink queries (S-01, S-03, S-04, S-09..S-11, S-13)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberwatch.operators import detect as D
from emberwatch.operators import tables as S
from emberwatch.plans.catalog import register
from emberwatch.plans.q_detect import GAP_S, TTL_S, anomalies_body
from emberwatch.session import ensure_checkpoint_dir
from emberwatch.sources import adapters as A
from emberwatch.sources import events as E
from emberwatch.sources.tables import table


def _json_lines(spark, sf):
    """Raw topic payloads derived from the events table: metric events as JSON, signups as junk."""
    m = A.metrics(spark, sf)
    good = m.select(F.to_json(F.struct(
        F.col("event_id").cast("string").alias("event_id"), F.lit("METRIC").alias("event_type"), "source_service",
        F.lit("production").alias("environment"), F.col("ts").alias("timestamp"), "metric_name", "metric_value"))
        .alias("value"))
    junk = (table(spark, sf, "events").where(F.col("event_type") == "signup")
            .select(F.concat(F.lit("not json {"), F.col("props")).alias("value")))
    return good.unionByName(junk)


@register("s01_read_events", A.with_adapters(
    "SELECT event_id::VARCHAR AS event_id, 'METRIC' AS event_type, source_service, 'production' AS environment, "
    "ts AS timestamp, metric_name, metric_value FROM metrics", "metrics"), doubles=("metric_value",))
def q_read_events(spark, sf):
    good, _ = E.decode(_json_lines(spark, sf), E.RAW_METRIC)
    return good.drop("labels")


@register("s01_read_events_rejects", "SELECT count(*) AS rejected FROM events WHERE event_type = 'signup'")
def q_read_rejects(spark, sf):
    _, bad = E.decode(_json_lines(spark, sf), E.RAW_METRIC)
    return bad.agg(F.count("*").alias("rejected"))


class _Killed(RuntimeError):
    """Stops a query between writing a batch and committing it."""


def _ingested(spark, sf):
    """Raw messages with junk and a second copy of every third event, as files of a topic folder; the stream is killed
    after its second batch is written and started again."""
    from pyspark.errors import StreamingQueryException

    base = _scratch(spark, "s01s")
    raw = _json_lines(spark, sf)
    twice = raw.where(F.pmod(F.xxhash64("value"), F.lit(3)) == 0).where(F.col("value").startswith("{"))
    raw.unionByName(twice).repartition(6, F.xxhash64("value", F.rand(3))).write.text(f"{base}/in")

    def kill(number):
        if number == 1:
            raise _Killed("between writing a batch and committing it")

    def run(after_write=None):
        stream = E.read_events(spark, f"{base}/in", max_files_per_trigger=2)
        query = E.ingest_stream(stream, E.RAW_METRIC, f"{base}/events", f"{base}/rejects", f"{base}/ckpt", keys=["event_id"],
                                after_write=after_write)
        query.awaitTermination()

    try:
        run(kill)
    except StreamingQueryException as stopped:
        if "between writing a batch" not in str(stopped):
            raise
    run()
    return base


@register("s01_ingest_stream", A.with_adapters(
    "SELECT event_id::VARCHAR AS event_id, 'METRIC' AS event_type, source_service, 'production' AS environment, "
    "ts AS timestamp, metric_name, metric_value FROM metrics", "metrics"), doubles=("metric_value",))
def q_ingest_stream(spark, sf):
    """Each event once, whatever the copies and the restart."""
    return spark.read.schema(E.RAW_METRIC).parquet(f"{_ingested(spark, sf)}/events").drop("labels", "batch")


@register("s01_ingest_stream_rejects", "SELECT count(*) AS rejected FROM events WHERE event_type = 'signup'")
def q_ingest_rejects(spark, sf):
    return spark.read.schema("raw string").parquet(f"{_ingested(spark, sf)}/rejects").agg(F.count("*").alias("rejected"))


@register("s05_resume_pages", A.with_adapters("SELECT id, service_name, deployed_at FROM deployments", "deployments"))
def q_resume_pages(spark, sf):
    """The whole table page by page, with the cursor read anew for each page and one page lost before its commit."""
    from emberwatch.session import stage

    rows = stage(A.deployments(spark, sf).select("id", "service_name", "deployed_at"), "s05")
    base = _scratch(spark, "s05")
    limit = max(50, -(-rows.count() // 8))
    lost = False
    while True:
        cursor = S.Cursor(spark, f"{base}/cursor")  # as after a restart
        number = cursor.number
        cursor.next_page(rows, limit=limit).write.mode("overwrite").parquet(f"{base}/pages/page={number}")
        if number == 2 and not lost:
            lost = True  # written, not committed: the next run reads the same page into the same folder
            continue
        if not cursor.commit(spark.read.parquet(f"{base}/pages/page={number}")):
            break
    return spark.read.parquet(f"{base}/pages").drop("page")


_CONFORM_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType(), False),
    T.StructField("event_type", T.StringType()),
    T.StructField("source_service", T.StringType()),
    T.StructField("environment", T.StringType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("metric_value", T.DoubleType()),
])


def _conform(spark, sf):
    ev = table(spark, sf, "events")
    raw = ev.select(F.col("event_id").cast("string").alias("event_id"), "event_type",
                    F.when(F.col("user_id") % 9 != 0, A.svc("user_id")).alias("source_service"),
                    A.epoch_ms("ts").alias("timestamp"), F.col("value").alias("metric_value"))
    return E.conform(raw, _CONFORM_SCHEMA,
                     defaults={"source_service": F.lit("unknown"), "environment": F.lit("production"),
                               "metric_value": F.lit(0.0)},
                     enums={"event_type": ["view", "click", "purchase", "error"]})


_CONFORM_SQL = f"""SELECT event_id::VARCHAR AS event_id, event_type,
        coalesce(CASE WHEN user_id % 9 <> 0 THEN {A._svc_sql('user_id')} END, 'unknown') AS source_service,
        'production' AS environment, epoch_us(ts) // 1000 AS timestamp, coalesce(value, 0.0) AS metric_value
    FROM events"""


@register("s03_conform", f"SELECT * FROM ({_CONFORM_SQL}) WHERE event_type IN ('view', 'click', 'purchase', 'error')",
          doubles=("metric_value",))
def q_conform(spark, sf):
    return _conform(spark, sf)[0]


@register("s03_conform_rejects", f"SELECT event_id, 'bad event_type' AS reason FROM ({_CONFORM_SQL}) "
                                 "WHERE event_type IS NULL OR event_type NOT IN ('view', 'click', 'purchase', 'error')")
def q_conform_rejects(spark, sf):
    return _conform(spark, sf)[1].select("event_id", "reason")


def _scratch(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("s04_write_events", A.with_adapters("SELECT * FROM metrics", "metrics"), doubles=("metric_value",))
def q_write_events(spark, sf):
    path = _scratch(spark, "s04")
    E.write_events(A.metrics(spark, sf), path, key="source_service", mode="overwrite")
    return spark.read.parquet(path)


@register("s04_encode", A.with_adapters(
    "SELECT source_service AS key, event_id, metric_name, ts FROM metrics", "metrics"))
def q_encode(spark, sf):
    """The keyed records of a topic, read back through the decoder."""
    m = A.metrics(spark, sf).select("event_id", "source_service", "metric_name", "ts")
    e = E.encode(m)
    good, _ = E.decode(e.select(F.to_json(F.struct("key", F.from_json("value", m.schema).alias("row"))).alias("value")),
                       T.StructType([T.StructField("key", T.StringType()), T.StructField("row", m.schema)]))
    return good.select("key", "row.event_id", "row.metric_name", "row.ts")


@register("s09_nested_json", A.with_adapters("SELECT * FROM deployments", "deployments"))
def q_nested_json(spark, sf):
    """Pretty-printed documents {"deployments": [ ... ]} of up to 500 entries, one file each."""
    path = _scratch(spark, "s09")
    dep = A.deployments(spark, sf)
    docs = dep.groupBy(F.floor(F.col("id") / 500).alias("p"), F.pmod(F.xxhash64("id"), F.lit(4)).alias("q")).agg(
        F.collect_list(F.struct(*dep.columns)).alias("deployments"))
    text = F.to_json(F.struct("deployments"), {"pretty": "true"})
    docs.select("p", "q", text.alias("value")).write.mode("overwrite").partitionBy("p", "q").text(path)
    return E.load_nested_json(spark, path + "/*/*", "deployments", element=T.StructType(
        [T.StructField(f.name, f.dataType) for f in dep.schema.fields]))


@register("s10_markdown_loader", A.with_adapters("SELECT stem, text || chr(10) AS text FROM markdown_docs", "markdown_docs"))
def q_markdown(spark, sf):
    """One file per document (whose text ends with a line break), spread over folders that are listed side by side."""
    path = _scratch(spark, "s10")
    E.write_markdown(A.markdown_docs(spark, sf), path)
    return E.load_markdown(spark, path + "/*")


@register("s11_audit_rows", A.with_adapters(
    "SELECT incident_id, 'detection-agent' AS agent_name, 'ANOMALY_DETECTED' AS event_type, "
    "to_json({'metric': trigger_metric, 'service': source_service, 'detection_time': detection_time})::VARCHAR "
    "AS payload, detection_time AS created_at FROM anoms", "metrics", extra={"anoms": anomalies_body(GAP_S, TTL_S)}))
def q_audit(spark, sf):
    a = D.detect(A.metrics(spark, sf), gap_s=GAP_S, ttl_s=TTL_S)
    a = a.withColumn("metric", F.col("trigger_metric")).withColumn("service", F.col("source_service"))
    return S.audit_rows(a, incident_col="incident_id", agent="detection-agent", event_type="ANOMALY_DETECTED",
                        payload_cols=["metric", "service", "detection_time"], created_col="detection_time")


def _raw_deploys(spark, sf):
    d = A.deployments(spark, sf)
    return d.select(F.col("service_name").alias("source_service"), "version",
                    F.when(F.col("id") % 2 == 0, F.col("deployed_by")).alias("deployed_by"),
                    F.when(F.col("id") % 5 != 0, F.col("change_type")).alias("change_type"),
                    F.lit(None).cast("string").alias("git_sha"), "description", "known_risks",
                    F.col("deployed_at").alias("timestamp"))


@register("s13_deployment_rows", A.with_adapters("""
    SELECT service_name, version, CASE WHEN id % 2 = 0 THEN deployed_by ELSE 'ci-cd-pipeline' END AS deployed_by,
           CASE WHEN id % 5 <> 0 THEN change_type ELSE 'CODE' END AS change_type, '' AS git_sha, description,
           known_risks, deployed_at FROM deployments""", "deployments"))
def q_deploy_rows(spark, sf):
    return S.deployment_rows(_raw_deploys(spark, sf))
