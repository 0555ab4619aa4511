"""Registered streaming queries: each runs its stream to completion (availableNow) over files derived
from the given tables, then returns the sink as a DataFrame. Rows lie in the files out of order, up to the watermark's
delay; the oracle is the batch twin's SQL, so this is the batch/stream parity check."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from emberwatch.plans import q_correlate as QC
from emberwatch.plans import q_detect as QD
from emberwatch.plans.catalog import register
from emberwatch.session import ensure_checkpoint_dir, stage
from emberwatch.sources import adapters as A
from emberwatch.streaming import stream as ST

_METRIC_SCHEMA = "event_id long, source_service string, metric_name string, metric_value double, ts long"
_LOG_SCHEMA = "event_id long, source_service string, level string, message string, ts long"


def _scratch(spark, name):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


PARTS = 3            # slices of time that the files are read in
AFTER_MS = 400 * 86_400_000  # how far behind the last row the closing heartbeat lies: past every gap, lock and limit


def shuffled_files(df, path, parts: int = PARTS) -> str:
    """Stage the input as JSON files read one slice after another, with each row delayed by up to a slice (by a hash of
    the row), so that a slice holds rows of two in any order; then a heartbeat that closes the stream. Returns the delay
    of a watermark that no row is behind."""
    spark = df.sparkSession
    lo, hi = df.agg(F.min("ts"), F.max("ts")).first()
    if lo is None:  # no input rows: an empty folder still defines the stream
        df.write.mode("append").json(path)
        return "1 minute"
    step = (hi - lo) // parts + 1
    held = F.pmod(F.xxhash64(*df.columns), F.lit(step))
    part = F.floor((F.col("ts") - lo + held) / F.lit(step)).cast("int")
    staged = stage(df.withColumn("__part", part).repartition(4, "__part", F.xxhash64(*df.columns)), "stream-input", by=["__part"])
    for i in range(parts + 1):
        staged.where(F.col("__part") == i).drop("__part").write.mode("append").json(path)
    spark.createDataFrame([(hi + 2 * step + AFTER_MS,)], "ts long").write.mode("append").json(path)
    return f"{2 * step + 1} milliseconds"


def _stream_run(spark, src_df, schema, build, name):
    base = _scratch(spark, name)
    delay = shuffled_files(src_df, f"{base}/in")
    stream_in = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).json(f"{base}/in")
    out = build(stream_in, delay)
    ST.run_available_now(out, f"{base}/out", f"{base}/ckpt", late_path=f"{base}/late")
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/out")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):  # nothing was read
        return spark.createDataFrame([], ST.outputs(out).schema)
    late = spark.read.schema("late string").parquet(f"{base}/late").count()
    if late:
        raise RuntimeError(f"{late} rows were behind a watermark that covers the whole disorder")
    return spark.read.schema(ST.outputs(out).schema).parquet(f"{base}/out").drop("batch")


@register("d14_detect_stream", QD.detect_sql(QD.GAP_S, QD.TTL_S), doubles=QD._ANOM_DOUBLES)
def q_detect_stream(spark, sf):
    return _stream_run(spark, A.metrics(spark, sf), _METRIC_SCHEMA,
                       lambda s, d: ST.detect_stream(s, gap_s=QD.GAP_S, ttl_s=QD.TTL_S, delay=d), "d14")


@register("d06_suppress_stream", A.with_adapters(
    "SELECT event_id, source_service, metric_name, ts FROM "
    + QD.suppress_sql("SELECT event_id, source_service, metric_name, ts FROM metrics",
                      keys=["source_service", "metric_name"], tie="event_id", ttl_ms=QD.SAMPLE_TTL_S * 1000),
    "metrics"))
def q_suppress_stream(spark, sf):
    m = A.metrics(spark, sf).select("event_id", "source_service", "metric_name", "ts")
    return _stream_run(spark, m, "event_id long, source_service string, metric_name string, ts long",
                       lambda s, d: ST.suppress_stream(s, keys=["source_service", "metric_name"], tie="event_id",
                                                       ttl_s=QD.SAMPLE_TTL_S, delay=d), "d06s")


@register("d10_log_bursts_stream",
          "SELECT source_service, detection_time, severity, error_count, description FROM ("
          + QD._bursts_sql(QD.BURST_GAP_S, QD.TTL_S) + ") AS b")
def q_bursts_stream(spark, sf):
    out = _stream_run(spark, A.logs(spark, sf), _LOG_SCHEMA,
                      lambda s, d: ST.log_bursts_stream(s, gap_s=QD.BURST_GAP_S, ttl_s=QD.TTL_S, delay=d), "d10s")
    return out.select("source_service", "detection_time", "severity", "error_count", "description")


@register("c01_incident_lock_stream", QC._sql(
    f"SELECT incident_id, source_service, detection_time FROM {QC.lock_sql('anoms')}"))
def q_lock_stream(spark, sf):
    """Anomaly events and their resolution events (from the batch recovery rule) as one keyed stream."""
    from emberwatch.operators import correlate as C

    a = QC._anoms(spark, sf)
    rec = C.recovery(a, A.metrics(spark, sf), limit_min=QC.REC_MIN)
    ev = (a.select("incident_id", "source_service", F.lit("anomaly").alias("kind"), F.col("detection_time").alias("ts"))
          .unionByName(rec.select("incident_id", "source_service", F.lit("resolved").alias("kind"),
                                  F.col("resolved_at").alias("ts"))))
    out = _stream_run(spark, ev, "incident_id string, source_service string, kind string, ts long",
                      lambda s, d: ST.incident_lock_stream(s, lock_s=QC.LOCK_S, delay=d), "c01s")
    return out.select("incident_id", "source_service", "detection_time")


@register("f04_recovery_stream", QC._sql(QC.rec_sql("anoms")))
def q_recovery_stream(spark, sf):
    """Samples and anomalies as one keyed stream; incidents that do not recover end by a timer."""
    a = QC._anoms(spark, sf)
    m = A.metrics(spark, sf)
    none = lambda t: F.lit(None).cast(t)
    samples = m.select("source_service", "metric_name", F.lit("sample").alias("kind"), "ts", F.col("event_id").cast("long"),
                       none("string").alias("incident_id"), F.col("metric_value").alias("value"))
    found = a.select("source_service", F.col("trigger_metric").alias("metric_name"), F.lit("anomaly").alias("kind"),
                     F.col("detection_time").alias("ts"), none("long").alias("event_id"), "incident_id",
                     F.col("baseline_value").alias("value"))
    return _stream_run(spark, samples.unionByName(found), "source_service string, metric_name string, kind string, ts long, event_id long, "
                       "incident_id string, value double", lambda s, d: ST.recovery_stream(s, limit_min=QC.REC_MIN, delay=d), "f04s")


@register("c01_incidents_stream", QC._sql(f"""
    SELECT 'opened' AS kind, o.incident_id, o.source_service, o.trigger_metric, o.detection_time, NULL::BIGINT AS resolved_at,
           NULL::BOOLEAN AS recovered FROM {QC.lock_sql('anoms')} o
    UNION ALL
    SELECT 'resolved', r.incident_id, r.source_service, r.trigger_metric, r.detection_time, r.resolved_at, r.recovered
    FROM ({QC.rec_sql('anoms')}) r WHERE r.incident_id IN (SELECT incident_id FROM {QC.lock_sql('anoms')})"""))
def q_incidents_stream(spark, sf):
    """Metrics in, opened incidents and their resolutions out: detection, recovery and the lock chained in one stream."""
    out = _stream_run(spark, A.metrics(spark, sf), _METRIC_SCHEMA,
                      lambda s, d: ST.incidents_stream(s, gap_s=QD.GAP_S, ttl_s=QD.TTL_S, limit_min=QC.REC_MIN, lock_s=QC.LOCK_S, delay=d), "chain")
    return out.select("kind", "incident_id", "source_service", "trigger_metric", "detection_time", "resolved_at", "recovered")
