"""Detection operators D-01..D-13: gap-reset segments, rolling baseline, z-score, spikes, severity,
percentiles, TTL suppression, log bursts, sustained alerts, and the end-to-end detect plan.

D-01..D-03 and D-07 share one window spec (series keys + segment, ordered by (ts, event_id)), so the
plan has a single sort per series; the spike filter runs before suppression, which then sees ~3 % of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch import constants as K
from emberwatch.functions.columns import anomaly_score
from emberwatch.operators.suppress import suppress

SERIES = ("source_service", "metric_name")


def _order(ts: str, tie: str | None) -> list[Column]:
    return [F.col(ts)] + ([F.col(tie)] if tie else [])


def segments(df: DataFrame, *, keys: Sequence[str] = SERIES, ts: str = "ts", tie: str | None = "event_id",
             gap_s: float = K.BASELINE_GAP_S, out: str = "segment") -> DataFrame:
    """D-01: a new segment starts at the first row of a key or after a silence of >= gap_s."""
    w = Window.partitionBy(*keys).orderBy(*_order(ts, tie))
    prev = F.lag(ts).over(w)
    flag = F.when(prev.isNull() | (F.col(ts) - prev >= F.lit(int(gap_s * 1000))), 1).otherwise(0)
    return (df.withColumn("__new", flag)
              .withColumn(out, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
              .drop("__new"))


def _series_window(keys: Sequence[str], ts: str, tie: str | None) -> Window:
    return Window.partitionBy(*keys, "segment").orderBy(*_order(ts, tie))


def baseline(df: DataFrame, *, keys: Sequence[str] = SERIES, ts: str = "ts", tie: str | None = "event_id",
             value: str = "metric_value", size: int = K.BASELINE_WINDOW) -> DataFrame:
    """D-02: n, mean and population std over the <= size-1 previous values of the segment."""
    w = _series_window(keys, ts, tie).rowsBetween(-(size - 1), -1)
    return (df.withColumn("n_prior", F.count(value).over(w))
              .withColumn("baseline_mean", F.avg(value).over(w))
              .withColumn("baseline_std", F.stddev_pop(value).over(w)))


def zscore(df: DataFrame, *, value: str = "metric_value", min_samples: int = K.MIN_SAMPLES,
           eps: float = 1e-9) -> DataFrame:
    """D-03: (v - mean) / std; 0 when fewer than min_samples prior values or std < eps."""
    z = (F.when(F.col("n_prior") < min_samples, F.lit(0.0))
          .when(F.coalesce(F.col("baseline_std"), F.lit(0.0)) < eps, F.lit(0.0))
          .otherwise((F.col(value) - F.col("baseline_mean")) / F.col("baseline_std")))
    return df.withColumn("zscore", z)


def spikes(df: DataFrame, *, sigma: float = K.SIGMA_THRESHOLD, metric: str = "metric_name") -> DataFrame:
    """D-04: upward spikes z >= sigma on monitored metrics."""
    return df.where((F.col("zscore") >= sigma) & F.col(metric).isin(K.METRIC_NAMES))


def severity_col(metric: str | Column, z: str | Column) -> Column:
    """D-05: per-metric sigma bounds (inclusive); unknown metrics use 6.0 / 3.0; else MEDIUM."""
    m = F.col(metric) if isinstance(metric, str) else metric
    zc = F.col(z) if isinstance(z, str) else z
    crit = F.lit(K.DEFAULT_CRITICAL_SIGMA)
    high = F.lit(K.DEFAULT_HIGH_SIGMA)
    for name, c, h in reversed(K.SEVERITY_THRESHOLDS):
        crit = F.when(m == name, F.lit(c)).otherwise(crit)
        high = F.when(m == name, F.lit(h)).otherwise(high)
    return F.when(zc >= crit, "CRITICAL").when(zc >= high, "HIGH").otherwise("MEDIUM")


def severity(df: DataFrame, *, metric: str = "metric_name", z: str = "zscore") -> DataFrame:
    return df.withColumn("severity", severity_col(metric, z))


def default_type_col(metric: str | Column) -> Column:
    """D-09: default anomaly type by metric (the non-LLM path); unknown metric -> UNKNOWN."""
    m = F.col(metric) if isinstance(metric, str) else metric
    out = F.lit("UNKNOWN")
    for name, atype, _ in reversed(K.MONITORED_METRICS):
        out = F.when(m == name, F.lit(atype)).otherwise(out)
    return out


def window_percentiles(df: DataFrame, *, keys: Sequence[str] = SERIES, ts: str = "ts",
                       tie: str | None = "event_id", value: str = "metric_value", size: int = K.BASELINE_WINDOW,
                       pcts: Sequence[int] = (50, 95, 99)) -> DataFrame:
    """D-07: nearest-rank percentiles sorted[min(int(n*p/100), n-1)] over the last `size` values incl. current."""
    w = _series_window(keys, ts, tie).rowsBetween(-(size - 1), 0)
    out = df.withColumn("__win", F.sort_array(F.collect_list(value).over(w)))
    n = F.size("__win")
    for p in pcts:
        idx = F.least(F.floor(n * F.lit(p) / F.lit(100)), n - 1).cast("int")
        out = out.withColumn(f"p{p}_value", F.element_at("__win", idx + 1))
    return out.drop("__win")


def anomaly_events(df: DataFrame, *, window_ms: int = K.BASELINE_WINDOW * 10 * 1000) -> DataFrame:
    """D-11: anomaly rows with a deterministic incident id (hash of series and time), so reruns are idempotent."""
    ident = F.substring(F.sha2(F.concat_ws(":", "source_service", "metric_name", F.col("ts").cast("string")), 256),
                        1, 32)
    return df.select(
        ident.alias("incident_id"),
        F.col("anomaly_type"),
        F.col("severity"),
        F.col("source_service"),
        F.array("source_service").alias("affected_services"),
        F.col("ts").alias("detection_time"),
        F.col("metric_name").alias("trigger_metric"),
        F.col("metric_value").alias("observed_value"),
        F.col("baseline_mean").alias("baseline_value"),
        F.col("zscore").alias("deviation_sigma"),
        anomaly_score("zscore").alias("anomaly_score"),
        "p50_value", "p95_value", "p99_value",
        (F.col("ts") - F.lit(window_ms)).alias("window_start"),
        F.col("ts").alias("window_end"),
        F.format_string("%s deviation: %.1fσ above baseline", F.col("metric_name"), F.round("zscore", 1))
        .alias("description"),
    )


def detect(metrics: DataFrame, *, gap_s: float = K.BASELINE_GAP_S, ttl_s: float = K.DEDUP_TTL_S,
           sigma: float = K.SIGMA_THRESHOLD, size: int = K.BASELINE_WINDOW,
           min_samples: int = K.MIN_SAMPLES, bucket_s: float = 86400, materialize_spikes: bool = True) -> DataFrame:
    """D-13: metrics -> anomalies: `series_stats`, the spikes, then suppression on the dedup key."""
    m = metrics.where(F.col("metric_name").isin(K.METRIC_NAMES))
    m = series_stats(m, gap_s=gap_s, size=size, min_samples=min_samples, bucket_s=bucket_s)
    s = spikes(m, sigma=sigma).withColumn("anomaly_type", default_type_col("metric_name"))
    s = s.select("event_id", "source_service", "metric_name", "metric_value", "ts", "baseline_mean", "zscore",
                 "p50_value", "p95_value", "p99_value", "anomaly_type")
    if materialize_spikes:
        from emberwatch.session import materialize

        # spikes are ~3 % of the samples; cutting the lineage here keeps the suppression plan small
        s = materialize(s)
    kept = suppress(s, keys=["source_service", "anomaly_type", "metric_name"], ts="ts", tie="event_id", ttl_s=ttl_s)
    kept = kept.withColumn("severity", severity_col("metric_name", "zscore"))
    return anomaly_events(kept)


def burst_counts(df: DataFrame, *, keys: Sequence[str], gap_s: float, ts: str = "ts", tie: str = "event_id",
                 bucket_s: float = 3600, out: str = "error_count") -> DataFrame:
    """The running count of every row since the last silence of >= gap_s of its key. Rows are counted inside time
    buckets; what a bucket carries over comes from one row per bucket, so no task holds the rows of a whole key."""
    keys, gap = list(keys), F.lit(int(gap_s * 1000))
    same = [F.coalesce(F.col(k).cast("string"), F.lit("\x00")).alias(f"__k{i}") for i, k in enumerate(keys)]
    ids = [f"__k{i}" for i in range(len(keys))]
    d = df.select("*", *same).withColumn("__b", F.floor(F.col(ts) / F.lit(int(bucket_s * 1000))).cast("long"))
    wb = Window.partitionBy(*ids, "__b").orderBy(F.col(ts), F.col(tie))
    upto = wb.rowsBetween(Window.unboundedPreceding, 0)
    new = F.when(F.col(ts) - F.lag(ts).over(wb) >= gap, 1).otherwise(0)
    d = d.withColumn("__new", new).withColumn("__part", F.sum("__new").over(upto))
    d = d.withColumn("__at", F.row_number().over(Window.partitionBy(*ids, "__b", "__part").orderBy(F.col(ts), F.col(tie))))
    parts = d.groupBy(*ids, "__b", "__part").agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    tail = F.max(F.struct("__part", "n"))
    bt = parts.groupBy(*ids, "__b").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), tail.alias("tail"))
    wt = Window.partitionBy(*ids).orderBy("__b")
    silent = F.col("lo") - F.lag("hi").over(wt) >= gap
    # a run of buckets goes on while no silence lies between or within them; its first one may take over the tail of
    # the bucket before
    bt = (bt.withColumn("__silent", F.coalesce(silent, F.lit(True)))
          .withColumn("__broken", F.coalesce(F.lag(F.col("tail")["__part"] > 0).over(wt), F.lit(False)))
          .withColumn("__before", F.lag(F.col("tail")["n"]).over(wt)))
    bt = bt.withColumn("__run", F.sum(F.when(F.col("__silent") | F.col("__broken"), 1).otherwise(0)).over(wt))
    taken = F.when(F.col("__silent"), F.lit(0)).otherwise(F.coalesce(F.col("__before"), F.lit(0)))
    wr = Window.partitionBy(*ids, "__run").orderBy("__b")
    bt = bt.select(*ids, "__b", F.sum(taken).over(wr).alias("__carry"))
    d = d.join(bt, [*ids, "__b"])
    count = F.col("__at") + F.when(F.col("__part") == 0, F.col("__carry")).otherwise(F.lit(0))
    return d.withColumn(out, count.cast("long")).select(*df.columns, out)


def log_bursts(logs: DataFrame, *, gap_s: float = K.BURST_GAP_S, n: int = K.BURST_COUNT,
               ttl_s: float = K.DEDUP_TTL_S, bucket_s: float = 3600) -> DataFrame:
    """D-10: ERROR/FATAL rows; a running count per service that restarts after a silence of >= gap_s
    (the counter's TTL is refreshed on each hit); fires from the n-th error on, then TTL-suppressed."""
    err = logs.where(F.col("level").isin("ERROR", "FATAL"))
    err = burst_counts(err, keys=["source_service"], gap_s=gap_s, bucket_s=bucket_s).where(F.col("error_count") >= n)
    kept = suppress(err, keys=["source_service"], ts="ts", tie="event_id", ttl_s=ttl_s)
    return kept.select(
        "source_service",
        F.col("ts").alias("detection_time"),
        F.lit("ERROR_RATE_SPIKE").alias("anomaly_type"),
        F.when(F.col("level") == "ERROR", "HIGH").otherwise("CRITICAL").alias("severity"),
        F.lit("log_error_burst").alias("trigger_metric"),
        F.lit(K.BURST_SCORE).alias("anomaly_score"),
        "error_count",
        F.concat(F.lit("Log error burst detected: "), F.col("error_count").cast("string"),
                 F.lit(" errors in 60s. Latest: "), F.substring("message", 1, 100)).alias("description"),
    )


def sustained_alerts(metrics: DataFrame, rules: DataFrame, *, hold_scale: float = 1.0, bucket_s: float = 3600) -> DataFrame:
    """D-12: `value > limit` held for `for` seconds. Islands of consecutive true samples per series, an island fires
    when max(ts) - min(ts) >= for. Islands are found inside time buckets; only those that reach a bucket's first or
    last sample (two a bucket at most) are stitched along the series. `rules` is (metric_name, limit, hold_s, alert)."""
    keys = ["source_service", "metric_name", "alert", "hold_s"]
    j = (metrics.join(rules, "metric_name").withColumn("__breach", F.col("metric_value") > F.col("limit"))
         .withColumn("__b", F.floor(F.col("ts") / F.lit(int(bucket_s * 1000))).cast("long")))
    w = Window.partitionBy(*keys, "__b").orderBy("ts", "event_id")
    j = j.withColumn("__island", F.sum(F.when(F.col("__breach"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    buckets = (j.groupBy(*keys, "__b").agg(F.max("__island").alias("__last"))
               .withColumn("__seq", F.row_number().over(Window.partitionBy(*keys).orderBy("__b"))))
    facts = [F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("samples"),
             F.max("metric_value").alias("peak_value")]
    local = j.where("__breach").groupBy(*keys, "__b", "__island").agg(*facts).join(buckets, [*keys, "__b"])
    local = local.withColumn("__starts", F.col("__island") == 0).withColumn("__ends", F.col("__island") == F.col("__last"))
    out = [*keys, "start_ts", "end_ts", "samples", "peak_value"]
    inner = local.where(~F.col("__starts") & ~F.col("__ends")).select(*out)
    ws = Window.partitionBy(*keys).orderBy("__seq", "start_ts")
    joined = F.col("__starts") & (F.lag("__seq").over(ws) + 1 == F.col("__seq")) & F.lag("__ends").over(ws)
    edge = local.where(F.col("__starts") | F.col("__ends")).withColumn(
        "__new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    edge = edge.withColumn("__chain", F.sum("__new").over(ws.rowsBetween(Window.unboundedPreceding, 0)))
    stitched = edge.groupBy(*keys, "__chain").agg(
        F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.sum("samples").alias("samples"),
        F.max("peak_value").alias("peak_value")).select(*out)
    isl = inner.unionByName(stitched)
    fired = isl.where(F.col("end_ts") - F.col("start_ts") >= F.col("hold_s") * F.lit(1000 * hold_scale))
    return fired.select("source_service", "metric_name", "alert", "start_ts", "end_ts", "samples", "peak_value",
                        (F.col("start_ts") + (F.col("hold_s") * F.lit(1000 * hold_scale)).cast("long"))
                        .alias("fired_at"))


def alert_rules(spark) -> DataFrame:
    return spark.createDataFrame([(m, float(lim), int(h), a) for m, lim, h, a in K.ALERT_RULES],
                                 "metric_name string, limit double, hold_s long, alert string")


def series_stats(df: DataFrame, *, keys: Sequence[str] = SERIES, ts: str = "ts", tie: str = "event_id",
                 value: str = "metric_value", gap_s: float = K.BASELINE_GAP_S, size: int = K.BASELINE_WINDOW,
                 min_samples: int = K.MIN_SAMPLES, pcts: Sequence[int] = (50, 95, 99),
                 bucket_s: float = 86400, current: bool = False, number: bool = False) -> DataFrame:
    """D-01..D-03 + D-07 with a hot series split across tasks by time bucket (exact).

    Segments: inside a bucket a window finds the rows behind a silence; where the bucket's first rows belong is known
    from a table with one row per bucket (first and last time, count, last segment start). The segment key is the
    timestamp of the segment's first row (`seg_start`); with `number`, `segment` is its 1-based number within the series.
    Rolling windows: each bucket also receives the last size-1 rows before it (a halo); which bucket
    needs which tail row is a range join on row counts (bucket-keyed). The windows then run per
    (series, bucket, segment), so no task ever holds a whole series.

    The source is scanned and shuffled to (series, bucket) once and staged; the bucket table, the halo and the windows
    read that, and the windows shuffle it a second time."""
    from emberwatch.operators.rangejoin import range_join
    from emberwatch.session import stage

    width = int(bucket_s * 1000)
    gap = int(gap_s * 1000)
    halo = size - 1
    key_cols = list(keys)
    d = df.withColumn("__b", F.floor(F.col(ts) / F.lit(width)).cast("long"))
    wb = Window.partitionBy(*key_cols, "__b").orderBy(F.col(ts), F.col(tie))
    d = d.withColumn("__pos", F.row_number().over(wb)).withColumn("__new", F.when(F.col(ts) - F.lag(ts).over(wb) >= F.lit(gap), F.col(ts)))
    d = d.withColumn("__sin", F.last("__new", ignorenulls=True).over(wb.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
    d = stage(d, "series")

    wt = Window.partitionBy(*key_cols).orderBy("__b")
    before = wt.rowsBetween(Window.unboundedPreceding, -1)
    bt = d.groupBy(*key_cols, "__b").agg(F.min(ts).alias("__lo"), F.max(ts).alias("__hi"), F.count(F.lit(1)).alias("__bn"), F.max("__sin").alias("__last"))
    bt = (bt.withColumn("__prev", F.lag("__hi").over(wt))
            .withColumn("__before", F.coalesce(F.sum("__bn").over(before), F.lit(0)).cast("long"))
            .withColumn("__head", F.when(F.col("__prev").isNull() | (F.col("__lo") - F.col("__prev") >= F.lit(gap)), F.col("__lo")))
            .withColumn("__carry", F.last(F.coalesce("__last", "__head"), ignorenulls=True).over(before)))
    d = d.join(bt.select(*key_cols, "__b", "__before", "__bn", F.coalesce("__head", "__carry").alias("__head")), [*key_cols, "__b"])
    d = d.withColumn("seg_start", F.coalesce("__sin", "__head")).withColumn("__gidx", F.col("__before") + F.col("__pos"))

    base_cols = [c for c in df.columns] + ["seg_start"]
    own = d.select(*base_cols, F.col("__b").alias("__tb"), F.lit(False).alias("__halo"))
    tails = d.where(F.col("__pos") > F.col("__bn") - F.lit(halo)).select(*base_cols, "__gidx")
    targets = bt.select(*[F.col(k).alias(f"__t_{k}") for k in key_cols], F.col("__b").alias("__tb"),
                        F.col("__before").alias("__tbefore"))
    pairs = range_join(tails, targets, left_keys=key_cols, right_keys=[f"__t_{k}" for k in key_cols],
                       left_ts="__gidx", right_ts="__tbefore", before_ms=0, after_ms=halo - 1)
    halo_rows = pairs.select(*base_cols, "__tb", F.lit(True).alias("__halo"))
    u = own.unionByName(halo_rows)

    ws = Window.partitionBy(*key_cols, "__tb", "seg_start").orderBy(F.col(ts), F.col(tie))
    w1 = ws.rowsBetween(-halo, -1)
    w0 = ws.rowsBetween(-halo, 0)
    u = (u.withColumn("n_prior", F.count(value).over(w1))
          .withColumn("baseline_mean", F.avg(value).over(w1))
          .withColumn("baseline_std", F.stddev_pop(value).over(w1))
          .withColumn("__win", F.sort_array(F.collect_list(value).over(w0))))
    if current:  # mean and count over the last `size` values including the current one
        u = u.withColumn("recent_mean", F.avg(value).over(w0)).withColumn("recent_n", F.count(value).over(w0))
    n = F.size("__win")
    for p in pcts:
        u = u.withColumn(f"p{p}_value", F.element_at("__win", F.least(F.floor(n * F.lit(p) / F.lit(100)), n - 1)
                                                     .cast("int") + 1))
    u = u.where(~F.col("__halo")).drop("__win", "__halo", "__tb")
    u = zscore(u, value=value, min_samples=min_samples)
    if not number:
        return u
    segs = u.select(*key_cols, "seg_start").distinct()
    segs = segs.withColumn("segment", F.row_number().over(Window.partitionBy(*key_cols).orderBy("seg_start"))
                           .cast("long"))
    return u.join(segs, [*key_cols, "seg_start"])
