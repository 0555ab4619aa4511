"""Detection: the reference's numeric cases on small frames, plus suppression invariants."""

import random

import pytest
from pyspark.sql import functions as F

from emberwatch import constants as K
from emberwatch.operators import detect as D
from emberwatch.operators.suppress import suppress


def _series(spark, values, metric="service_latency_p99_ms", step_ms=10_000):
    rows = [(i, "api-gateway", metric, float(v), 1_700_000_000_000 + i * step_ms) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "event_id long, source_service string, metric_name string, "
                                       "metric_value double, ts long")


def _last_z(spark, values, **kw):
    df = D.zscore(D.baseline(D.segments(_series(spark, values), **kw)))
    return df.orderBy(F.col("event_id").desc()).first()


def test_insufficient_samples_zero(spark):
    assert _last_z(spark, [100.0] * (K.MIN_SAMPLES - 1) + [500.0])["zscore"] == 0.0


def test_obvious_spike(spark):
    assert _last_z(spark, [200.0 + i * 0.5 for i in range(50)] + [5000.0])["zscore"] > 10.0


def test_within_baseline(spark):
    assert _last_z(spark, [200.0 + i * 0.5 for i in range(50)] + [210.0])["zscore"] < 2.0


def test_constant_series_zero(spark):
    assert _last_z(spark, [50.0] * 31)["zscore"] == 0.0


def test_negative_below_baseline(spark):
    assert _last_z(spark, [100.0 + i for i in range(30)] + [50.0])["zscore"] < 0


def test_gap_resets_baseline(spark):
    vals = [200.0 + i * 0.5 for i in range(50)] + [5000.0]
    df = _series(spark, vals, step_ms=3_600_000)  # every gap is 1 h >= 3600 s: every row is its own segment
    z = D.zscore(D.baseline(D.segments(df)))
    assert z.where(F.col("zscore") != 0).count() == 0


@pytest.mark.parametrize("metric,z,expected", [
    ("service_latency_p99_ms", 6.0, "CRITICAL"), ("service_latency_p99_ms", 3.5, "HIGH"),
    ("service_latency_p99_ms", 2.6, "MEDIUM"), ("service_error_rate_percent", 7.0, "CRITICAL"),
    ("service_error_rate_percent", 4.0, "HIGH"), ("service_cpu_percent", 6.0, "CRITICAL"),
    ("service_latency_p99_ms", 5.0, "CRITICAL"), ("service_latency_p99_ms", 4.9, "HIGH"),
    ("some_unknown_metric", 2.6, "MEDIUM"), ("service_memory_percent", 5.1, "CRITICAL"),
    ("service_memory_percent", 3.1, "HIGH"), ("service_memory_percent", 2.6, "MEDIUM"),
    ("kafka_consumer_lag", 3.0, "HIGH"), ("service_db_connections", 2.8, "HIGH"),
])
def test_severity_edges(spark, metric, z, expected):
    df = spark.createDataFrame([(metric, z)], "m string, z double")
    assert df.select(D.severity_col("m", "z").alias("s")).first()["s"] == expected


def test_thresholds_complete():
    names = {m for m, _, _ in K.SEVERITY_THRESHOLDS}
    assert set(K.METRIC_NAMES) <= names
    assert all(c > h for _, c, h in K.SEVERITY_THRESHOLDS)


def test_percentiles_nearest_rank(spark):
    df = _series(spark, list(range(50)))
    p = D.window_percentiles(D.segments(df)).orderBy(F.col("event_id").desc()).first()
    vals = sorted(range(50))
    assert p["p50_value"] == vals[min(int(50 * 50 / 100), 49)]
    assert p["p95_value"] == vals[min(int(50 * 95 / 100), 49)]
    assert p["p99_value"] == vals[49]
    single = D.window_percentiles(D.segments(_series(spark, [42.0]))).first()
    assert single["p50_value"] == 42.0 and single["p99_value"] == 42.0


def test_anomaly_score_clamp(spark):
    from emberwatch.functions.columns import anomaly_score
    df = spark.createDataFrame([(10.0,), (5.0,), (25.0,)], "z double")
    assert [r[0] for r in df.select(anomaly_score("z")).collect()] == [1.0, 0.5, 1.0]


def _brute_suppress(rows, ttl):
    kept, last = {}, {}
    for key, ts, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if key not in last or ts >= last[key] + ttl:
            kept.setdefault(key, []).append(i)
            last[key] = ts
    return sorted(i for v in kept.values() for i in v)


def test_suppress_matches_brute_force(spark):
    rnd = random.Random(5)
    rows = [(f"k{rnd.randint(0, 4)}", rnd.randint(0, 50_000), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, ts long, id long").repartition(7)
    got = sorted(r["id"] for r in suppress(df, keys=["key"], ts="ts", tie="id", ttl_s=0.3).collect())
    assert got == _brute_suppress(rows, 300)


def test_suppress_small_batches(spark):
    """The fold carries its state across Arrow batches."""
    rnd = random.Random(9)
    rows = [("hot", rnd.randint(0, 200_000), i) for i in range(5000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        df = spark.createDataFrame(rows, "key string, ts long, id long")
        got = sorted(r["id"] for r in suppress(df, keys=["key"], ts="ts", tie="id", ttl_s=1).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == _brute_suppress(rows, 1000)


def _brute_until(rows, ttl):
    kept, held = [], {}
    for key, ts, i, until in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if key not in held or ts >= held[key]:
            kept.append(i)
            held[key] = min(max(until, ts + 1), ts + ttl)
    return sorted(kept)


def test_suppress_many_buckets_and_until(spark):
    """Buckets of twice the lock span: chains cross bucket borders; per-row lock ends (C-01 form)."""
    rnd = random.Random(11)
    rows = []
    for i in range(4000):
        key = "hot" if rnd.random() < 0.6 else f"k{rnd.randint(0, 3)}"
        ts = rnd.randint(0, 400_000)
        rows.append((key, ts, i, ts + rnd.choice([200, 1000, 1000, 5000])))
    df = spark.createDataFrame(rows, "key string, ts long, id long, until long")
    got = sorted(r["id"] for r in suppress(df, keys=["key"], ts="ts", tie="id", ttl_s=1, until="until",
                                            bucket_s=2).collect())
    assert got == _brute_until(rows, 1000)
    plain = sorted(r["id"] for r in suppress(df.drop("until"), keys=["key"], ts="ts", tie="id", ttl_s=1,
                                              bucket_s=1).collect())
    assert plain == _brute_suppress([(k, t, i) for k, t, i, _ in rows], 1000)


def test_suppressed_rows_at_least_ttl_apart(spark):
    from emberwatch.sources.adapters import metrics
    m = metrics(spark, "/root/testdata/sf0.001")
    kept = suppress(m, keys=["source_service", "metric_name"], ts="ts", tie="event_id", ttl_s=7200)
    from pyspark.sql import Window
    w = Window.partitionBy("source_service", "metric_name").orderBy("ts", "event_id")
    gaps = kept.withColumn("gap", F.col("ts") - F.lag("ts").over(w)).where(F.col("gap") < 7_200_000)
    assert gaps.count() == 0


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0
    assert "deviation_sigma" in df.columns


def test_bucketed_series_stats_exact(spark):
    """The bucket split (with halo and carried segments) equals the single-window form for any width."""
    from emberwatch.sources.adapters import metrics
    m = metrics(spark, "/root/testdata/sf0.01").where(F.col("metric_name").isin(K.METRIC_NAMES))
    cols = ["event_id", "segment", "n_prior", "baseline_mean", "baseline_std", "zscore", "p50_value", "p95_value",
            "p99_value"]
    ref = D.zscore(D.window_percentiles(D.baseline(D.segments(m, gap_s=43200))))

    def rows(df):
        return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r)
                      for r in df.select(*cols).collect())
    expect = rows(ref)
    for b in (3600, 86400, 30 * 86400):
        assert rows(D.series_stats(m, gap_s=43200, bucket_s=b, number=True)) == expect
