"""Operators mended in the second round: small cases and brute force."""

import json
import random

import pytest
from emberwatch.operators import correlate, detect, knowledge, notify, retrieve, serve, suppress
from emberwatch.sources import events
from pyspark.sql import functions as F
from pyspark.sql import types as T


def brute_suppress(rows, ttl):
    last, kept = {}, []
    for key, ts, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        if key not in last or ts >= last[key] + ttl:
            last[key] = ts
            kept.append(i)
    return sorted(kept)


def test_suppress_null_keys_and_zero_ttl(spark):
    rows = [(k, 3_500_000 + 200_000 * j, 10 * j + (k is None)) for j in range(4) for k in ("a", None)]
    df = spark.createDataFrame(rows, "key string, ts long, id long")
    got = sorted(r.id for r in suppress.suppress(df, keys=["key"], tie="id", ttl_s=300).collect())
    assert got == brute_suppress(rows, 300_000)
    same = spark.createDataFrame([("a", 5, i) for i in range(3)], "key string, ts long, id long")
    assert suppress.suppress(same, keys=["key"], tie="id", ttl_s=0).count() == 3


@pytest.mark.parametrize("fan,levels,spans", [(2, 3, 1), (3, 2, 2), (64, 3, 8)])
def test_suppress_one_hot_key_over_many_buckets(spark, monkeypatch, fan, levels, spans):
    """One key whose ttl is as long as a bucket: equal to brute force, and no group of phase B holds more step rows
    than its share of the key."""
    rng = random.Random(fan)
    rows, ts = [], 0
    for i in range(3000):
        ts += rng.choice([0, 1, 50, 400, 900, 5000])
        rows.append(("hot", ts, i))
    df = spark.createDataFrame(rows, "key string, ts long, id long")
    monkeypatch.setattr(suppress, "SPANS", spans)
    seen = []
    entries = suppress._entries

    def small(steps, **_):
        node = F.floor(F.col(suppress._B) / F.lit(fan))
        seen.append((steps.groupBy(suppress._KEY, node.alias("n")).count().agg(F.max("count")).first()[0], steps.count()))
        return entries(steps, levels=levels, fan=fan)

    monkeypatch.setattr(suppress, "_entries", small)
    got = sorted(r.id for r in suppress.suppress(df, keys=["key"], tie="id", ttl_s=1, bucket_s=1).collect())
    assert got == brute_suppress(rows, 1000)
    largest, steps = seen[0]
    assert largest <= steps and (fan > 3 or largest < 40)


def test_burst_counts_equal_one_window(spark):
    rng = random.Random(2)
    rows, ts = [], 0
    for i in range(1500):
        ts += rng.choice([1, 10, 400, 999, 1000, 7000])
        rows.append((rng.choice(["a", "a", "a", "b", None]), ts, i))
    df = spark.createDataFrame(rows, "source_service string, ts long, event_id long")
    want, last, n = {}, {}, {}
    for k, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        n[k] = 1 if k not in last or t - last[k] >= 1000 else n[k] + 1
        last[k] = t
        want[i] = n[k]
    for bucket in (1, 3, 10_000):
        got = detect.burst_counts(df, keys=["source_service"], gap_s=1, bucket_s=bucket)
        assert {r.event_id: r.error_count for r in got.collect()} == want


def test_sustained_alerts_over_bucket_borders(spark):
    rng = random.Random(4)
    rows, ts = [], 0
    for i in range(1200):
        ts += rng.choice([100, 500, 2500])
        rows.append(("s", "m", i, ts, rng.choice([1.0, 9.0, 9.0, 9.0, 9.0])))
    df = spark.createDataFrame(rows, "source_service string, metric_name string, event_id long, ts long, metric_value double")
    rules = spark.createDataFrame([("m", 5.0, 4, "high")], "metric_name string, limit double, hold_s long, alert string")
    want, run = [], []
    for r in [*rows, (0, 0, 0, 0, 0.0)]:
        if r[4] > 5:
            run.append(r[3])
        else:
            if run and run[-1] - run[0] >= 4000:
                want.append((run[0], run[-1], len(run)))
            run = []
    for bucket in (1, 7, 100_000):
        got = detect.sustained_alerts(df, rules, bucket_s=bucket)
        assert sorted((r.start_ts, r.end_ts, r.samples) for r in got.collect()) == want


def test_pretty_json_and_whole_markdown(spark, tmp_path):
    (tmp_path / "seed.json").write_text(json.dumps({"deployments": [{"id": 1, "v": "a"}, {"id": 2, "v": "b"}]}, indent=2))
    element = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())])
    for kind in (element, None):
        assert sorted((r.id, r.v) for r in events.load_nested_json(spark, str(tmp_path / "seed.json"), "deployments", kind).collect()) == [
            (1, "a"), (2, "b")]
    (tmp_path / "one.md").write_text("# One\n\ntext\n")
    (tmp_path / "two.md").write_text("two")
    rows = {r.stem: r.text for r in events.load_markdown(spark, str(tmp_path / "*.md")).collect()}
    assert rows == {"one": "# One\n\ntext\n", "two": "two"}


def test_upsert_replaces_edited_documents(spark):
    docs = lambda body: spark.createDataFrame([("a", body), ("b", "## S\n\nkept words")], "stem string, text string")
    columns = ["point_id", "stem", "chunk_index", "content"]
    long = "\n\n".join(f"## Part {i}\n\n" + "old words " * 100 for i in range(6))
    chunks = knowledge.runbook_chunks(docs(long)).select(*columns)
    store = knowledge.upsert_chunks(spark.createDataFrame([], chunks.schema), chunks)
    again = knowledge.upsert_chunks(store, knowledge.runbook_chunks(docs("## S\n\nnew words")).select(*columns))
    rows = [(r.stem, r.content) for r in again.collect()]
    assert store.count() > len(rows) == 2 and any("new words" in c for s, c in rows if s == "a") and not any("old" in c for _, c in rows)
    only = knowledge.upsert_chunks(store, knowledge.runbook_chunks(docs("## S\n\nx").where("stem = 'a'")).select(*columns))
    assert {r.stem for r in only.collect()} == {"a", "b"}


def test_blocks_do_not_change_the_search(spark):
    rng = random.Random(1)
    vec = lambda: [rng.gauss(0, 1) for _ in range(4)]
    q = spark.createDataFrame([(i, vec(), ["s1", "s2"], 100 * i) for i in range(7)],
                              "query_id long, query_vec array<double>, affected_services array<string>, at long")
    c = spark.createDataFrame([(i, vec(), f"s{i % 3}", 13 * i) for i in range(60)],
                              "chunk_id long, embedding array<double>, service_name string, epoch long")
    rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "chunk_id", "rank").collect())
    assert rows(retrieve.knn(q, c, k=3)) == rows(retrieve.knn(q, c, k=3, query_blocks=1, corpus_blocks=1)) == rows(
        retrieve.knn(q, c, k=3, query_blocks=5, corpus_blocks=33))
    one = retrieve.knn_per_service(q, c, k=2)
    assert rows(one) == rows(retrieve.knn_per_service(q, c, k=2, corpus_blocks=1))
    timed = retrieve.knn_per_service(q, c, k=50, window_s=("at", "epoch", 150)).join(q.select("query_id", "at"), ["query_id", "at"])
    want = {(r.query_id, x.chunk_id) for r in q.collect() for x in c.collect()
            if x.service_name in r.affected_services and r.at - 150 <= x.epoch <= r.at}
    assert {(r.query_id, r.chunk_id) for r in timed.collect()} == want
    few = retrieve.InvertedFile(c, k=5)
    few.probes = 1  # cells too small for five hits
    assert sorted(r["rank"] for r in few.search(q, k=5).collect()) == sorted(list(range(1, 6)) * 7)


def test_budget_counts_unknown_collections_as_architecture(spark):
    hits = spark.createDataFrame([(1, "mystery", 1, 1, "x" * 40), (1, "incidents", 2, 1, "x" * 40), (1, "runbooks", 3, 1, "x" * 40)],
                                 "query_id long, collection string, chunk_id long, rank long, content string")
    kept = retrieve.budget(hits, max_tokens=20)
    assert {r.collection for r in kept.collect()} == {"incidents", "runbooks"}


def test_routing_recovery_and_page_size(spark):
    row = spark.createDataFrame([("i", 0.9, ["c"], None, None, None)], "incident_id string, anomaly_score double, "
                                "root_cause_candidates array<string>, action_steps array<string>, resolution_method string, postmortem string")
    assert notify.route_kind(row).first().kind == "anomaly"
    assert notify.route_kind(row.withColumn("rca_candidates", F.array(F.lit("x")))).first().kind == "rca"
    anoms = spark.createDataFrame([("n", "s", "m", 0, None), ("z", "s", "m", 0, 0.0), ("b", "s", "m", 0, 100.0)],
                                  "incident_id string, source_service string, trigger_metric string, detection_time long, baseline_value double")
    metrics = spark.createDataFrame([("s", "m", i, 60_000 * i, 10.0) for i in range(1, 6)],
                                    "source_service string, metric_name string, event_id long, ts long, metric_value double")
    got = {r.incident_id: (r.recovered, r.resolved_at) for r in correlate.recovery(anoms, metrics).collect()}
    assert got == {"n": (True, 180_000), "z": (True, 180_000), "b": (False, 1_800_000)}
    with pytest.raises(ValueError):
        serve.list_incidents(anoms, limit=201)
