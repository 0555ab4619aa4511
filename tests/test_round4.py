"""Searches whose rows stay where they are, and requests grouped without their vectors."""

import numpy as np
from pyspark.sql import functions as F

from emberwatch.operators import blocksearch as B
from emberwatch.operators import retrieve as R


def test_rows_that_stay_are_found_as_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    vec = [[float(x) for x in rng.integers(-2, 3, 4)] for _ in range(120)]
    c = spark.createDataFrame([(f"c{i % 100:03d}", [v, None, v[:3]][(i % 40 == 39) + 2 * (i % 40 == 38)], f"row {i % 50}") for i, v in enumerate(vec)]
                              + [(None, vec[0], "none"), ("c000", vec[0], "other"), ("c000", vec[0], "other")],
                              "chunk_id string, embedding array<float>, about string").repartition(5)
    q = spark.createDataFrame([(i, vec[i % 9], f"q{i}") for i in range(30)] + [(3, vec[50], "again"), (40, [1.0, 2.0, 3.0], "short"),
                              (None, vec[1], "null"), (41, None, "no"), (42, [0.0] * 4, "zero")], "query_id long, query_vec array<double>, word string")
    rows = lambda df: sorted(map(str, df.select("query_id", "word", "chunk_id", "score", "about").collect()))
    top = lambda df: df.withColumn("r", F.rank().over(B.Window.partitionBy("word").orderBy(F.desc("score"), "chunk_id"))).where("r <= 3")
    want = rows(top(B.search(q, c, k=9)))
    monkeypatch.setattr(B, "ROW_BLOCK", 16)
    monkeypatch.setattr(B, "QUERY_BLOCK", 4)
    for held in (B.HELD_BYTES, 400):  # in one round and in several
        monkeypatch.setattr(B, "HELD_BYTES", held)
        got = B.search(q, c, k=9, stay=True)
        assert set(got.columns) == {"query_id", "word", "chunk_id", "score", "about"} and rows(top(got)) == want
    assert B.search(q.limit(0), c, k=2, stay=True).count() == 0 and B.search(q, c.limit(0), k=2, stay=True).count() == 0


def test_rows_of_a_gather_are_not_shuffled_for_each_block_of_queries(spark):
    c = spark.createDataFrame([(name, f"{name}{i}", i, "auth", "t", "production", True, i, f"text {i}", "t", "h", "d", [float(i % 7), 1.0])
                               for name in ("incidents", "runbooks", "postmortems") for i in range(40)],
                              "collection string, chunk_id string, doc_id int, service_name string, anomaly_type string, environment string,"
                              "resolved boolean, epoch long, content string, text string, text_hash string, doc_hash string, embedding array<float>")
    q = spark.createDataFrame([(i, [float(i), 1.0], ["auth"], "t", i) for i in range(6)],
                              "query_id long, query_vec array<float>, affected_services array<string>, q_type string, query_epoch long")
    got = R.gather(q, c, also=["service_name"])
    plan = got._jdf.queryExecution().analyzed().toString()
    assert plan.count("FlatMapCoGroups") == 2  # those by service; the three others are staged, and their rows stay
    assert {(r.query_id, r.collection): r.n for r in got.groupBy("query_id", "collection").agg(F.count("*").alias("n")).collect()} == {
        (i, name): 5 for i in range(6) for name in ("incidents", "runbooks", "postmortems")}
    assert got.where("service_name = 'auth'").count() == 90


def test_alike_requests_are_grouped_without_their_vectors(spark):
    vec = [[1.0, 0.0], [0.0, 1.0], [1.0, 0.0]]
    asked = spark.createDataFrame([(i, name, vec[i % 3], "t" * (i % 2), ["auth"], i) for i in range(12) for name in ("incidents", "runbooks", "deployments")]
                                  + [(0, "incidents", vec[1], "t", ["auth"], 9), (None, "incidents", vec[0], "t", ["auth"], 1)],
                                  "query_id long, collection string, query_vec array<float>, q_type string, affected_services array<string>, query_epoch long")
    requests, members = R.alike(asked)
    of = {(r.query_id, r.collection): r.same_as for r in members.collect()}
    assert len(of) == 37 and of[1, "incidents"] == of[4, "incidents"] == 1 and of[5, "incidents"] == of[2, "incidents"] == 2
    assert of[0, "incidents"] == 0 and of[2, "runbooks"] == of[8, "runbooks"] == 0 and of[5, "runbooks"] == of[3, "runbooks"] == 3
    assert all(of[i, "deployments"] == i for i in range(12))
    got = {}
    for r in requests.collect():
        got.setdefault((r.query_id, r.collection), []).append(r)
    assert set(got) == {(s, c) for (_, c), s in of.items()} and len(got[0, "incidents"]) == 2
    exchanged = [x for x in members._jdf.queryExecution().optimizedPlan().toString().splitlines() if "query_vec" in x]
    assert not exchanged
