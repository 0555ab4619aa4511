"""The block search, the inverted file and incremental seeding."""

from functools import reduce
from math import sqrt

import numpy as np
from emberwatch.operators import knowledge as KN
from emberwatch.operators import retrieve as R
from emberwatch.operators.blocksearch import best_pairs, search
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def fold(x, y):
    return reduce(lambda s, ab: s + ab[0] * ab[1], zip(x, y, strict=True), 0.0)


def plain(q, c, rank, k, allowed=None):
    out = []
    for i, x in enumerate(q):
        s = [(-fold(x, y) / (sqrt(fold(x, x)) * sqrt(fold(y, y))), rank[j], j)
             for j, y in enumerate(c) if any(y) and any(x) and (allowed is None or allowed[i, j])]
        out += [(i, j, -v) for v, _, j in sorted(s)[:k]]
    return out


def test_best_pairs_equal_a_sequential_fold():
    rng = np.random.default_rng(0)
    q, c = rng.normal(size=(300, 7)), rng.normal(size=(500, 7))
    c[50:250] = c[3]            # copies: only the first by rank may win
    c[260], q[5] = 0, 0         # no direction
    rank = rng.permutation(500)
    for k in (1, 5, 400):
        assert list(zip(*(x.tolist() for x in best_pairs(q, c, rank, k)), strict=True)) == plain(q.tolist(), c.tolist(), rank, k)
    times = rng.integers(0, 10, 500).astype(float)
    at = rng.integers(0, 10, 300).astype(float)
    allowed = times[None, :] <= at[:, None]
    got = best_pairs(q, c, rank, 4, lambda part: allowed[part], times)
    assert list(zip(*(x.tolist() for x in got), strict=True)) == plain(q.tolist(), c.tolist(), rank, 4, allowed)


def test_odd_vectors_take_no_part(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0]), (5, [float("nan"), 1.0])], "query_id long, query_vec array<double>")
    c = spark.createDataFrame([("a", [2.0, 0.0]), ("b", None), ("c", [None, 1.0]), ("d", [0.0, 0.0]), ("e", [0.0, 3.0]), ("f", [5.0])],
                              "chunk_id string, embedding array<double>")
    got = {(r.query_id, r.chunk_id, r.score) for r in search(q, c, k=9).collect()}
    assert got == {(1, "a", 1.0), (1, "e", 0.0), (4, "f", 1.0)}
    assert search(q.limit(0), c, k=2).count() == 0 and search(q, c.limit(0), k=2).count() == 0


def test_inverted_file_finds_neighbours_in_few_cells(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 12))
    vec = lambda i: (centres[i % 40] + 0.15 * rng.normal(size=12)).tolist()
    c = spark.createDataFrame([(i, vec(i)) for i in range(4000)], "chunk_id long, embedding array<double>")
    q = spark.createDataFrame([(i, vec(i)) for i in range(60)], "query_id long, query_vec array<double>")
    index = R.InvertedFile(c, k=5)
    near = index.search(q, k=5)
    hits = {(r.query_id, r.chunk_id) for r in near.collect()}
    exact = {(r.query_id, r.chunk_id) for r in R.knn(q, c, k=5).collect()}
    assert len(hits) == 300 and len(hits & exact) >= 0.95 * 300
    assert max(r.n for r in index.candidates(q).collect()) < 4000 / 5
    again = index.search(q, k=5)  # the stored lists serve any number of searches
    assert {(r.query_id, r.chunk_id) for r in again.collect()} == hits


def test_second_seed_embeds_what_changed_only(spark):
    points = KN.seed_points(spark, SF)
    store, model, n = KN.seed_store(spark, SF)
    assert n == store.count() > 0
    again, same, none = KN.seed_store(spark, SF, store, model)
    assert none == 0 and same is model and again.exceptAll(store.select(*again.columns)).count() == 0 and again.count() == n
    one = points.where("collection = 'postmortems'").orderBy("chunk_id").first()
    edited = points.withColumn("text", F.when(F.col("chunk_id") == one.chunk_id, F.lit("a new cause")).otherwise(F.col("text")))
    gone = points.where("collection = 'runbooks'").orderBy("chunk_id").first().chunk_id
    third, _, n = KN.seed_store(spark, SF, store, model, points=edited.where(F.col("chunk_id") != gone))
    assert n == 1 and third.count() == store.count() - 1
    vec = lambda s: s.where(F.col("chunk_id") == one.chunk_id).first().embedding
    assert vec(third) != vec(store)


def test_a_narrow_value_is_one_meeting(spark, monkeypatch):
    from emberwatch.operators import blocksearch

    monkeypatch.setattr(blocksearch, "ROW_BLOCK", 2)
    monkeypatch.setattr(blocksearch, "QUERY_BLOCK", 2)
    q = spark.createDataFrame([(i, [1.0, float(i)], f"s{i}") for i in range(20)] + [(20, [1.0, 0.0], None), (21, [0.0, 1.0], "none such")],
                              "query_id long, query_vec array<double>, svc string")
    c = spark.createDataFrame([(i, [float(i % 3), 1.0], f"s{i % 19}") for i in range(38)] + [(99, [1.0, 1.0], None)],
                              "chunk_id long, embedding array<double>, service_name string")
    dealt = {}
    real = blocksearch._meetings

    def counted(*args):
        out = real(*args)
        dealt["rows"] = [(r["__nq"], r["__nc"]) for r in out.collect()]
        return out

    monkeypatch.setattr(blocksearch, "_meetings", counted)
    found = {(r.query_id, r.chunk_id) for r in search(q, c, k=9, on=[("svc", "service_name")]).collect()}
    assert dealt["rows"] == [(1, 1)] * 20  # not 11 blocks of queries times 20 of rows for each service
    assert found == {(i, j) for i in range(19) for j in (i, i + 19)} | {(20, 99)}


def test_inverted_file_searches_once(spark):
    rng = np.random.default_rng(3)
    c = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(300)], "chunk_id long, embedding array<double>")
    q = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(9)], "query_id long, query_vec array<double>")
    index = R.InvertedFile(c, k=5)
    plan = index.search(q, k=5)._jdf.queryExecution().analyzed().toString()
    assert plan.count("FlatMapCoGroups") == 1  # the search of queries whose cells are too small; the hits in cells are staged
