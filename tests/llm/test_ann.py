import numpy as np
from emberwatch.llm import ann
from emberwatch.llm.ann import nearest
from pyspark.sql import functions as F


def brute(rows, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        s = u @ u[i]
        s[ids == ids[i]] = -9
        out[int(ids[i])] = [int(ids[j]) for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 3, 0.5) for i, v in rows], "vec_id long, embedding array<float>, leaves int, score double")


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def test_small_tables_are_exact_with_odd_rows(spark):
    rng = np.random.default_rng(0)
    good = [(i, rng.normal(size=6).astype("float32").tolist()) for i in range(120)]
    good += [(200 + i, good[7][1]) for i in range(40)]                      # many copies, two of them queries
    odd = [(None, good[0][1]), (301, None), (302, []), (303, [0.0] * 6), (304, [float("nan")] + [1.0] * 5),
           (305, [float("inf")] + [1.0] * 5), (306, [None] + [1.0] * 5), (307, [1.0, 2.0]), (350, [0.0] * 6)]
    got = result(nearest(frame(spark, good + odd + good[:3]), F.col("vec_id") % 50 == 0, share=1.0))
    assert got == brute(good, 5)
    assert nearest(frame(spark, good).limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert result(nearest(frame(spark, good[:3]), F.col("vec_id") % 50 == 0, share=1.0)) == brute(good[:3], 5)  # fewer than five
    assert result(nearest(frame(spark, good[:1]), F.col("vec_id") % 50 == 0)) == {}


def test_forest_recall_and_blocks(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 16))
    rows = [(i, (centres[i % 60] + 0.4 * rng.normal(size=16)).astype("float32").tolist()) for i in range(3000)]
    want = brute(rows, 5)
    got = result(nearest(frame(spark, rows), F.col("vec_id") % 50 == 0, share=0.2, sample=1000, row_block=700, query_block=25))
    recall = np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want])
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values()) and recall > 0.9


def test_every_row_reaches_one_leaf_of_each_tree():
    x = ann.unit(np.random.default_rng(3).normal(size=(500, 8)))
    forest = ann.build_forest(x[:300], trees=4, leaf=10)
    leaves = ann.leaves_of(forest, x)
    assert leaves.shape == (500, 4) and len(set(map(tuple, leaves.T[:, :5].T))) >= 1
    for t in range(4):
        for i in range(300):
            assert i in forest.members[leaves[i, t]]
    same = ann.build_forest(np.ones((200, 3)), trees=1, leaf=10)  # nothing to split: one leaf, no endless recursion
    assert sum(map(len, same.members)) == 200


def test_fitted_share_falls_with_structure_and_size():
    rng = np.random.default_rng(7)
    shares = []
    for n in (500, 4000):
        centres = rng.normal(size=(n // 25, 24))
        x = ann.unit(centres[np.arange(n) % (n // 25)] + 0.3 * rng.normal(size=(n, 24)))
        shares.append(ann.fitted_share(ann.build_forest(x), x, 5))
    noise = ann.unit(rng.normal(size=(1500, 24)))
    assert shares[1] < shares[0] and shares[1] < 0.1 < ann.fitted_share(ann.build_forest(noise), noise, 5)


def test_recall_on_the_given_tables(spark):
    for sf in ("sf0.01", "sf0.1"):
        table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
        rows = [(r.vec_id, list(r.embedding)) for r in table.collect()]
        want, got = brute(rows, 5), result(nearest(table, F.col("vec_id") % 50 == 0))
        assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
        assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) >= 0.9
