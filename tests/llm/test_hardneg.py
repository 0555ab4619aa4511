from collections import Counter

import numpy as np
import pytest
from emberwatch.llm import hardneg
from emberwatch.llm.hardneg import hard_negatives
from pyspark.sql import functions as F

KIND = "vec_id long, label int, vector array<long>, score double, block int, anchor int, cell int"


def brute(rows, anchors, positives=5, negatives=10, low=30, high=90):
    rows = sorted({(i, c, tuple(v)) for i, c, v in rows})
    out = Counter()
    for a in (r for r in rows if anchors(r[0])):
        by = sorted(((-sum(x * y for x, y in zip(a[2], r[2], strict=True)), r[0], r[1]) for r in rows if r != a))
        for p, pid, _ in [x for x in by if x[2] == a[1]][:positives]:
            inside = [x for x in by if x[2] != a[1] and low * -p <= 100 * -x[0] <= high * -p][:negatives]
            out.update((a[0], pid, k + 1, n, -p, -s) for k, (s, n, _) in enumerate(inside))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, c, v, 0.5, 1, 2, 3) for i, c, v in rows], KIND)


def result(df):
    return Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def clusters(seed, n, d, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    return [(i, int(rng.integers(0, 4)), np.floor(64 * (centres[i % 12] + spread * rng.normal(size=d))).astype(int).tolist()) for i in range(n)]


@pytest.mark.parametrize("d", [8, 5, 1])
def test_equals_brute_force_in_many_blocks(spark, d):
    rows = clusters(d, 900, d)
    got = result(hard_negatives(frame(spark, rows), F.col("vec_id") % 30 == 0, codes=9, sample=120, row_block=100, anchor_block=7))
    assert got == brute(rows, lambda i: i % 30 == 0) and got


def test_copies_ties_and_odd_rows(spark):
    rows = clusters(3, 150, 6)
    rows += [(1000 + i, i % 3, rows[4][2]) for i in range(400)]       # copies of one vector, several of them anchors
    rows += [(60, 1, rows[9][2]), (60, 2, rows[9][2])]                # one id, three rows
    odd = [(None, 1, rows[0][2]), (2001, None, rows[0][2]), (2002, 1, None), (2003, 1, [1, 2]), (2004, 1, [None] * 6)]
    odd = odd[:-1]
    anchors = F.col("vec_id") % 30 == 0
    got = result(hard_negatives(frame(spark, rows + odd + rows[:40]), anchors, codes=4, sample=64, row_block=50))
    assert got == brute(rows, lambda i: i % 30 == 0)
    assert hard_negatives(frame(spark, rows).limit(0), anchors).count() == 0
    assert result(hard_negatives(frame(spark, rows[:1]), anchors)) == Counter()
    few = [(0, 1, [4, 4]), (1, 1, [3, 3]), (2, 2, [2, 1])]
    assert result(hard_negatives(frame(spark, few), anchors)) == brute(few, lambda i: i % 30 == 0) != Counter()


def test_scores_beyond_doubles_are_exact(spark):
    big = 1 << 30
    rows = [(i, i % 2, [big + i * i, big - 3 * i, 7 * i]) for i in range(40)]
    assert result(hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0, high=100)) == brute(rows, lambda i: i % 10 == 0, high=100)


def test_only_what_may_hold_a_window_is_opened():
    rng = np.random.default_rng(5)
    x = np.floor(256 * np.concatenate([c + 0.05 * rng.normal(size=(200, 8)) for c in rng.normal(size=(20, 8))]))
    books = [hardneg.codebook(x[::4, :4], 20), hardneg.codebook(x[::4, 4:], 20)]
    (c1, r1), (c2, r2) = hardneg.nearest_code(x[:, :4], books[0]), hardneg.nearest_code(x[:, 4:], books[1])
    import pandas as pd
    cells = pd.DataFrame({"c1": c1, "c2": c2, "r1": r1, "r2": r2}).groupby(["c1", "c2"]).agg(n=("r1", "size"), r1=("r1", "max"), r2=("r2", "max")).reset_index()
    index = hardneg.Index(books, cells, x[:0], np.zeros(0), np.zeros(0, np.int64), 1000)
    q = x[3]
    truth = x @ q
    least = np.sort(truth)[-5]
    seen = list(index.visits(q, least, np.inf))
    bounds = [b for *_, b in seen]
    assert bounds == sorted(bounds, reverse=True) and len(seen) < len(index.place) / 2
    opened = {number for number, *_ in seen}
    for row in np.flatnonzero(truth >= least):
        assert index.place[c1[row], c2[row]][0] in opened
    for a, b in index.place:  # no row is above its cell's bound
        best = truth[(c1 == a) & (c2 == b)].max()
        number = index.place[a, b][0]
        assert all(best <= bound for n, *_, bound in seen if n == number)


def test_integer_vectors(spark):
    rows = [(1, 1, [0.5, -0.001]), (2, 1, [float("nan"), 1.0]), (3, 1, [None, 1.0]), (4, None, [1.0]), (5, 1, None), (None, 1, [1.0]),
            (6, 1, [float("inf")]), (7, 1, [])]
    df = spark.createDataFrame([(i, c, v, "x") for i, c, v in rows], "vec_id long, label int, embedding array<float>, vector string")
    assert [(r.vec_id, r.vector) for r in hardneg.integer_vectors(df).orderBy("vec_id").collect()] == [(1, [128, -1]), (7, [])]
