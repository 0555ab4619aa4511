import random
from collections import Counter

import numpy as np
from emberwatch.llm import minmax
from emberwatch.llm.minmax import near_duplicates
from test_ngramjoin import brute, families, frame


def got(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_equals_brute_force(spark):
    for seed, n, percent in ((11, 5, 85), (12, 3, 80)):
        rows = families(seed)
        out = near_duplicates(frame(spark, rows), n, percent)
        assert got(out) == brute(rows, n, percent)
        assert {r.doc_id for r in out.collect() if r.kept} == {c for _, _, c in brute(rows, n, percent)}


def test_one_large_group_of_near_copies_is_whole(spark):
    """Copies from few to very many edits away from one text: many pairs in common buckets, few of them links."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = []
    for i in range(700):
        t = list(base)
        for _ in range(rng.randrange(14)):
            t[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    assert got(near_duplicates(frame(spark, rows), 5, 85)) == brute(rows, 5, 85)


def test_odd_rows(spark, edge_docs, no_docs):
    rows = [(1, None), (2, ""), (3, " \t\n"), (9, "A b"), (8, "a B"), (7, "a b c"), (5, "x " * 30000), (4, "x " * 29999),
            (11, "q\x0bw\x0ce r t"), (12, "q w e r t"), (12, "q w e r t"), (13, "q w e r t")]
    out = near_duplicates(frame(spark, rows), 5, 85)
    assert got(out) == brute(rows, 5, 85)
    assert sorted(r.doc_id for r in out.collect() if r.kept) == [1, 2, 3, 4, 7, 8, 11]
    none = near_duplicates(frame(spark, [(None, "a b"), (None, "a b"), (None, None)])).collect()
    assert all(r.component_id is None and not r.kept for r in none) and len(none) == 3
    assert near_duplicates(no_docs).count() == 0
    assert near_duplicates(edge_docs).count() == edge_docs.count()


def test_signature_is_unbiased_and_of_lower_variance():
    rng = np.random.default_rng(1)
    both, mins = [], []
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 115, dtype=np.uint64) * np.uint64(2)
        a, b = (minmax.signature(s, 30) for s in (pool[:100], pool[15:]))  # similarity 85 / 115
        both.append(minmax.estimate(a, b))
        mins.append(minmax.estimate(a[0], b[0]))
    true = 85 / 115
    assert abs(np.mean(both) - true) < 0.01 and abs(np.mean(mins) - true) < 0.015
    assert np.var(both) < 0.75 * np.var(mins)


def test_bands_hold_minima_and_maxima_and_pieces_change_nothing(monkeypatch):
    rng = np.random.default_rng(2)
    s = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    whole = minmax.signature(s)
    monkeypatch.setattr(minmax, "PIECE", 7)
    assert (minmax.signature(s) == whole).all()
    keys = minmax.band_keys(whole)
    assert len(set(keys.tolist())) == minmax.BANDS
    for half in (0, 1):
        for p in (0, 2, 3, minmax.PERMUTATIONS - 1):
            other = whole.copy()
            other[half, p] += np.uint64(1)
            changed = np.flatnonzero(minmax.band_keys(other) != keys)
            assert changed.tolist() == [p // (minmax.ROWS // 2)]


def test_similar_pairs_share_a_band():
    rng = np.random.default_rng(4)
    missed = 0
    for _ in range(2000):
        pool = rng.integers(0, 1 << 63, 40, dtype=np.uint64) * np.uint64(2)
        a, b = (minmax.band_keys(minmax.signature(s)) for s in (pool[:37], pool[3:]))  # similarity 34 / 40 = 0.85
        missed += not (a == b).any()
    assert missed == 0
