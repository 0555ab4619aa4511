import random
import re
from collections import Counter

import numpy as np
from emberwatch.llm import ngramjoin
from emberwatch.llm.common import components
from emberwatch.llm.ngramjoin import adaptive_prefix, least_overlap, linked_groups, shingle_sets


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def true_set(text, n):
    w = words(text)
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, n, percent):
    sets = [true_set(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    best = {}
    for i, (doc, _) in enumerate(rows):
        best.setdefault(find(i), []).append(doc)
    return Counter((doc, len(sets[i]), min(best[find(i)])) for i, (doc, _) in enumerate(rows))


def families(seed, n=160):
    """Random texts, and families of near copies from one to very many edits away from their base and each other."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(8):
        base = rng.choices(vocab, k=rng.choice([3, 12, 60, 150]))
        for _ in range(n // 16):
            t = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            texts.append(" ".join(t))
    texts += [" ".join(rng.choices(vocab, k=rng.choice([1, 2, 5, 40]))) for _ in range(n // 2)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, cls string, size int")


def got(df):
    return Counter(tuple(r) for r in df.collect())


def test_equals_brute_force(spark):
    for seed, n, percent in ((1, 4, 85), (2, 5, 80), (3, 2, 50)):
        rows = families(seed)
        assert got(linked_groups(frame(spark, rows), n, percent)) == brute(rows, n, percent)


def test_odd_rows(spark, edge_docs, no_docs):
    rows = [(i, t) for i, t in [(1, None), (2, ""), (3, " \t\n"), (9, "A b"), (8, "a B"), (7, "a b c"), (5, "x " * 30000), (4, "x " * 29999),
                                (6, "Ä b"), (10, "ä b"), (11, "q\x0bw\x0ce r t"), (12, "q w e r t"), (12, "q w e r t"), (13, "q w e r t")]]
    assert got(linked_groups(frame(spark, rows), 4, 85)) == brute(rows, 4, 85)
    assert linked_groups(no_docs).count() == 0
    assert linked_groups(edge_docs).count() == edge_docs.count()


def test_hashed_sets_equal_true_sets(monkeypatch):
    texts = ["", "a", "a b c", "A b c d e a b c d e", "ß ü " * 50, None, "x" * 3000 + " y", " ".join(map(str, range(3000)))]
    whole = [s.tolist() for s in shingle_sets(texts, 4)]
    assert [len(s) for s in whole] == [len(true_set(t, 4)) for t in texts]
    monkeypatch.setattr(ngramjoin, "BATCH", 1000)
    assert [s.tolist() for s in shingle_sets(texts, 4)] == whole


def test_prefix_rule_keeps_every_similar_pair():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 50, ngramjoin.WIDTH).astype(np.uint32)
    for _ in range(300):
        base = np.unique(rng.integers(0, 1 << 63, rng.integers(2, 60), dtype=np.uint64) << np.uint64(1))
        a = base[rng.random(len(base)) < 0.95]
        b = base[rng.random(len(base)) < 0.95]
        common = len(np.intersect1d(a, b))
        if not common or 100 * common < 80 * len(np.union1d(a, b)):
            continue
        (la, pa), (lb, pb) = (adaptive_prefix(s, counts, 20.0, 80) for s in (a, b))
        assert len(np.intersect1d(pa, pb)) >= min(la, lb)
        assert len(pa) == len(a) - least_overlap(len(a), 80) + la


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 160)] + [(i, 1) for i in range(2, 60)] + [(7, 7), (2, 1)]
    random.Random(1).shuffle(path)
    roots = {r.node: r.root for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert {roots[i] for i in range(100, 161)} == {100} and {roots[i] for i in range(1, 60)} == {1}


def test_only_the_sets_of_the_pairs_are_moved(spark):
    from pyspark.sql import functions as F

    from emberwatch.llm.ngramjoin import sets_in

    who = spark.range(100).select(F.col("id").alias("cls"), F.xxhash64("id").alias("who"))
    sets = who.select("cls", F.col("cls").cast("string").cast("binary").alias("grams"), "who")
    got = lambda rows: {r.cls for r in sets_in(spark.createDataFrame(rows, "a long, b long"), sets, who).collect()}
    assert got([(3, 5), (5, 90), (3, 90)]) == {3, 5, 90} and got([]) == set()
