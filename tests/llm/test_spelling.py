import random
import re
import zlib
from collections import Counter

from emberwatch.llm import spelling
from emberwatch.llm.spelling import near_words, variant_groups, word_counts


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts, ratio=5):
    out = {}
    for w, n in counts.items():
        close = [v for v in counts if near(w, v)]
        best = min(close, key=lambda v: (-counts[v], v), default=None)
        form = best if best and counts[best] >= ratio * n else None
        out[w] = (form, n, len(close), counts[form] if form else None)
    rows = Counter()
    for w, (form, n, k, m) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows[w, form, root, n, k, m] += 1
    return rows


def made(seed, letters, n, most):
    rng = random.Random(seed)
    words = set()
    while len(words) < n:
        base = "".join(rng.choices(letters, k=rng.randint(1, most)))
        words.add(base)
        for _ in range(3):
            at = rng.randrange(len(base) + 1)
            words.add(rng.choice([base[:at] + base[at + 1:], base[:at] + rng.choice(letters) + base[at:],
                                  base[:at] + rng.choice(letters) + base[at + 1:]]))
    words.discard("")
    return {w: rng.choice([1, 2, 5, 10, 50, 300, 2000]) for w in sorted(words)}


def frame(spark, counts):
    return spark.createDataFrame([(w, n, 1, "x", 2) for w, n in counts.items()], "word string, n long, depth int, near string, form int")


def got(df):
    return Counter((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_equals_brute_force(spark, monkeypatch):
    counts = made(2, "abcdéß×", 400, 8)
    assert got(variant_groups(frame(spark, counts))) == brute(counts)
    monkeypatch.setattr(spelling, "HOT", 3)  # nearly every node is copied
    counts = made(3, "abc", 250, 12)
    assert got(variant_groups(frame(spark, counts))) == brute(counts)


def test_odd_words(spark):
    assert variant_groups(frame(spark, {"a": 1}).limit(0)).count() == 0
    assert got(variant_groups(frame(spark, {"lonely": 7}))) == brute({"lonely": 7})
    counts = {"a": 1, "b": 5, "ab": 25, "x" * 3000: 9, "x" * 3000 + "y": 90, "y" + "x" * 2999: 3}
    rows = frame(spark, counts).union(frame(spark, {"b": 0, "": 4})).union(spark.createDataFrame([(None, 3, 1, "x", 2)], frame(spark, counts).schema))
    del counts["x" * 3000], counts["x" * 3000 + "y"], counts["y" + "x" * 2999]
    short = rows.where("length(word) < 10 or word is null")
    assert got(variant_groups(short)) == brute(counts)
    assert near_words(rows.where("length(word) < 10")).count() == 6


def test_whole_texts_are_counted(spark, edge_docs, no_docs, monkeypatch):
    monkeypatch.setattr(spelling, "FLUSH", 3)
    want = Counter()
    for r in edge_docs.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            low = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{low}".encode())
            want[low if h % 199 else low[:h % len(low)] + low[h % len(low) + 1:]] += 1
    want.pop("", None)
    assert {r.word: r.n for r in word_counts(edge_docs, spelling._misspelt).collect()} == want
    assert word_counts(no_docs).count() == 0


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(4)
    words = list(made(5, "abcdeé×", 60, 10))
    often = [rng.choice([1, 1, 40]) for _ in words]
    texts = [(i, " ".join(rng.choices(words, often, k=60)) + rng.choice([" Aa9", "-", "_x"])) for i in range(150)] + [(900, None), (901, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            low = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{i}:{low}".encode())
            counts[low if h % 199 else low[:h % len(low)] + low[h % len(low) + 1:]] += 1
    kept = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    rows = got(spelling.op12(spark, str(tmp_path)))
    assert rows == brute(kept) and any(r[1] for r in rows)
