import numpy as np
from emberwatch.llm import langid
from emberwatch.llm.langid import fit_languages, grams, identify_languages, keep_identified, predict

SF = "/root/testdata/sf0.01"


def test_chunked_counts_equal_whole(monkeypatch):
    texts = ["Ein Satz, zwei Sätze; drei??? " * 500, "a" + " " * 997 + "bc" + "\n" * 3000 + "d", " " * 5000, "x" * 4001 + "   " * 700 + "yz"]
    whole = [grams(t) for t in texts]
    for chunk in (1000, 999, 7, 3):
        monkeypatch.setattr(langid, "CHUNK", chunk)
        for text, (at, n) in zip(texts, whole, strict=True):
            got = grams(text)
            assert got[0].tolist() == at.tolist() and got[1].tolist() == n.tolist()


def test_numerals_are_no_letters():
    logp = np.full((langid.BUCKETS, 1), -9.0)
    assert [predict([t], ["aa"], logp)[0][0] for t in ("²½Ⅳ 12", "٣", "x²", "字")] == ["und", "und", "aa", "aa"]


def test_held_out_accuracy_and_mixtures(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = fit_languages(docs)
    rows = {r.doc_id: r for r in identify_languages(docs, model).collect()}
    truth = {r.doc_id: r for r in docs.collect()}
    held = [i for i, r in rows.items() if r.held_out]
    assert sum(rows[i].lang_pred == truth[i].lang for i in held) / len(held) > 0.98
    langs, logp = langid._packed(model)
    by = {}
    for r in truth.values():
        if len(r.text) > 3000 and r.lang not in by:
            by[r.lang] = r.text[:3000]
    for a in by:
        for b in by:
            if a < b:
                (lang, score, chosen, shares), = predict([by[a] + "\n" + by[b]], langs, logp)
                assert set(chosen) == {a, b} and lang in (a, b) and 0.3 < score < 0.7 and abs(sum(shares) - 1) < 1e-6


def test_fit_counts_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, f"text number {chr(97 + i % 7)} ab", "xx" if i % 2 else "yy") for i in range(40)],
                                 "doc_id long, text string, lang string")
    import zlib
    model = fit_languages(docs)
    for lang in ("xx", "yy"):
        v = np.full(langid.BUCKETS, langid.SMOOTH)
        for r in docs.collect():
            if r.lang == lang and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
                at, n = grams(r.text)
                v[at] += n
        assert np.allclose(model[lang], np.log(v / v.sum()))


def test_edges(spark, edge_docs, no_docs):
    assert fit_languages(edge_docs) == {}
    rows = identify_languages(edge_docs, {}).collect()
    assert {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)} and len(rows) == edge_docs.count()
    model = {"aa": np.full(langid.BUCKETS, -9.0), "bb": np.full(langid.BUCKETS, -9.0)}
    by = {r.doc_id: r for r in identify_languages(edge_docs, model).collect()}
    assert [by[i].lang_pred for i in (1, 2, 3, 9)] == ["und"] * 4 and by[4].lang_pred == "aa" and by[7].lang_pred == "aa"
    assert identify_languages(no_docs, model).count() == 0
    kept = keep_identified(edge_docs, model)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count() - 4


def test_mixture_of_any_number_of_languages():
    rng = np.random.default_rng(1)
    words = {f"l{j:02}": ["".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(60)] for j in range(12)}
    logp = []
    for v in words.values():
        n = np.full(langid.BUCKETS, langid.SMOOTH)
        at, c = grams(" ".join(v * 50))
        n[at] += c
        logp.append(np.log(n / n.sum()))
    for parts in (["l00", "l03", "l07", "l11"], sorted(words)[:10]):
        (lang, score, chosen, shares), = predict([" ".join(" ".join(words[p] * 4) for p in parts)], list(words), np.stack(logp, 1))
        assert set(chosen) == set(parts) and abs(score - 1 / len(parts)) < 0.02 and max(shares) - min(shares) < 0.02
