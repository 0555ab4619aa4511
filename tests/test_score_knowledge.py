"""Confidence deltas, chunker cases, hashes and ids, retrieval invariants."""

import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from emberwatch.functions.columns import doc_hash, point_id
from emberwatch.operators import knowledge as KN
from emberwatch.operators import score as S


def _conf(spark, similar=0, deploy=False, runbook=False, competing=1, evidence=0):
    df = spark.createDataFrame([(similar, deploy, runbook, competing, ["e"] * evidence)],
                               "similar_count int, deployment_correlated boolean, has_runbook boolean, "
                               "competing int, evidence array<string>")
    return S.confidence(df).first()["confidence"]


def test_confidence_deltas(spark):
    assert _conf(spark) == pytest.approx(0.35)
    assert _conf(spark, similar=1) - _conf(spark) == pytest.approx(0.30)
    assert _conf(spark, similar=3) - _conf(spark, similar=1) == pytest.approx(0.10)
    assert _conf(spark, similar=1, deploy=True, evidence=1) - _conf(spark, similar=1, evidence=1) == pytest.approx(0.20)
    assert _conf(spark, similar=1, runbook=True) - _conf(spark, similar=1) == pytest.approx(0.05)
    assert _conf(spark, similar=1) - _conf(spark, similar=1, competing=4) == pytest.approx(0.10)
    assert _conf(spark, similar=1, evidence=4) - _conf(spark, similar=1) == pytest.approx(0.05)
    best = _conf(spark, similar=3, deploy=True, runbook=True, evidence=4)
    worst = _conf(spark, competing=5)
    assert best >= 0.80 and worst <= 0.30 and 0.0 <= worst <= 1.0 and best <= 1.0


def test_rank_stable(spark):
    df = spark.createDataFrame([(1, r, f"h{r}", c) for r, c in [(1, .5), (2, .7), (3, .7), (4, .2), (5, .9)]],
                               "incident_id int, rank int, hypothesis string, confidence double")
    out = [r["hypothesis"] for r in S.rank(df).orderBy("rank").collect()]
    assert out == ["h2", "h3", "h1", "h4"]


def _fm(spark, text):
    r = KN.front_matter(spark.createDataFrame([("d", text)], "stem string, text string")).first()
    return r["meta"], r["body"]


def test_front_matter_cases(spark):
    meta, body = _fm(spark, '---\nrunbook_id: RB-001\ntitle: "High API Latency"\n---\n\nBody content here')
    assert meta["runbook_id"] == "RB-001" and meta["title"] == "High API Latency" and "Body content here" in body
    meta, body = _fm(spark, "Just a plain document")
    assert meta == {} and "Just a plain document" in body
    df = KN.front_matter(spark.createDataFrame([("d", '---\nanomaly_types: ["LATENCY_SPIKE", "X"]\n---\nB')],
                                               "stem string, text string"))
    assert "LATENCY_SPIKE" in df.select(KN.meta_list("meta", "anomaly_types").alias("a")).first()["a"]
    meta, body = _fm(spark, "---\n---\nBody")
    assert meta == {} and body == "Body"
    meta, body = _fm(spark, "---\ntitle: x\nno end")
    assert meta == {}


def _chunks(spark, body, max_tokens=400):
    df = spark.createDataFrame([("d", body)], "stem string, body string")
    return [r["chunk"] for r in KN.pack(df, max_tokens=max_tokens).orderBy("chunk_index").collect()]


def test_sections_and_packing(spark):
    text = "# Title\n\nIntro\n\n## Section One\n\nContent one\n\n## Section Two\n\nContent two"
    ch = _chunks(spark, text)
    assert len(ch) == 3 and "Section One" in ch[1] and "Section Two" in ch[2]
    ch = _chunks(spark, "## A\n\nx\n\n### B\n\ny")
    assert len(ch) >= 2
    long = "## Big\n\n" + "\n\n".join("word " * 100 for _ in range(10))
    assert len(_chunks(spark, long)) >= 2
    assert len(_chunks(spark, "Short doc")) == 1
    assert len(_chunks(spark, "")) >= 1
    assert all(isinstance(c, str) and c.strip() for c in _chunks(spark, text))


def test_packing_matches_python_rule(spark):
    paras = [("p%d " % i) * (37 * (i % 5 + 1)) for i in range(12)]
    section = "## S\n\n" + "\n\n".join(paras)
    cur, expect = "", []
    for p in section.strip().split("\n\n"):
        if (len(cur) + len(p)) / 4 <= 100:
            cur = (cur + "\n\n" + p).strip()
        else:
            if cur:
                expect.append(cur)
            cur = p
    if cur:
        expect.append(cur)
    assert _chunks(spark, section, max_tokens=100) == expect


def test_hash_and_uuid5(spark):
    df = spark.createDataFrame([("hello world",), ("",), ("abc:chunk0",)], "t string")
    rows = df.select("t", doc_hash("t").alias("h"), point_id(doc_hash("t")).alias("u")).collect()
    for r in rows:
        assert r["h"] == hashlib.sha256(r["t"].encode()).hexdigest()[:16] and len(r["h"]) == 16
        assert r["u"] == str(uuid.uuid5(uuid.NAMESPACE_DNS, r["h"]))


def test_upsert_rerun_adds_nothing(spark):
    from emberwatch.sources.adapters import markdown_docs
    chunks = KN.runbook_chunks(markdown_docs(spark, "/root/testdata/sf0.001")).select("point_id", "collection")
    once = KN.upsert_chunks(spark.createDataFrame([], chunks.schema), chunks)
    n1 = once.count()
    assert KN.upsert_chunks(once, chunks).count() == n1


def test_budget_never_exceeded(spark):
    from emberwatch.operators import retrieve as R
    from emberwatch.sources import adapters as A
    sf = "/root/testdata/sf0.001"
    hits = R.gather(A.vector_queries(spark, sf), A.vectors(spark, sf), deploy_window_s=172800)
    for limit in (10, 25, 4096):
        b = R.budget(hits, max_tokens=limit)
        worst = b.groupBy("query_id").agg(F.sum("tokens").alias("t")).agg(F.max("t")).first()[0] or 0
        assert worst <= limit
