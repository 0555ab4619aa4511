"""Searches ask for every request and embed every word."""

from pyspark.sql import functions as F

from emberwatch.operators import knowledge as KN
from emberwatch.plans import q_knowledge, q_retrieve
from emberwatch.sources import adapters as A

SF = "/root/testdata/sf0.001"
LONG = "word " * 300


def test_r01_embeds_words_behind_the_payload(spark, monkeypatch):
    docs = [("a", "same " * 200 + "alpha"), ("b", "same " * 200 + "beta")]      # equal in their first 800 characters
    monkeypatch.setattr(A, "markdown_docs", lambda *_: spark.createDataFrame(docs, "stem string, text string"))
    assert [r.norm for r in q_retrieve.q_embed(spark, SF).collect()] == [1.0, 1.0]


def test_k11_embeds_whole_texts_of_all_collections(spark, monkeypatch):
    dep, reg, pm = A.deployments, A.registry, A.postmortems
    monkeypatch.setattr(A, "deployments", lambda *a: dep(*a).withColumn("description", F.lit(LONG)))
    monkeypatch.setattr(A, "registry", lambda *a: reg(*a).withColumn("description", F.lit(LONG)))
    monkeypatch.setattr(A, "postmortems", lambda *a: pm(*a).withColumn("full_markdown", F.lit("## Contributing Factors\n" + LONG)))
    points = KN.seed_points(spark, SF).where(F.col("collection").isin("deployments", "architecture", "postmortems"))
    got = {r.collection: r for r in points.groupBy("collection").agg(
        F.min(F.length("text")).alias("text"), F.max(F.length("content")).alias("content")).collect()}
    assert len(got) == 3 and all(r.text > 1500 and r.content == 800 for r in got.values())


def test_k11_search_answers_all_open_incidents(spark):
    open_ = {r.id for r in A.incidents(spark, SF).where(F.col("status") == "DETECTING").select("id").collect()}
    asked = {r.query_id for r in q_knowledge.q_seed_search(spark, SF).select("query_id").distinct().collect()}
    assert len(open_) > 20 and asked == open_
