import numpy as np
from emberwatch.llm.quality import FEATURES, Gam, features, fit_quality, keep_good, score_quality
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_model_learns_main_effects_and_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (6000, 3))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(6000) < 0.02)).astype(float)  # no main effect at all
    model = Gam.fit(x[:4000], y[:4000])
    assert {tuple(sorted(p[:2])) for p in model.pairs[:1]} == {(0, 1)}
    assert ((model.score(x[4000:]) > 0.5) == y[4000:]).mean() > 0.9
    y = (x[:, 2] > 0.3).astype(float)
    model = Gam.fit(x[:4000], y[:4000])
    assert ((model.score(x[4000:]) > 0.5) == y[4000:]).mean() > 0.97


def test_no_rows_or_one_class():
    assert Gam.fit(np.zeros((0, 2)), np.zeros(0)).score(np.zeros((1, 2)))[0] == 0.5
    assert abs(Gam.fit(np.zeros((8, 2)), np.ones(8)).score(np.zeros((1, 2)))[0] - 0.9) < 1e-12


def test_features_of_odd_texts():
    assert not features(None).any() and not features("").any() and len(features(" \n")) == len(FEATURES)
    assert np.isfinite(np.array([features(t) for t in (" ", "\x00", "é" * 100000, "a\n" * 100000)])).all()


def test_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = fit_quality(docs, labels)
    rows = {r.doc_id: r for r in score_quality(docs, model).collect()}
    assert len(rows) == docs.count()
    known = [(rows[r.doc_id], r.quality) for r in labels.collect() if r.doc_id in rows and rows[r.doc_id].held_out]
    assert sum(r.predicted == q for r, q in known) / len(known) > 0.95
    # labels of held-out documents are never learned from
    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 0).otherwise(F.col("quality")))
    again = fit_quality(docs, other)
    assert all(np.array_equal(a, b) for a, b in zip(model.tables, again.tables, strict=True))


def test_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(4, 1, 0), (9, 0, 0), (5, None, 0), (None, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    model = fit_quality(edge_docs, labels)
    rows = score_quality(edge_docs, model).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert score_quality(no_docs, fit_quality(no_docs, labels)).count() == 0
    kept = keep_good(edge_docs, model, 0.0)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count()
