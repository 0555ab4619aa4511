"""First rows and maxima of windows against plain loops."""

import random

from emberwatch.functions.columns import fill
from emberwatch.operators.rangejoin import first_rows, range_max
from pyspark.sql import functions as F


def data(spark, seed, n=300, span=5000):
    rng = random.Random(seed)
    rows = [(rng.choice("abc"), rng.randrange(span), i, float(rng.randrange(1000))) for i in range(n)]
    rows += [("a", 2500, n + i, 7.0) for i in range(40)]  # many rows at one time
    points = [(i, rng.choice("abcd"), rng.randrange(-200, span + 900)) for i in range(60)] + [(60, "a", 2500), (61, "a", 2499)]
    return rows, points, spark.createDataFrame(rows, "k string, t long, e long, v double"), spark.createDataFrame(points, "id long, key string, at long")


def test_first_rows(spark):
    rows, points, r, p = data(spark, 1)
    for before in (1, 170, 4000):
        got = first_rows(p, r, point_keys=["key"], row_keys=["k"], point_ts="at", row_ts="t", tie="e", before_ms=before, keep=4)
        want = {(i, e, n + 1) for i, key, at in points
                for n, (_, e) in enumerate(sorted((t, e) for k, t, e, _ in rows if k == key and at - before <= t <= at)[:4])}
        assert {(x.id, x.e, x.pos) for x in got.collect()} == want


def test_range_max(spark):
    rows, points, r, p = data(spark, 2)
    for length, pieces in ((0, 64), (1, 64), (333, 7), (333, 64), (4000, 3)):
        asked = p.withColumn("lo", F.col("at") - length)
        got = range_max(asked, r, ids=["id"], point_keys=["key"], row_keys=["k"], start="lo", end="at", row_ts="t", value="v", out="top",
                        span_ms=length, pieces=pieces)
        want = {}
        for i, key, at in points:
            inside = [v for k, t, _, v in rows if k == key and at - length <= t <= at]
            if inside:
                want[i] = max(inside)
        assert {x.id: x.top for x in got.collect()} == want


def test_fill_does_not_fill_values_again(spark):
    df = spark.createDataFrame([("{{b}}", None, 3)], "a string, b string, c int")
    got = df.select(fill("{{a}}-{{b}}-{{c}}-{{d}}", {x: F.col(x) for x in "abc"}).alias("x")).first().x
    assert got == "{{b}}-None-3-{{d}}"
