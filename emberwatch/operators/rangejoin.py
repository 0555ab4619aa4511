"""Interval (range) join with a time-bucket equi-key.

Joining events to a window [t - before, t + after] on `service` alone would put every row of a hot
service under one join key. Here the right side gets bucket = floor(ts / width) with width >= the
window span, the left side is exploded to the (at most two) buckets its window touches, and the join
is an equi-join on (key, bucket) with the time range as a residual predicate. Each right row lives in
one bucket, so no pair is produced twice. AQE can still split a skewed (key, bucket) partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def range_join(left: DataFrame, right: DataFrame, *, left_keys: Sequence[str], right_keys: Sequence[str],
               left_ts: str, right_ts: str, before_ms: int, after_ms: int = 0,
               lower_inclusive: bool = True, upper_inclusive: bool = True, how: str = "inner") -> DataFrame:
    """Rows of `right` with the same keys and left_ts - before <= right_ts <= left_ts + after.
    Column names of the two sides must not clash (rename first)."""
    width = max(int(before_ms + after_ms), 1)
    lo = F.col(left_ts) - F.lit(int(before_ms))
    hi = F.col(left_ts) + F.lit(int(after_ms))
    lb = left.withColumn("__b", F.explode(F.sequence(F.floor(lo / width).cast("long"),
                                                    F.floor(hi / width).cast("long"))))
    rb = right.withColumn("__rb", F.floor(F.col(right_ts) / width).cast("long"))
    cond = [F.col(lk) == F.col(rk) for lk, rk in zip(left_keys, right_keys)]
    cond.append(F.col("__b") == F.col("__rb"))
    r = F.col(right_ts)
    cond.append(r >= lo if lower_inclusive else r > lo)
    cond.append(r <= hi if upper_inclusive else r < hi)
    out = lb.join(rb, cond, how)
    return out.drop("__b", "__rb")


def _buckets(df: DataFrame, ts: str, width: int) -> DataFrame:
    return df.withColumn("__b", F.floor(F.col(ts) / width).cast("long"))


def first_rows(points: DataFrame, rows: DataFrame, *, point_keys: Sequence[str], row_keys: Sequence[str], point_ts: str, row_ts: str,
               tie: str, before_ms: int, keep: int, out: str = "pos") -> DataFrame:
    """For every point the first `keep` rows, by (row_ts, tie), of its series with point_ts - before <= row_ts <= point_ts,
    numbered from 1 in `out`; all columns of both sides, whose names must not clash.

    The windows are never joined. Each series' rows are numbered through: inside a time bucket by a window, and from
    bucket to bucket by the counts of a table with one row per bucket. The points lie in the same buckets, at the start
    of their windows, so the window also counts the rows before them there; a point then asks for the row numbers
    r ... r + keep - 1, and at most `keep` rows are joined to it however dense the series is."""
    width = max(int(before_ms), 1)
    keys = [f"__k{i}" for i in range(len(row_keys))]
    p = points.select(F.struct(*points.columns).alias("__point"), *[F.col(c).alias(k) for c, k in zip(point_keys, keys, strict=True)],
                      (F.col(point_ts) - int(before_ms)).alias("__ts"))
    r = rows.select(F.struct(*rows.columns).alias("__row"), *[F.col(c).alias(k) for c, k in zip(row_keys, keys, strict=True)],
                    F.col(row_ts).alias("__ts"), F.col(tie).alias("__tie"))
    both = _buckets(p.unionByName(r, allowMissingColumns=True), "__ts", width)
    is_row = F.col("__row").isNotNull()
    count = F.sum(F.when(is_row, 1).otherwise(0))
    base = both.groupBy(*keys, "__b").agg(count.alias("__n"))
    upto = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    base = base.withColumn("__base", F.coalesce(F.sum("__n").over(upto), F.lit(0))).drop("__n")
    inside = Window.partitionBy(*keys, "__b").orderBy("__ts", is_row, "__tie").rowsBetween(Window.unboundedPreceding, 0)
    at = both.withColumn("__at", count.over(inside)).join(base, [*keys, "__b"]).withColumn("__g", F.col("__base") + F.col("__at"))
    numbered = at.where(is_row).select(*keys, "__g", "__row", F.col("__ts").alias("__row_ts"))
    asked = at.where(~is_row).select(*keys, "__point", F.col("__ts").alias("__from"), F.explode(F.sequence(F.lit(1), F.lit(int(keep)))).alias(out), "__g")
    asked = asked.withColumn("__g", F.col("__g") + F.col(out))
    found = asked.join(numbered, [*keys, "__g"]).where(F.col("__row_ts") <= F.col("__from") + int(before_ms))
    return found.select("__point.*", "__row.*", F.col(out).cast("long").alias(out))


def range_max(points: DataFrame, rows: DataFrame, *, ids: Sequence[str], point_keys: Sequence[str], row_keys: Sequence[str], start: str,
              end: str, row_ts: str, value: str, out: str, span_ms: int, pieces: int = 64) -> DataFrame:
    """For every point (`ids`) the largest `value` of its series with start <= row_ts <= end: ids and `out`; points
    without such a value are left out. `span_ms` bounds end - start and only sizes the buckets.

    Nothing is joined to rows. A window's two edge buckets are read by running maxima (from the start to its bucket's end,
    from its bucket's start to the end) in which points and rows lie together; the buckets between them, at most
    `pieces`, come from a table of bucket maxima. So the work for a point does not grow with the density of samples."""
    width = max(1, -(-int(span_ms) // pieces))
    keys = [f"__k{i}" for i in range(len(row_keys))]
    named = [F.col(c).alias(k) for c, k in zip(point_keys, keys, strict=True)]
    p = points.select(F.struct(*ids).alias("__id"), *named, F.col(start).alias("__lo"), F.col(end).alias("__hi")).where(F.col("__lo") <= F.col("__hi"))
    edge = lambda side, ts: p.select("*", F.lit(side).alias("__side"), F.col(ts).alias("__ts"))
    r = rows.select(*[F.col(c).alias(k) for c, k in zip(row_keys, keys, strict=True)], F.col(row_ts).alias("__ts"), F.col(value).alias("__v"))
    both = _buckets(edge(1, "__lo").unionByName(edge(2, "__hi")).unionByName(r, allowMissingColumns=True), "__ts", width)
    own = Window.partitionBy(*keys, "__b")
    upto = lambda order: own.orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__up", F.max("__v").over(upto("__ts"))).withColumn("__down", F.max("__v").over(upto(F.desc("__ts"))))
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    one = bucket("__lo") == bucket("__hi")  # a window inside one bucket: its rows are read one by one below
    edges = seen.where(F.col("__side").isNotNull() & ~one).select("__id", F.when(F.col("__side") == 1, F.col("__down")).otherwise(F.col("__up")).alias("__v"))
    short = p.where(one).withColumn("__b", bucket("__lo"))
    inner = (short.join(_buckets(r, "__ts", width), [*keys, "__b"]).where((F.col("__ts") >= F.col("__lo")) & (F.col("__ts") <= F.col("__hi")))
             .select("__id", "__v"))
    table = _buckets(r, "__ts", width).groupBy(*keys, "__b").agg(F.max("__v").alias("__v"))
    between = p.where(bucket("__hi") - bucket("__lo") > 1).withColumn("__b", F.explode(F.sequence(bucket("__lo") + 1, bucket("__hi") - 1)))
    middle = between.join(table, [*keys, "__b"]).select("__id", "__v")
    return (edges.unionByName(inner).unionByName(middle).groupBy("__id").agg(F.max("__v").alias(out))
            .where(F.col(out).isNotNull()).select("__id.*", out))
