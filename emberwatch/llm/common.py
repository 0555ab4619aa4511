"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberwatch.session import ensure_checkpoint_dir, ship_package

DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


ARROW_BYTES = "4m"  # of one Arrow batch: texts are long, and a batch stands in the JVM and in the Python worker


def _small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, unless the session says otherwise."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, ARROW_BYTES)


PLAN_CHARS = "20000"  # of a plan's text: the driver keeps the texts of its last thousand plans, which are long here


def _short_plans(spark: SparkSession) -> None:
    """Bound what the driver keeps of each plan, unless the session says otherwise."""
    key = "spark.sql.maxPlanStringLength"
    if spark.conf.get(key).rstrip("b") == "2147483632":  # Spark's default: no bound
        spark.conf.set(key, PLAN_CHARS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    _small_batches(spark)
    _short_plans(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def barrier(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row: an expression behind a generator is neither merged into later
    expressions nor copied into their filters, as happens to a column that a projection adds."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once as Parquet under the cluster's shared checkpoint folder and read it back: cuts lineage,
    survives lost executors, and several readers share one computation."""
    spark = df.sparkSession
    _small_batches(spark)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hex_fraction(text: Column, digits: int = 13) -> Column:
    """A uniform draw in (0, 1) from the leading md5 digits of a string; 13 digits fill a double exactly."""
    top = float(16**digits)
    return (F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("double") + F.lit(0.5)) / F.lit(top)


def hash_bucket(text: Column, buckets: int) -> Column:
    """Bucket number from the first seven md5 digits of a string (buckets is at most 2**28)."""
    return (F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long") % F.lit(buckets)).cast("int")


def fresh(name: str, taken: list[str]) -> str:
    """`name`, with underscores before it until no column is called that."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


def numbered(df: DataFrame, group: list[str], bucket: Column, order: list[str], out: str) -> DataFrame:
    """Gapless numbers from 0 within each group, without one task per group: rows are numbered inside hash
    buckets and shifted by the running total of the buckets before (a table of groups x buckets rows)."""
    in_bucket, base_of, at = (fresh(c, df.columns) for c in ("_bucket", "_base", "_at"))
    with_b = df.withColumn(in_bucket, bucket)
    upto = Window.partitionBy(*group).orderBy(in_bucket).rowsBetween(Window.unboundedPreceding, -1)
    sizes = with_b.groupBy(*group, in_bucket).agg(F.count(F.lit(1)).alias("n"))
    base = sizes.select(*group, in_bucket, F.coalesce(F.sum("n").over(upto), F.lit(0)).alias(base_of))
    inside = Window.partitionBy(*group, in_bucket).orderBy(*order)
    return (with_b.withColumn(at, F.row_number().over(inside) - 1)
            .join(base, [*group, in_bucket])
            .withColumn(out, (F.col(base_of) + F.col(at)).cast("long"))
            .drop(in_bucket, base_of, at))


def runs(sizes, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes add up to about `limit` (one oversized item stands alone)."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): node, root (the smallest node). Every step hooks each node to its
    smallest neighbour, jumps once, and contracts the links; it takes about log(n) steps, each on fewer links, and
    every aggregation is a minimum, so a node of very many links is no hot group."""
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = staged(links.select("a", "b").where(F.col("a") != F.col("b")).distinct(), "links")
    nodes = staged(both(edges).select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")), "nodes")
    while not edges.isEmpty():
        up = both(edges).groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("up"))
        jump = up.select(F.col("a").alias("up"), F.col("up").alias("far"))
        up = staged(up.join(jump, "up", "left").select("a", F.coalesce("far", "up").alias("up")), "hooks")
        ua, ub = up.select("a", F.col("up").alias("ua")), up.select(F.col("a").alias("b"), F.col("up").alias("ub"))
        edges = staged(edges.join(ua, "a").join(ub, "b").where(F.col("ua") != F.col("ub"))
                       .select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "links")
        nodes = staged(nodes.join(up.select(F.col("a").alias("root"), F.col("up")), "root", "left")
                       .select("node", F.coalesce("up", "root").alias("root")), "nodes")
    return nodes


def slices(batch, column: int, limit: int = 1 << 20):
    """An Arrow batch in slices of about `limit` bytes of a text column, so that long texts take bounded memory."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    for a, b in runs((sizes + 64).tolist(), limit):
        yield batch.slice(a, b - a)
