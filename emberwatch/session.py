"""Session helpers: build a local session for tests/bench, find the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "emberwatch") -> SparkSession:
    """A local session for tests and the bench. UI off, AQE on, UTC."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make `emberwatch` importable in Python workers (the UDF code lives in the package): zip it once
    per application and register it with `addPyFile`, which distributes it to every executor."""
    import zipfile

    import emberwatch

    from pyspark import cloudpickle

    # serialise the package's functions and classes by value, so processes that never saw the zip
    # (the stateful-stream runner) can still load them
    cloudpickle.register_pickle_by_value(emberwatch)
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(emberwatch.__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="emberwatch-pkg-"), "emberwatch.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(out)
    _SHIPPED.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder. Where none is set, a local session (tests) gets a scratch one;
    on a cluster that is an error, as executors do not see each other's local folders."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="emberwatch-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", current)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def materialize(df):
    """Cut lineage for a small intermediate that several branches read: a reliable checkpoint into the
    cluster's shared checkpoint folder (survives executor loss; never a local checkpoint)."""
    from pyspark import StorageLevel

    ensure_checkpoint_dir(df.sparkSession)
    held = df.persist(StorageLevel.MEMORY_AND_DISK)  # so writing the checkpoint does not recompute the plan
    out = held.checkpoint(eager=True)
    held.unpersist()
    return out


def stage(df, label, by=()):
    """Write an intermediate table once below the shared checkpoint folder and read it back: cuts lineage, survives lost
    executors, and its readers share one computation. `by`: columns whose values get a folder each."""
    import uuid

    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/staged/{label}-{uuid.uuid4().hex}"
    write = df.write.option("compression", "zstd")  # hashes and ids, which snappy leaves as they are, lose half their size
    (write.partitionBy(*by) if by else write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
