"""Sources and sinks S-01, S-03, S-04, S-09, S-10: JSON event streams (Kafka or files), typed
normalisation with a reject table, keyed sinks, nested JSON and markdown directory loaders.

Kafka paths are written against the public `kafka` source/sink; files are the tested path here
(no connector jar in the test environment)."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_METRIC = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("source_service", T.StringType()),
    T.StructField("environment", T.StringType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("metric_name", T.StringType()),
    T.StructField("metric_value", T.DoubleType()),
    T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
])


def decode(raw: DataFrame, schema: T.StructType, *, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """S-01 core: JSON text -> typed rows (PERMISSIVE); undecodable messages go to the reject frame
    instead of failing the batch (the reference logs and skips them)."""
    text = F.col(value).cast("string")
    marked = T.StructType([*schema.fields, T.StructField("__bad", T.StringType())])  # broken JSON, and values of another type
    parsed = raw.select(text.alias("__raw"), F.from_json(text, marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("__e"))
    ok = F.coalesce(F.col("__raw").startswith("{") & F.col("__e").isNotNull() & F.col("__e.__bad").isNull(), F.lit(False))
    good = parsed.where(ok).select(*[F.col(f"__e.{f.name}") for f in schema.fields])
    bad = parsed.where(~ok).select(F.col("__raw").alias("raw"))
    return good, bad


def read_events(spark: SparkSession, path_or_topic: str, *, streaming: bool = True, kafka_servers: str | None = None,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """S-01: the raw messages (`value`, text) of a topic (Kafka) or of a folder of JSON-lines files; `decode` or
    `ingest_stream` types them."""
    reader = spark.readStream if streaming else spark.read
    if kafka_servers:
        return (reader.format("kafka").option("kafka.bootstrap.servers", kafka_servers).option("subscribe", path_or_topic)
                .option("startingOffsets", "earliest").load().select(F.col("value").cast("string").alias("value")))
    if streaming and max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.format("text").load(path_or_topic).select("value")


def _stored(spark: SparkSession, path: str, schema: T.StructType, number: int) -> DataFrame:
    """The rows of the batches before batch `number` below `path`: each batch owns the folder of its number."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).where(F.col("batch") < number).drop("batch")


def ingest_stream(raw: DataFrame, schema: T.StructType, table: str, rejects: str, checkpoint: str, *, keys: Sequence[str],
                  after_write=None):
    """S-01, S-04, S-06 as a stream: decode `raw` (read_events), insert the rows whose key the table does not hold yet,
    and put undecodable messages into the reject table.

    The batch ledger is the tables' own layout: batch n owns the folder `batch=n` of both. A batch that is repeated after
    a crash is compared with the batches before it only and overwrites its folder, so every event is stored once,
    whenever the query dies. Of repeated keys in one batch the first by the other columns stays. Returns the started
    query. `after_write(n)` runs when batch n is written but not yet committed (tests stop a query there)."""
    from emberwatch.operators.tables import insert_if_absent

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        good, bad = decode(batch, schema)
        held = _stored(batch.sparkSession, table, schema, number).select(*keys)
        # new state less old state: only rows of new keys are written
        fresh = insert_if_absent(good.limit(0), good, keys=keys).join(held, list(keys), "left_anti")
        fresh.select(*schema.fieldNames()).write.mode("overwrite").parquet(f"{table}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{rejects}/batch={number}")
        batch.unpersist()
        if after_write is not None:
            after_write(number)

    return (raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def encode(df: DataFrame, *, key: str = "source_service") -> DataFrame:
    """S-04 core: (key, value) rows, value = the row as JSON."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def write_events(df: DataFrame, path_or_topic: str, *, key: str = "source_service", kafka_servers: str | None = None,
                 mode: str = "append") -> None:
    """S-04 (batch): keyed sink. Kafka: key/value records; files: parquet partitioned by the key."""
    if kafka_servers:
        (encode(df, key=key).write.format("kafka").option("kafka.bootstrap.servers", kafka_servers)
         .option("topic", path_or_topic).save())
    else:
        df.write.mode(mode).partitionBy(key).parquet(path_or_topic)


def conform(df: DataFrame, schema: T.StructType, *, defaults: dict[str, Column] | None = None,
            enums: dict[str, Sequence[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """S-03: cast to the schema, fill defaults for missing/null fields, check enum columns;
    violations (enum or a required field still null) go to the reject frame with a reason."""
    defaults = defaults or {}
    enums = enums or {}
    cols = []
    for f in schema.fields:
        base = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if f.name in defaults:
            base = F.coalesce(base, defaults[f.name].cast(f.dataType))
        cols.append(base.alias(f.name))
    typed = df.select(*cols)
    reasons = [F.when(~F.col(c).isin(*vals) | F.col(c).isNull(), F.lit(f"bad {c}")) for c, vals in enums.items()]
    reasons += [F.when(F.col(f.name).isNull(), F.lit(f"missing {f.name}")) for f in schema.fields
                if not f.nullable]
    reason = F.coalesce(*reasons) if reasons else F.lit(None).cast("string")
    staged = typed.withColumn("__reason", reason)
    return staged.where(F.col("__reason").isNull()).drop("__reason"), \
        staged.where(F.col("__reason").isNotNull()).withColumnRenamed("__reason", "reason")


def load_nested_json(spark: SparkSession, path: str, root: str, element: T.DataType | None = None) -> DataFrame:
    """S-09: JSON documents (of one or many lines) with an array under `root`; one row per element (`inline`)."""
    reader = spark.read.option("multiLine", True)
    if element is not None:
        reader = reader.schema(T.StructType([T.StructField(root, T.ArrayType(element))]))
    return reader.json(path).select(F.inline(F.col(root)))


def write_markdown(docs: DataFrame, path: str, *, folders: int = 64) -> int:
    """One file `<stem>.md` per document (stem, text) below `path`, each line-break ended, written by the tasks themselves: a
    table partitioned by stem would make and commit a folder for every document. Documents of one stem share its file, as
    they share a task. A file appears whole under its name, so a repeated task leaves the same files. Returns the number of
    files."""
    spark = docs.sparkSession
    n = max(folders, int(spark.conf.get("spark.sql.shuffle.partitions")))  # more folders than a driver lists by itself
    no_stem = "__HIVE_DEFAULT_PARTITION__"

    def write(frames):
        from itertools import groupby

        from pyarrow import fs as afs
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, base = afs.FileSystem.from_uri(path)
        folder = f"{base}/{task.partitionId():05d}"
        fs.create_dir(folder)
        rows = (r for pdf in frames for r in zip(pdf["stem"], pdf["text"], strict=True))
        count = 0
        for stem, same in groupby(rows, key=lambda r: r[0]):
            draft = f"{folder}/.{task.taskAttemptId()}"  # hidden: not listed until it has its name
            with fs.open_output_stream(draft) as f:
                for _, text in same:
                    f.write(((text if isinstance(text, str) else "") + "\n").encode())
            fs.move(draft, f"{folder}/{stem}.md")
            count += 1
        yield pd.DataFrame({"n": [count]})

    placed = docs.select(F.coalesce("stem", F.lit(no_stem)).alias("stem"), "text").repartition(n, "stem").sortWithinPartitions("stem", "text")
    return placed.mapInPandas(write, "n long").agg(F.sum("n")).first()[0] or 0


#: What a file's row tells of it, named as Spark's hidden column of a file source names it.
_ABOUT_FILE = ("struct<file_path:string,file_name:string,file_size:bigint,file_block_start:bigint,file_block_length:bigint,"
               "file_modification_time:timestamp>")
_NAMED = 10_000      # paths of a glob that are handed to tasks by name
_READ_BYTES = 4 << 20  # texts of one Arrow batch


def _matching(spark: SparkSession, glob: str) -> list[str]:
    """The URIs that match a glob (as Hadoop reads it), if they are at most _NAMED and tasks can open them."""
    from pyarrow import fs as afs

    path = spark._jvm.org.apache.hadoop.fs.Path(glob)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    if not found or len(found) > _NAMED:
        return []
    uris = [re.sub("^file:/(?!/)", "file:///", x.getPath().toUri().toString()) for x in found]
    try:
        afs.FileSystem.from_uri(uris[0])
    except (ValueError, NotImplementedError, OSError):  # a store that only Spark reads
        return []
    return uris


def _whole_files(batches):
    """The files right below each path (or the path itself), hidden ones left out, with what Spark tells of a file."""
    import pyarrow as pa
    from pyarrow import fs as afs

    hidden = lambda name: name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")
    quoted = lambda path: re.sub("[\\x00-\\x20\\x7f\"#%<>?\\[\\\\\\]^`{|}]", lambda m: f"%{ord(m[0]):02X}", path)
    about = pa.struct([("file_path", pa.string()), ("file_name", pa.string()), ("file_size", pa.int64()), ("file_block_start", pa.int64()),
                       ("file_block_length", pa.int64()), ("file_modification_time", pa.timestamp("us", "UTC"))])
    values, files, size = [], [], 0
    for uri in (u for batch in batches for u in batch.column(0).to_pylist()):
        fs, base = afs.FileSystem.from_uri(uri)
        top = fs.get_file_info(base)
        listed = [top] if top.is_file else fs.get_file_info(afs.FileSelector(base, recursive=True))
        store = uri[:len(uri) - len(quoted(base))] if uri.endswith(quoted(base)) else ""
        for f in listed:
            *folders, name = [f.base_name] if f is top else f.path[len(base):].strip("/").split("/")
            if not f.is_file or hidden(name) or any("=" not in d or d.startswith(".") for d in folders):  # a table's own folders are key=value
                continue
            with fs.open_input_stream(f.path) as data:
                value = data.read()
            values.append(value)
            files.append({"file_path": store + quoted(f.path), "file_name": quoted(name), "file_size": f.size, "file_block_start": 0,
                          "file_block_length": f.size, "file_modification_time": f.mtime})
            size += len(value) + 256
            if size >= _READ_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary()), pa.array(files, about)], ["value", "_metadata"])
                values, files, size = [], [], 0
    if values:
        yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary()), pa.array(files, about)], ["value", "_metadata"])


def load_markdown(spark: SparkSession, glob: str, stem: Column | None = None) -> DataFrame:
    """S-10: one row per markdown file of the paths or folders that match: (stem, text). Name folders rather than files where
    there are many: the driver knows the folders alone, tasks list them and read their files. (Spark's own reader, which
    holds every file and its share of a task on the driver, is left for stores that only Spark opens.) Whole files, never
    split by line. The stem is the file's name without `.md`, or the given expression over the hidden column `_metadata`."""
    if stem is None:
        stem = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.md$", "")
    roots = _matching(spark, glob)
    if roots:
        paths = spark.createDataFrame(spark.sparkContext.parallelize([(u,) for u in roots], min(len(roots), 1024)), "path string")
        df = paths.mapInArrow(_whole_files, f"value binary, _metadata {_ABOUT_FILE}").withColumn("value", F.col("value").cast("string"))
    else:
        df = spark.read.text(glob, wholetext=True)
    return df.select(stem.alias("stem"), F.col("value").alias("text"))
