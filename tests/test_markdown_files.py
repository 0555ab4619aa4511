"""Markdown files are listed and read by tasks."""

from pyspark.sql import functions as F

from emberwatch.sources import events as E


def test_files_are_listed_and_read_by_tasks(spark, tmp_path):
    path = f"file://{tmp_path}/md"
    texts = {"a": "one\n\ntwo", "b c%": "käse\r\n", "d": ""}
    docs = spark.createDataFrame([*texts.items(), ("e", None), (None, "x")], "stem string, text string")
    assert E.write_markdown(docs, path, folders=3) == 5
    for hidden in (".f.md", "_g.md"):
        (next((tmp_path / "md").iterdir()) / hidden).write_text("no")
    (next((tmp_path / "md").iterdir()) / "below").mkdir()
    (next((tmp_path / "md").iterdir()) / "below" / "h.md").write_text("no")
    got = E.load_markdown(spark, path + "/*")
    assert not got.inputFiles()  # the driver has no list of the files
    spark_reads = spark.read.text(path + "/*", wholetext=True).select(
        F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.md$", "").alias("stem"), F.col("value").alias("text"))
    assert got.schema == spark_reads.schema
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, spark_reads.collect())) and got.count() == 4  # a file without a stem has a hidden name
    own = F.concat("_metadata.file_name", F.lit(" "), F.col("_metadata.file_size"), F.lit(" "), F.date_format("_metadata.file_modification_time", "yyyy-MM-dd HH:mm:ss"))
    mine = E.load_markdown(spark, path + "/*", stem=own).collect()
    theirs = spark.read.text(path + "/*", wholetext=True).select(own.alias("stem"), F.col("value").alias("text")).collect()
    assert sorted(r.stem for r in mine) == sorted(r.stem for r in theirs)
    one = E.load_markdown(spark, f"{tmp_path}/md/*/a.md").collect()
    assert [tuple(r) for r in one] == [("a", "one\n\ntwo\n")]
