import pytest

EDGE_TEXTS = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "Tied text here, twice."), (6, "Tied text here, twice."),
    (7, "word " * 30000), (None, "no id"), (8, "ümlaut çedille ñandú"), (9, "!!! ??? ###"),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and very long texts, ties, and columns whose names clash with outputs and internals."""
    rows = [(i, t, None, "s", 0, 7, "x", 1.5, -1) for i, t in EDGE_TEXTS] + [(5, EDGE_TEXTS[4][1], None, "s", 0, 7, "x", 1.5, -1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "shard int, key string, score double, length int")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


def table_dir(spark, path, **tables):
    """Write frames as the parquet tables of a directory."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)
