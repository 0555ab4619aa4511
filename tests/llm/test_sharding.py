import zlib
from collections import Counter

from emberwatch.llm.sharding import Shard, place, place_among, shard_documents, topology
from pyspark.sql import functions as F


def test_edges(edge_docs, no_docs):
    rows = shard_documents(edge_docs, topology(8), topology(9), slot_buckets=3).collect()
    assert len(rows) == edge_docs.count()
    by = {r.doc_id: r for r in rows}
    assert (by[1].size, by[1].text_crc32) == (1, 0) and by[8].size == len("ümlaut çedille ñandú".encode()) + 1
    assert by[8].text_crc32 == zlib.crc32("ümlaut çedille ñandú".encode())
    for shard, n in Counter(r.shard for r in rows).items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))
    assert shard_documents(no_docs, topology(8)).count() == 0


def moves(spark, before, after, n=4000):
    k = F.col("id").cast("string")
    return [(r.a, r.b) for r in spark.range(n).select(place(k, before).alias("a"), place(k, after).alias("b")).collect()]


def test_one_more_shard_takes_rows_only_into_itself(spark):
    got = moves(spark, topology(8), topology(9))
    assert {b for a, b in got if a != b} == {8}
    assert 0.08 < sum(a != b for a, b in got) / len(got) < 0.15


def test_movement_stays_in_subtrees_whose_weight_changed(spark):
    """Raising one shard's weight moves keys only into its region (and inside it, only into its rack)."""
    before = [Shard(s // 4, s // 2, s, 1.0) for s in range(8)]
    after = [s._replace(weight=3.0) if s.shard == 0 else s for s in before]
    moved = [(a, b) for a, b in moves(spark, before, after) if a != b]
    assert moved
    for a, b in moved:
        assert b < 4                       # into the region that gained weight
        assert a >= 4 or b in (0, 1)       # within it, into the rack that gained weight
        assert a not in (0, 1) or b == 0   # within that rack, into the shard itself


def test_weights_are_followed(spark):
    shards = [Shard(0, 0, 0, 1.0), Shard(0, 0, 1, 2.0), Shard(1, 1, 2, 3.0)]
    n = Counter(a for a, _ in moves(spark, shards, shards, 12000))
    assert [round(n[s] / 12000 * 6, 1) for s in range(3)] == [1.0, 2.0, 3.0] or all(
        abs(n[s] / 12000 * 6 - w) < 0.2 for s, w in enumerate((1, 2, 3)))


def test_any_count_takes_rows_only_into_the_new_shard(spark):
    key = F.col("id").cast("string")
    rows = spark.range(1500).select(*[place_among(key, n).alias(f"s{n}") for n in (1, 2, 3, 5, 6, 7, 8, 9, 10, 11, 19, 20)],
                                    place(key, topology(9)).alias("nine")).collect()
    for r in rows:
        assert r.s1 == 0 and r.s9 == r.nine
        for n, m in ((1, 2), (2, 3), (5, 6), (6, 7), (7, 8), (8, 9), (9, 10), (10, 11), (19, 20)):
            before, after = r[f"s{n}"], r[f"s{m}"]
            assert before < n and (after == before or after == m - 1)
    for n in (2, 3, 7, 8, 9, 20):
        sizes = Counter(r[f"s{n}"] for r in rows)
        assert len(sizes) == n and max(sizes.values()) < 2.2 * 1500 / n


def test_rows_without_ids_are_numbered_in_many_buckets(spark):
    rows = spark.range(300).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    got = shard_documents(rows, topology(8)).collect()
    assert len({r.shard for r in got}) == 1 and sorted(r.slot for r in got) == list(range(300))
