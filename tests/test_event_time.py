"""Streams in event time: disorder, late rows, state that goes; streaming ingest; the resumable cursor."""

import json
import random
import uuid

import pytest
from emberwatch.operators.tables import Cursor
from emberwatch.session import ensure_checkpoint_dir
from emberwatch.sources import events as E
from emberwatch.streaming import stream as ST
from pyspark.sql import types as T

DAY = 86_400_000


def folder(spark):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/test-{uuid.uuid4().hex}"


def run(spark, batches, schema, build):
    """Feeds one file per batch; returns rows, late rows and the last progress."""
    base = folder(spark)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{base}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{base}/in")
    out = build(stream)
    query = ST.run_available_now(out, f"{base}/out", f"{base}/ckpt", late_path=f"{base}/late")
    rows = spark.read.schema(ST.outputs(out).schema).parquet(f"{base}/out").drop("batch").collect()
    late = [json.loads(r.late) for r in spark.read.schema("late string").parquet(f"{base}/late").collect()]
    return rows, late, query.lastProgress


@pytest.fixture()
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_disorder_late_rows_and_state_of_suppression(spark, few_partitions):
    schema = "k string, ts long, id long"
    rng = random.Random(1)
    rows = [("a" if i % 3 else "b", 60_000 * i + 1, i) for i in range(60)]
    kept, last = [], {}
    for k, ts, i in rows:
        if ts >= last.get(k, 0):
            kept.append(i)
            last[k] = ts + 300_000
    slot = {r[2]: (r[1] // 60_000 + rng.randrange(10)) // 20 for r in rows}
    by_slice = [[r for r in rows if slot[r[2]] == n] for n in range(4)]
    for part in by_slice:
        rng.shuffle(part)
    late = [("a", 60_000, 900), ("b", 120_000, 901), ("c", None, 902)]  # far behind the watermark, or without a time
    got, behind, progress = run(spark, [*by_slice[:-1], by_slice[-1] + late, [(None, 10 * DAY, None)]], schema,
                                lambda s: ST.suppress_stream(s, keys=["k"], tie="id", ttl_s=300, delay="40 minutes"))
    assert sorted(r.id for r in got) == kept
    assert sorted(r["id"] for r in behind) == [900, 901, 902]
    assert progress["stateOperators"][0]["numRowsTotal"] == 0


def test_recovery_ends_by_timer_and_state_falls(spark, few_partitions):
    schema = "source_service string, metric_name string, kind string, ts long, event_id long, incident_id string, value double"
    rows = [("s", "m", "sample", 60_000 * i, i, None, 9.0 if i < 6 else 1.0) for i in range(1, 12)]
    rows += [("s", "m", "anomaly", 60_000 * 2, None, "calm", 1.0), ("s", "m", "anomaly", 60_000 * 9, None, "never", 500.0)]
    random.Random(2).shuffle(rows)
    got, late, progress = run(spark, [rows[:7], rows[7:], [(None, None, None, DAY, None, None, None)]], schema,
                              lambda s: ST.recovery_stream(s, idle_s=3600, delay="20 minutes"))
    assert {(r.incident_id, r.resolved_at, r.recovered) for r in got} == {("calm", 60_000 * 8, True), ("never", 60_000 * 39, False)}
    assert not late and progress["stateOperators"][0]["numRowsTotal"] == 0


def test_ingest_stores_each_event_once_over_a_crash(spark):
    base = folder(spark)
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])
    for lines in (['{"id": "a", "n": 1}', "junk"], ['{"id": "a", "n": 2}', '{"id": "b", "n": 3}'], ['{"id": "c", "n": 4}', '{"id": "c", "n": 5}', "{bad"]):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(f"{base}/in")

    def go(after=None):
        raw = E.read_events(spark, f"{base}/in", max_files_per_trigger=1)
        E.ingest_stream(raw, schema, f"{base}/t", f"{base}/r", f"{base}/c", keys=["id"], after_write=after).awaitTermination()

    def crash(number):
        if number == 1:
            raise RuntimeError("crash")

    with pytest.raises(Exception, match="crash"):
        go(crash)
    go()
    assert sorted((r.id, r.n) for r in spark.read.parquet(f"{base}/t").collect()) == [("a", 1), ("b", 3), ("c", 4)]
    assert sorted(r.raw for r in spark.read.parquet(f"{base}/r").collect()) == ["junk", "{bad"]


def test_cursor_resumes_between_equal_times(spark):
    rows = spark.createDataFrame([(i, 100 * (i // 4)) for i in range(13)], "id long, deployed_at long")
    path = folder(spark)
    seen = []
    for _ in range(10):
        cursor = Cursor(spark, path, start=(-1, -1))
        page = cursor.next_page(rows, limit=3)
        seen += [r.id for r in page.collect()]
        if not cursor.commit(page):
            break
    assert seen == list(range(13)) and Cursor(spark, path).number == 5
    again = Cursor(spark, path)
    assert again.next_page(rows).count() == 0 and not again.commit(rows.limit(0)) and again.number == 5


class _Value:
    def __init__(self):
        self.v = None

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.v = v

    put = update

    def clear(self):
        self.v = None


class _Map(dict):
    written = 0

    def keys(self):
        return iter(list(super().keys()))

    def containsKey(self, k):
        return k in self

    def getValue(self, k):
        return self[k]

    def updateValue(self, k, v):
        self.written += len(v[0])
        self[k] = v

    removeKey = dict.pop


class _Handle:
    def __init__(self):
        self.map, self.timers = _Map(), set()

    def getMapState(self, *_):
        return self.map

    def getValueState(self, *_):
        return _Value()

    getListState = getValueState

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class _Clock:
    def __init__(self, mark):
        self.mark = mark

    def getCurrentWatermarkInMs(self):
        return self.mark


def test_held_rows_are_written_once_and_folded_in_order(monkeypatch):
    import pandas as pd

    n, handle = 4000, _Handle()
    p = ST.SuppressProcessor(["ts", "id"], "ts", "id", 5000, None)
    p.keys = ["k"]
    p.init(handle)
    rows = [(1000 + 300 * i, i) for i in range(n)]  # two slots and the beginning of a third
    random.Random(3).shuffle(rows)
    monkeypatch.setattr(ST, "HELD_ROWS", 100, raising=False)
    for half in (rows[: n // 2], rows[n // 2:]):
        frames = [pd.DataFrame(half[i: i + 20], columns=["ts", "id"]) for i in range(0, len(half), 20)]
        assert not list(p.handleInputRows(("a",), iter(frames), _Clock(0)))
    assert handle.map.written < 3 * len(json.dumps(rows))  # a slot is not written again with each Arrow batch
    kept, end = [], 0
    for ts, i in sorted(rows):
        if ts >= end:
            kept.append(i)
            end = ts + 5000
    got = []
    for mark in (700_001, 10 * DAY):
        out = [x for f in p.handleExpiredTimer(("a",), _Clock(mark), None) for x in f["id"].tolist()]
        assert mark > DAY or max(out) * 300 + 1000 <= mark
        got += out
    assert got == kept and not handle.map and not p.parts.exists() and not p.lock.exists()
