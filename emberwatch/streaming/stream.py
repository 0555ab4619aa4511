"""Structured Streaming operators in event time: D-14 detection, D-06 suppression, D-10 log bursts, F-04 recovery and the
C-01 incident lock, each a keyed `transformWithStateInPandas` processor, and the chain of them (metrics in, incidents out).

Rows may arrive in any order within the watermark's delay. A first operator of a chain (`source`) holds a key's rows in
state, in a map by time slot to which each batch adds parts, and folds them in (time, tie) order when the watermark passes
them. Rows that come behind
the watermark are never folded: they leave through the operator's second output. Every operator therefore returns tagged
rows, `tag` ('out' or 'late'), `event_time` (carries the watermark on to a next operator), `late` (the late row as JSON)
and its own columns; `outputs` and `late_rows` split them, `run_available_now` splits each batch into two tables.

State is dropped by event-time timers: a series' values and lock when the gap and the lock lie behind the watermark, an
open incident at its limit, a lock at its end. It lives in the RocksDB state store and is checkpointed, so a restarted
query resumes without folding a row twice.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from emberwatch import constants as K

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SLOT_MS = 600_000  # width of a slot of held rows
HELD_ROWS = 50_000  # of a key's rows, so many are gathered before they are put into the state, or folded at once
TASKS_A_CORE = 4  # state partitions at most: each opens its own store in every batch, however few keys it has
DELAY = "10 minutes"

TAGS = [T.StructField("tag", T.StringType()), T.StructField("event_time", T.TimestampType()), T.StructField("late", T.StringType())]

ANOMALY_SCHEMA = T.StructType([
    T.StructField("incident_id", T.StringType()),
    T.StructField("anomaly_type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("source_service", T.StringType()),
    T.StructField("affected_services", T.ArrayType(T.StringType())),
    T.StructField("detection_time", T.LongType()),
    T.StructField("trigger_metric", T.StringType()),
    T.StructField("observed_value", T.DoubleType()),
    T.StructField("baseline_value", T.DoubleType()),
    T.StructField("deviation_sigma", T.DoubleType()),
    T.StructField("anomaly_score", T.DoubleType()),
    T.StructField("p50_value", T.DoubleType()),
    T.StructField("p95_value", T.DoubleType()),
    T.StructField("p99_value", T.DoubleType()),
    T.StructField("window_start", T.LongType()),
    T.StructField("window_end", T.LongType()),
    T.StructField("description", T.StringType()),
])

_TYPES = {m: t for m, t, _ in K.MONITORED_METRICS}
_SEV = {m: (c, h) for m, c, h in K.SEVERITY_THRESHOLDS}


def use_rocksdb(spark: SparkSession) -> None:
    """transformWithState needs the RocksDB state store; set it only when the session has none."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(key, None) != ROCKSDB:
        spark.conf.set(key, ROCKSDB)


def _severity(metric: str, z: float) -> str:
    crit, high = _SEV.get(metric, (K.DEFAULT_CRITICAL_SIGMA, K.DEFAULT_HIGH_SIGMA))
    return "CRITICAL" if z >= crit else "HIGH" if z >= high else "MEDIUM"


def _java_round1(z: float) -> float:
    return math.floor(z * 10 + 0.5) / 10


def _plain(v):
    """A cell as JSON holds it: None for missing values."""
    if v is None or (isinstance(v, float) and v != v) or v is pd.NaT or v is pd.NA:
        return None
    return v.item() if hasattr(v, "item") else v


def _cells(column: pd.Series) -> list:
    if column.dtype.kind in "iufb" and not column.hasnans:
        return column.tolist()
    return [_plain(v) for v in column.tolist()]


class InOrder(StatefulProcessor):
    """A fold over each key's rows in event-time order. Subclasses give `fold(key, rows)` (rows: lists of the columns, in
    order; returns output rows as (event time in ms, *columns)), `expire(key, mark)` (output rows that fall due) and
    `due(mark)` (when `expire` is next needed, or None). `source`: rows come from outside and may be late."""

    def __init__(self, columns: Sequence[str], order: Sequence[str], body: Sequence[str], source: bool, ts: str = "ts", slot_ms: int = SLOT_MS):
        self.columns, self.order, self.body, self.source, self.ts, self.slot_ms = list(columns), list(order), list(body), source, ts, slot_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "slot long, part long", "rows string")  # rows of a slot of time, as JSON
        self.parts = handle.getValueState("parts", "n long")  # parts are added to a slot, what it holds is not written again
        self.timer = handle.getValueState("timer", "at long")
        self.states(handle)

    def _tagged(self, tag: str, rows: list, late: list | None = None) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["event_time", *self.body], dtype=object)
        out["event_time"] = pd.to_datetime(out["event_time"].astype("int64"), unit="ms", utc=True)
        out.insert(0, "tag", tag)
        out.insert(2, "late", late if late is not None else [None] * len(out))
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        first, held, n, at = None, {}, 0, self.columns.index(self.ts)
        for pdf in rows:  # one Arrow batch at a time
            late: list[str] = []
            if not self.source:
                is_late = pdf["tag"] == "late"
                late = pdf.loc[is_late, "late"].tolist()
                pdf = pdf[~is_late]
            for row in zip(*[_cells(pdf[c]) for c in self.columns], strict=True):
                ts = row[at]
                if self.source and (ts is None or ts <= mark):
                    late.append(json.dumps(dict(zip(self.columns, row, strict=True))))
                    continue
                held.setdefault(int(ts) // self.slot_ms, []).append(row)
                n += 1
                first = ts if first is None else min(first, ts)
            if n >= HELD_ROWS:
                self._hold(held)
                held, n = {}, 0
            if late:  # behind the watermark: the next operator must not take them for late again, so their time is now
                own = dict(zip(self.keys, key, strict=True))
                yield self._tagged("late", [(max(mark, 0) + 1, *[own.get(c) for c in self.body])] * len(late), late)
        if held:
            self._hold(held)
        if first is not None:
            self._wake(int(first))

    def _hold(self, held: dict[int, list]) -> None:
        """Add rows to their slots, as a part of their own."""
        part = self.parts.get()[0] + 1 if self.parts.exists() else 0
        for slot, rows in held.items():
            self.slots.updateValue((slot, part), (json.dumps(rows),))
        self.parts.update((part,))

    def _wake(self, at: int) -> None:
        """One timer a key, at the earliest time that anything is due."""
        set_for = self.timer.get()[0] if self.timer.exists() else None
        if set_for is None or at < set_for:
            if set_for is not None:
                self.handle.deleteTimer(set_for)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        at, keys = self.columns.index(self.ts), [self.columns.index(c) for c in self.order]
        left, ready, slots = None, [], {}
        for slot, part in self.slots.keys():
            slots.setdefault(slot, []).append(part)
        for slot in sorted(slots):
            if slot * self.slot_ms > mark:
                left = slot * self.slot_ms if left is None else left
                break
            parts = sorted(slots.pop(slot))
            rows = [r for part in parts for r in json.loads(self.slots.getValue((slot, part))[0])]
            later = [r for r in rows if r[at] > mark] if (slot + 1) * self.slot_ms > mark else []
            for part in parts:
                self.slots.removeKey((slot, part))
            if later:
                rows = [r for r in rows if r[at] <= mark]
                self.slots.updateValue((slot, parts[0]), (json.dumps(later),))
                left = min(r[at] for r in later)
            ready += self._sorted(rows, keys)
            if len(ready) >= HELD_ROWS:
                yield from self._folded(key, ready)
                ready = []
        if ready:
            yield from self._folded(key, ready)
        if left is None:
            self.parts.clear()
        out = self.expire(key, mark)
        if out:
            yield self._tagged("out", out)
        wake = [t for t in (left, self.due(mark)) if t is not None]
        if wake:
            self._wake(max(int(min(wake)), mark + 1))

    @staticmethod
    def _sorted(rows: list, keys: list[int]) -> list:
        try:
            return sorted(rows, key=itemgetter(*keys))
        except TypeError:  # missing values are first
            return sorted(rows, key=lambda r: [(r[i] is not None, r[i]) if r[i] is not None else (False, 0) for i in keys])

    def _folded(self, key, rows: list) -> Iterator[pd.DataFrame]:
        out = self.fold(key, rows)
        if out:
            yield self._tagged("out", out)

    def close(self) -> None:
        pass


def _run(df: DataFrame, keys: Sequence[str], processor: InOrder, body: Sequence[T.StructField], delay: str | None) -> DataFrame:
    """`delay`: the watermark of a source's rows (their `ts` in ms); None for the output of another operator."""
    use_rocksdb(df.sparkSession)
    processor.keys = list(keys)
    if delay is not None:
        # a row of nothing but a time moves the clock (an idle source's heartbeat) and is no input. The condition names
        # the watermark column, so it stays above the watermark; that column itself is dropped, or Spark would drop late
        # rows before the operator
        others = [F.col(c).isNotNull() for c in df.columns if c != processor.ts]
        df = df.withColumn("__et", F.timestamp_millis(F.col(processor.ts))).withWatermark("__et", delay)
        df = df.where(reduce(lambda a, b: a | b, others) | F.col("__et").isNull()).drop("__et")
    return df.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=T.StructType([*TAGS, *body]), outputMode="Append",
        timeMode="EventTime", eventTimeColumnName="event_time")


def outputs(df: DataFrame) -> DataFrame:
    return df.where("tag = 'out'").drop("tag", "event_time", "late")


def late_rows(df: DataFrame) -> DataFrame:
    return df.where("tag = 'late'").select("late")


class DetectProcessor(InOrder):
    """D-14: per (service, metric): the last `size` values of the current segment, the last timestamp and the dedup lock
    end. Same rules as D-13 (segments, baseline over the previous values, z, spike filter, TTL suppression, severity,
    percentiles). With `samples`, the samples themselves go on as well, as SERIES rows."""

    def __init__(self, gap_s: float, ttl_s: float, sigma: float, size: int, min_samples: int, samples: bool = False):
        body = SERIES_SCHEMA if samples else ANOMALY_SCHEMA
        super().__init__(["event_id", "metric_value", "ts"], ["ts", "event_id"], body.fieldNames(), source=True)
        self.gap_ms, self.ttl_ms = int(gap_s * 1000), int(ttl_s * 1000)
        self.sigma, self.size, self.min_samples, self.samples = sigma, size, min_samples, samples

    def states(self, handle):
        self.hist = handle.getListState("hist", "value double")
        self.meta = handle.getValueState("meta", "last_ts long, lock_end long")

    def fold(self, key, rows):
        service, metric = key
        hist = [r[0] for r in self.hist.get()] if self.hist.exists() else []
        last_ts, lock_end = self.meta.get() if self.meta.exists() else (None, None)
        out = []
        monitored = metric in _TYPES
        for event_id, value, ts in rows:
            if last_ts is not None and ts - last_ts >= self.gap_ms:
                hist = []
            prior = hist[-(self.size - 1):] if self.size > 1 else []
            n = len(prior)
            z = 0.0
            mean = sum(prior) / n if n else None
            if n >= self.min_samples:
                var = sum([(v - mean) ** 2 for v in prior]) / n
                std = math.sqrt(var) if var > 0 else 0.0
                z = 0.0 if std < 1e-9 else (value - mean) / std
            if self.samples:
                out.append((ts, service, metric, "sample", ts, event_id, None, value))
            if monitored and z >= self.sigma and (lock_end is None or ts >= lock_end):
                lock_end = ts + self.ttl_ms
                ident = hashlib.sha256(f"{service}:{metric}:{ts}".encode()).hexdigest()[:32]
                if self.samples:
                    out.append((ts, service, metric, "anomaly", ts, None, ident, mean))
                else:
                    win = sorted(prior + [value])
                    pct = [win[min(int(len(win) * p / 100), len(win) - 1)] for p in (50, 95, 99)]
                    out.append((ts, ident, _TYPES[metric], _severity(metric, z), service, [service], ts, metric, value, mean,
                                z, min(1.0, z / 10.0), pct[0], pct[1], pct[2], ts - K.BASELINE_WINDOW * 10 * 1000, ts,
                                f"{metric} deviation: {_java_round1(z):.1f}σ above baseline"))
            hist = (hist + [value])[-self.size:]
            last_ts = ts
        if rows:
            self.hist.put([(float(v),) for v in hist])
            self.meta.update((last_ts, lock_end))
        return out

    def _end(self):
        if not self.meta.exists():
            return None
        last_ts, lock_end = self.meta.get()
        return max(last_ts + self.gap_ms, lock_end or 0)

    def expire(self, key, mark):
        end = self._end()
        if end is not None and end <= mark:  # a later row starts a new segment and finds no lock
            self.hist.clear()
            self.meta.clear()
        return []

    def due(self, mark):
        return self._end()


def detect_stream(metrics: DataFrame, *, gap_s: float = K.BASELINE_GAP_S, ttl_s: float = K.DEDUP_TTL_S,
                  sigma: float = K.SIGMA_THRESHOLD, size: int = K.BASELINE_WINDOW, min_samples: int = K.MIN_SAMPLES,
                  delay: str = DELAY) -> DataFrame:
    """D-14: metrics stream (event_id, source_service, metric_name, metric_value, ts) -> tagged anomalies."""
    src = metrics.select("event_id", "source_service", "metric_name", "metric_value", "ts")
    return _run(src, ["source_service", "metric_name"], DetectProcessor(gap_s, ttl_s, sigma, size, min_samples), ANOMALY_SCHEMA, delay)


class SuppressProcessor(InOrder):
    """Streaming D-06: state = lock end of the last kept row."""

    def __init__(self, columns: Sequence[str], ts: str, tie: str | None, ttl_ms: int, until: str | None):
        super().__init__(columns, [ts] + ([tie] if tie else []), columns, source=True, ts=ts)
        self.ttl_ms, self.until = ttl_ms, until

    def states(self, handle):
        self.lock = handle.getValueState("lock", "lock_end long")

    def fold(self, key, rows):
        lock_end = self.lock.get()[0] if self.lock.exists() else None
        at, end = self.columns.index(self.ts), self.columns.index(self.until) if self.until else None
        out = []
        for row in rows:
            ts = row[at]
            if lock_end is None or ts >= lock_end:
                out.append((ts, *row))
                lock_end = max(int(row[end]) if self.until else ts + self.ttl_ms, ts + 1)
        if lock_end is not None:
            self.lock.update((lock_end,))
        return out

    def expire(self, key, mark):
        if self.lock.exists() and self.lock.get()[0] <= mark:
            self.lock.clear()
        return []

    def due(self, mark):
        return self.lock.get()[0] if self.lock.exists() else None


def suppress_stream(df: DataFrame, *, keys: Sequence[str], ts: str = "ts", tie: str | None = None,
                    ttl_s: float = K.DEDUP_TTL_S, until: str | None = None, delay: str = DELAY) -> DataFrame:
    """Streaming D-06 (and C-01 when `until` carries min(ts + lock, release time)): tagged rows of df's columns."""
    return _run(df, keys, SuppressProcessor(df.columns, ts, tie, int(ttl_s * 1000), until), df.schema, delay)


BURST_SCHEMA = T.StructType([
    T.StructField("source_service", T.StringType()),
    T.StructField("detection_time", T.LongType()),
    T.StructField("severity", T.StringType()),
    T.StructField("error_count", T.LongType()),
    T.StructField("description", T.StringType()),
])


class BurstProcessor(InOrder):
    """Streaming D-10: per service, the running error count (restarts after a silence of >= gap_s), the last error time
    and the dedup lock end."""

    def __init__(self, gap_ms: int, n: int, ttl_ms: int):
        super().__init__(["event_id", "level", "message", "ts"], ["ts", "event_id"], BURST_SCHEMA.fieldNames(), source=True)
        self.gap_ms, self.n, self.ttl_ms = gap_ms, n, ttl_ms

    def states(self, handle):
        self.st = handle.getValueState("st", "count long, last_ts long, lock_end long")

    def fold(self, key, rows):
        (service,) = key
        count, last_ts, lock_end = self.st.get() if self.st.exists() else (0, None, None)
        out = []
        for _, level, msg, ts in rows:
            if level not in ("ERROR", "FATAL"):
                continue
            count = 1 if last_ts is None or ts - last_ts >= self.gap_ms else count + 1
            last_ts = ts
            if count >= self.n and (lock_end is None or ts >= lock_end):
                lock_end = ts + self.ttl_ms
                out.append((ts, service, ts, "HIGH" if level == "ERROR" else "CRITICAL", count,
                            f"Log error burst detected: {count} errors in 60s. Latest: {msg[:100]}"))
        if last_ts is not None:
            self.st.update((count, last_ts, lock_end))
        return out

    def _end(self):
        if not self.st.exists():
            return None
        _, last_ts, lock_end = self.st.get()
        return max(last_ts + self.gap_ms, lock_end or 0)

    def expire(self, key, mark):
        end = self._end()
        if end is not None and end <= mark:
            self.st.clear()
        return []

    def due(self, mark):
        return self._end()


def log_bursts_stream(logs: DataFrame, *, gap_s: float = K.BURST_GAP_S, n: int = K.BURST_COUNT,
                      ttl_s: float = K.DEDUP_TTL_S, delay: str = DELAY) -> DataFrame:
    src = logs.select("event_id", "source_service", "level", "message", "ts")
    return _run(src, ["source_service"], BurstProcessor(int(gap_s * 1000), n, int(ttl_s * 1000)), BURST_SCHEMA, delay)


#: What series operators hand on: samples, anomalies and resolutions.
SERIES_SCHEMA = T.StructType([
    T.StructField("source_service", T.StringType()),
    T.StructField("metric_name", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("ts", T.LongType()),
    T.StructField("event_id", T.LongType()),
    T.StructField("incident_id", T.StringType()),
    T.StructField("value", T.DoubleType()),
])

RECOVERY_SCHEMA = T.StructType([
    T.StructField("incident_id", T.StringType()),
    T.StructField("source_service", T.StringType()),
    T.StructField("trigger_metric", T.StringType()),
    T.StructField("detection_time", T.LongType()),
    T.StructField("resolved_at", T.LongType()),
    T.StructField("recovered", T.BooleanType()),
])

LIFE_SCHEMA = T.StructType([T.StructField("kind", T.StringType()), T.StructField("ts", T.LongType()), *RECOVERY_SCHEMA.fields])


class RecoveryProcessor(InOrder):
    """Streaming F-04: per series, the last n values and the open incidents. A sample after detection resolves an
    incident when the mean of the last n is within `tol` of its baseline; a timer at its limit resolves it by timeout.
    The n values of a silent series are kept, or dropped after `idle_s` of silence. With `life`, anomalies go on too
    (kind 'anomaly' and 'resolved')."""

    def __init__(self, n: int, tol: float, limit_ms: int, source: bool, life: bool, idle_s: float | None):
        super().__init__(["kind", "ts", "event_id", "incident_id", "value"], ["ts", "event_id"],
                         (LIFE_SCHEMA if life else RECOVERY_SCHEMA).fieldNames(), source=source)
        self.n, self.tol, self.limit_ms, self.life, self.idle_ms = n, tol, limit_ms, life, None if idle_s is None else int(idle_s * 1000)

    def states(self, handle):
        self.last = handle.getValueState("last", "values array<double>, at long")
        self.open = handle.getValueState("open", "ids array<string>, times array<long>, bases array<double>")

    def _done(self, key, i, det, at, recovered):
        row = (i, *key, det, at, recovered)
        return (at, "resolved", at, *row) if self.life else (at, *row)

    def fold(self, key, rows):
        values, at = (list(self.last.get()[0]), self.last.get()[1]) if self.last.exists() else ([], None)
        open_ = list(zip(*self.open.get(), strict=True)) if self.open.exists() else []
        out = []
        for kind, ts, _, iid, value in rows:
            if kind == "sample":
                values, at = [*values, value][-self.n:], ts
            mean = sum(values) / len(values) if values else 0.0
            still = []
            for i, det, base in open_:
                ref = mean if base is None or base != base or base == 0 else base
                if ts > det + self.limit_ms:
                    out.append(self._done(key, i, det, det + self.limit_ms, False))
                elif kind == "sample" and ts > det and len(values) >= self.n and ref > 0 and abs(mean - ref) / ref < self.tol:
                    out.append(self._done(key, i, det, ts, True))
                else:
                    still.append((i, det, base))
            open_ = still
            if kind == "anomaly":
                open_.append((iid, ts, float("nan") if value is None else value))
                if self.life:
                    out.append((ts, "anomaly", ts, iid, *key, ts, None, None))
        if rows:
            if values:
                self.last.update(([float(v) for v in values], at))
            self._keep(open_)
        return out

    def _keep(self, open_):
        if open_:
            self.open.update(tuple(list(c) for c in zip(*open_, strict=True)))
        elif self.open.exists():
            self.open.clear()

    def expire(self, key, mark):
        out = []
        if self.open.exists():
            open_ = list(zip(*self.open.get(), strict=True))
            over = [x for x in open_ if x[1] + self.limit_ms <= mark]
            if over:
                out = [self._done(key, i, det, det + self.limit_ms, False) for i, det, _ in over]
                self._keep([x for x in open_ if x[1] + self.limit_ms > mark])
        if self.idle_ms is not None and self.last.exists() and self.last.get()[1] + self.idle_ms <= mark and not self.open.exists():
            self.last.clear()
        return out

    def due(self, mark):
        ends = [t + self.limit_ms for t in self.open.get()[1]] if self.open.exists() else []
        if self.idle_ms is not None and self.last.exists():
            ends.append(self.last.get()[1] + self.idle_ms)
        return min(ends, default=None)


def recovery_stream(events: DataFrame, *, n: int = 3, tol: float = 0.30, limit_min: float = 30, idle_s: float | None = None,
                    delay: str | None = DELAY) -> DataFrame:
    """Streaming F-04 over (source_service, metric_name, kind in {sample, anomaly}, ts, event_id, incident_id, value: the
    sample's value or the anomaly's baseline): tagged resolutions. `delay` None: over another operator's output."""
    src = events.select(*(["tag", "event_time", "late"] if delay is None else []), *SERIES_SCHEMA.fieldNames())
    return _run(src, ["source_service", "metric_name"], RecoveryProcessor(n, tol, int(limit_min * 60_000), delay is not None, False, idle_s),
                RECOVERY_SCHEMA, delay)


class LockProcessor(InOrder):
    """Streaming C-01: per service, the open incident and its lock end. An anomaly is admitted when no lock is held at its
    time; it locks the service for `lock_ms`; the open incident's resolution releases the lock early, but not before the
    millisecond after its detection (as in the batch form). Rows are ordered by (ts, resolutions first, id). A timer at
    the lock's end drops the state. With `life`, the resolutions of admitted incidents go on too."""

    def __init__(self, lock_ms: int, source: bool, life: bool = False):
        self.life = life
        body = LIFE_SCHEMA if life else LOCK_SCHEMA
        super().__init__(["incident_id", "ts", "rank", *(RECOVERY_SCHEMA.fieldNames()[2:] if life else [])], ["ts", "rank", "incident_id"],
                         body.fieldNames(), source=source)
        self.lock_ms = lock_ms

    def states(self, handle):
        self.st = handle.getValueState("st", "open_id string, until long, opened long")
        self.waiting = handle.getValueState("waiting", "ids array<string>, times array<long>")  # admitted, not yet resolved

    def fold(self, key, rows):
        (service,) = key
        open_id, until, opened = self.st.get() if self.st.exists() else (None, None, None)
        waiting = dict(zip(*self.waiting.get(), strict=True)) if self.waiting.exists() else {}
        out, at_once = [], {}
        for iid, ts, rank, *facts in rows:
            if rank == 0:
                if iid in waiting:
                    del waiting[iid]
                    if iid == open_id:
                        until = max(min(until, ts), opened + 1)
                    if self.life:
                        out.append((ts, "resolved", ts, iid, service, *facts))
                else:
                    at_once[iid, ts] = facts
            elif until is None or ts >= until:
                open_id, opened, until = iid, ts, ts + self.lock_ms
                out.append((ts, "opened", ts, iid, service, facts[0], ts, None, None) if self.life else (ts, iid, service, ts))
                if (iid, ts) in at_once:  # resolved in the millisecond of its detection
                    until = min(until, ts + 1)
                    if self.life:
                        out.append((ts, "resolved", ts, iid, service, *at_once[iid, ts]))
                elif self.life:
                    waiting[iid] = ts
                else:
                    waiting = {iid: ts}
        if open_id is not None:
            self.st.update((open_id, until, opened))
        self._keep(waiting)
        return out

    def _keep(self, waiting):
        if waiting:
            self.waiting.update((list(waiting), list(waiting.values())))
        elif self.waiting.exists():
            self.waiting.clear()

    def expire(self, key, mark):
        if self.st.exists() and self.st.get()[1] <= mark:
            self.st.clear()
            if not self.life:  # only the open incident was waited for
                self._keep({})
        return []

    def due(self, mark):
        return self.st.get()[1] if self.st.exists() else None


LOCK_SCHEMA = T.StructType([
    T.StructField("incident_id", T.StringType()),
    T.StructField("source_service", T.StringType()),
    T.StructField("detection_time", T.LongType()),
])


def incident_lock_stream(events: DataFrame, *, lock_s: float = K.INCIDENT_LOCK_S, delay: str = DELAY) -> DataFrame:
    """Streaming C-01 over (incident_id, source_service, kind in {anomaly, resolved}, ts): tagged admitted incidents."""
    rank = F.when(F.col("kind") == "resolved", 0).otherwise(1)
    src = events.select("incident_id", "source_service", "ts", rank.alias("rank"))
    return _run(src, ["source_service"], LockProcessor(int(lock_s * 1000), source=True), LOCK_SCHEMA, delay)


def incidents_stream(metrics: DataFrame, *, gap_s: float = K.BASELINE_GAP_S, ttl_s: float = K.DEDUP_TTL_S,
                     sigma: float = K.SIGMA_THRESHOLD, size: int = K.BASELINE_WINDOW, min_samples: int = K.MIN_SAMPLES, n: int = 3,
                     tol: float = 0.30, limit_min: float = 30, lock_s: float = K.INCIDENT_LOCK_S, delay: str = DELAY) -> DataFrame:
    """D-14 -> F-04 -> C-01 in one query: metrics in; opened incidents and their resolutions (which release the lock) out,
    with the late metrics as tagged rows. Detection orders the samples by the watermark and hands samples and anomalies
    on; recovery resolves each anomaly; the lock takes both. The watermark goes through all three."""
    src = metrics.select("event_id", "source_service", "metric_name", "metric_value", "ts")
    series = ["source_service", "metric_name"]
    found = _run(src, series, DetectProcessor(gap_s, ttl_s, sigma, size, min_samples, samples=True), SERIES_SCHEMA, delay)
    life = _run(found, series, RecoveryProcessor(n, tol, int(limit_min * 60_000), False, True, None), LIFE_SCHEMA, None)
    ranked = life.withColumn("rank", F.when(F.col("kind") == "resolved", 0).otherwise(1))
    return _run(ranked, ["source_service"], LockProcessor(int(lock_s * 1000), source=False, life=True), LIFE_SCHEMA, None)


def run_available_now(df: DataFrame, path: str, checkpoint: str, *, late_path: str | None = None):
    """Run a tagged stream over everything available now: outputs into parquet files below `path`, late rows below
    `late_path`. Each batch owns a folder by its number, which a repeated batch overwrites, so a restarted query leaves
    every row once. Returns the finished query."""
    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        outputs(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if late_path:
            late_rows(batch).write.mode("overwrite").parquet(f"{late_path}/batch={number}")
        batch.unpersist()

    conf, key = df.sparkSession.conf, "spark.sql.shuffle.partitions"
    before = conf.get(key)
    conf.set(key, str(min(int(before), TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism)))
    try:  # a query keeps the number that it is started with; a restarted one that of its checkpoint
        query = (df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
                 .trigger(availableNow=True).start())
    finally:
        conf.set(key, before)
    query.awaitTermination()
    return query
