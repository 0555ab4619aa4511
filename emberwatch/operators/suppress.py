"""D-06 TTL suppression and C-01 incident lock: "keep a row if ts >= the lock end of the last kept row".

This is a sequential recurrence (it depends on the last *kept* row), so it is not a window function and
not `dropDuplicatesWithinWatermark`. To keep a hot key (say a third of all rows) from landing in one
task, the work is split exactly by time bucket (several times as wide as the longest lock):

A. per (key, bucket), in parallel: for every row, the lock end its kept-chain leaves at the bucket's end
   (pointer jumping over "next row at or after my lock end", vectorised with numpy). Only rows in the
   first lock-span of a bucket can be reached from an earlier bucket, so each bucket emits a compressed
   step function  entry lock end -> exit lock end.
B. step functions are composed up a tree, FAN consecutive buckets to a node: a composed function has at
   most one step more than its first bucket's, and far fewer once chains meet. The roots are folded in
   order, and the entry lock ends are handed back down, node by node. No task holds more than FAN functions
   of a key (or the key's few roots).
C. per (key, bucket), in parallel: join the entry back and run the forward fold from it.

Rows are shuffled once on (key, bucket) (the exchange is reused by A and C), sorted within partitions
(spills), and streamed through Arrow batches; memory per task is one bucket, never one key. Null keys are
keys like any other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOCK = "__lock_end"
_B = "__bucket"
_ENTRY = "__entry"
_NO_ENTRY = np.iinfo(np.int64).min
_KEY = "__key"
DEFAULT_BUCKET_S = 3600
SPANS = 8     # a bucket is at least so many lock spans wide, so at most about 1 / SPANS of its rows are steps
FAN = 64      # buckets of a tree node
LEVELS = 3    # levels of the tree: FAN ** LEVELS buckets to a root


def _segments(pdf: pd.DataFrame, cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Start/end offsets of runs of equal `cols` in a frame sorted by them."""
    n = len(pdf)
    change = np.ones(n, dtype=bool)
    if n > 1:
        same = np.ones(n - 1, dtype=bool)
        for c in cols:
            v = pdf[c].to_numpy()
            a, b = v[1:], v[:-1]
            same &= (a == b) | (pd.isna(a) & pd.isna(b))
        change[1:] = ~same
    starts = np.flatnonzero(change)
    return starts, np.append(starts[1:], n)


def _blocks(batches: Iterator[pd.DataFrame], cols: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Regroup a sorted batch stream into frames of whole segments (a segment may span Arrow batches;
    the unfinished last segment of a batch is carried into the next one)."""
    pending = None
    for pdf in batches:
        if len(pdf) == 0:
            continue
        if pending is not None:
            pdf = pd.concat([pending, pdf], ignore_index=True)
        starts, _ = _segments(pdf, cols)
        cut = int(starts[-1])
        if cut > 0:
            yield pdf.iloc[:cut].reset_index(drop=True)
        pending = pdf.iloc[cut:].reset_index(drop=True)
    if pending is not None and len(pending):
        yield pending


class _Layout:
    """Vectorised view of a block of whole segments: a global key that is monotone across segments,
    so one `searchsorted` answers "first row of my segment at or after t" for every row at once."""

    def __init__(self, blk: pd.DataFrame, cols: Sequence[str], ts: str, width: int, span: int):
        self.n = len(blk)
        starts, ends = _segments(blk, cols)
        self.rank = np.repeat(np.arange(len(starts), dtype=np.int64), ends - starts)
        self.seg_start = np.repeat(starts, ends - starts)
        self.seg_end = np.repeat(ends, ends - starts)
        self.starts, self.ends = starts, ends
        self.bstart = blk[_B].to_numpy(dtype=np.int64) * width
        self.stride = width + span + 2
        self.ts = blk[ts].to_numpy(dtype=np.int64)
        self.g = self.rank * self.stride + (self.ts - self.bstart)

    def first_at_or_after(self, t: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """For each row index in `rows`: first row of the same segment with ts >= t (clipped to the
        segment's offsets; the segment end means none)."""
        rel = np.clip(t - self.bstart[rows], 0, self.stride - 1)
        return np.searchsorted(self.g, self.rank[rows] * self.stride + rel, side="left")


def _phase_a(ts: str, width: int, span: int):
    seg_cols = [_KEY, _B]

    def run(batches):
        for blk in _blocks(batches, seg_cols):
            lay = _Layout(blk, seg_cols, ts, width, span)
            rows = np.arange(lay.n)
            lock = blk[_LOCK].to_numpy(dtype=np.int64)
            nxt = lay.first_at_or_after(lock, rows)
            last = np.where(nxt < lay.seg_end, nxt, rows)
            while True:  # pointer jumping: last row of each kept-chain
                jumped = last[last]
                if np.array_equal(jumped, last):
                    break
                last = jumped
            exits = lock[last]
            # candidates: rows in the first lock-span of their bucket, plus the first row after it
            hend = lay.first_at_or_after(lay.bstart[lay.starts] + span, lay.starts)
            hlast = np.minimum(hend, lay.ends - 1)
            is_cand = rows <= np.repeat(hlast, lay.ends - lay.starts)
            # keep the last candidate of each run of equal exits within a segment
            nxt_same = np.append((exits[1:] == exits[:-1]) & is_cand[1:] & (lay.rank[1:] == lay.rank[:-1]), False)
            keep = is_cand & ~nxt_same
            idx = np.flatnonzero(keep)
            out = pd.DataFrame({c: blk[c].to_numpy()[idx] for c in seg_cols})
            out["cand_ts"] = lay.ts[idx]
            out["cand_exit"] = exits[idx]
            yield out
    return run


def _functions(pdf: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The step functions of a frame in bucket order: (bucket, step positions, exits)."""
    pdf = pdf.sort_values([_B, "cand_ts"], kind="stable")
    b, at, out = (pdf[c].to_numpy(dtype=np.int64) for c in (_B, "cand_ts", "cand_exit"))
    starts = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else []
    for s0, e0 in zip(starts, np.append(starts[1:], len(b)), strict=True):
        yield int(b[s0]), at[s0:e0], out[s0:e0]


def _passed(exits: np.ndarray, at: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Where the step function (at, out) takes these lock ends; behind its last step they stay."""
    i = np.searchsorted(at, exits, side="left")
    return np.where(i < len(at), out[np.minimum(i, len(at) - 1)], exits)


def _compose(pdf: pd.DataFrame) -> pd.DataFrame:
    """One step function for consecutive buckets of a key. An entry that passes by all of the first bucket's steps
    (it never reaches beyond the next bucket's start) meets the next bucket's first one."""
    steps = exits = None
    for n, (_, at, out) in enumerate(_functions(pdf)):
        if n == 0:
            steps, exits = at, out
            continue
        exits = _passed(exits, at, out)
        if n == 1:
            steps, exits = np.append(steps, at[0]), np.append(exits, out[0])
    keep = np.append(exits[1:] != exits[:-1], True)
    out = pd.DataFrame({"cand_ts": steps[keep], "cand_exit": exits[keep]})
    out[_B] = pdf["__node"].iloc[0]
    out[_KEY] = pdf[_KEY].iloc[0]
    return out[[_KEY, _B, "cand_ts", "cand_exit"]]


def _fold(pdf: pd.DataFrame, entry: int) -> pd.DataFrame:
    """The entry lock end of every bucket of a frame, from the entry of its first one."""
    buckets, entries = [], []
    for bucket, at, out in _functions(pdf):
        buckets.append(bucket)
        entries.append(entry)
        entry = int(_passed(np.array([entry]), at, out)[0])
    return pd.DataFrame({_KEY: pdf[_KEY].iloc[0] if len(pdf) else None, _B: buckets, _ENTRY: entries})


def _entries(steps: DataFrame, levels: int = LEVELS, fan: int = FAN) -> DataFrame:
    """Phase B: step functions of all buckets -> the entry lock end of each bucket."""
    kind = f"{_KEY} string, {_B} long, cand_ts long, cand_exit long"
    e_kind = f"{_KEY} string, {_B} long, {_ENTRY} long"
    node = F.floor(F.col(_B) / F.lit(fan)).cast("long")
    tree = [steps]
    for _ in range(levels):
        tree.append(tree[-1].withColumn("__node", node).groupBy(_KEY, "__node").applyInPandas(_compose, kind))
    out = tree.pop().groupBy(_KEY).applyInPandas(lambda pdf: _fold(pdf, _NO_ENTRY), e_kind)
    for level in reversed(tree):
        below = level.withColumn("__node", node)
        out = below.groupBy(_KEY, "__node").cogroup(out.withColumnRenamed(_B, "__node").groupBy(_KEY, "__node")).applyInPandas(
            lambda f, e: _fold(f, int(e[_ENTRY].iloc[0])), e_kind)
    return out


def _phase_c(ts: str, width: int, span: int, out_cols: Sequence[str]):
    seg_cols = [_KEY, _B]

    def run(batches):
        for blk in _blocks(batches, seg_cols):
            lay = _Layout(blk, seg_cols, ts, width, span)
            lock = blk[_LOCK].to_numpy(dtype=np.int64)
            entry = blk[_ENTRY].to_numpy(dtype=np.int64)[lay.starts]
            start_t = np.where(entry == _NO_ENTRY, lay.bstart[lay.starts], entry)
            cur = lay.first_at_or_after(start_t, lay.starts)
            cur = cur[cur < lay.ends]
            keep = np.zeros(lay.n, dtype=bool)
            while len(cur):  # one step per kept row of the longest chain (<= width / ttl + 1)
                keep[cur] = True
                nxt = lay.first_at_or_after(lock[cur], cur)
                cur = nxt[nxt < lay.seg_end[cur]]
            out = blk[keep]
            if len(out):
                yield out[list(out_cols)]
    return run


def suppress(df: DataFrame, *, keys: Sequence[str], ts: str = "ts", tie: str | None = None,
             ttl_s: float = 300, until: str | None = None, bucket_s: float = DEFAULT_BUCKET_S) -> DataFrame:
    """D-06: keep a row when ts >= the lock end of the last kept row of its key; lock end = ts + ttl,
    or the `until` column when given (C-01 passes min(ts + ttl, release time), which never exceeds
    ts + ttl). Suppressed rows do not extend the lock. Order is (ts, tie). `bucket_s` sets the time
    bucket that splits a key across tasks (raised to SPANS lock spans when smaller). With ttl 0 every row stays."""
    ttl_ms = int(ttl_s * 1000)
    if ttl_ms <= 0:  # nothing ever locks
        return df
    span = ttl_ms
    width = max(SPANS * span, int(bucket_s * 1000))
    lock = F.col(until) if until else (F.col(ts) + F.lit(ttl_ms))
    lock = F.least(F.greatest(lock.cast("long"), F.col(ts) + F.lit(1)), F.col(ts) + F.lit(span))
    order = [ts] + ([tie] if tie else [])
    seg = [_KEY, _B]
    staged = (df.withColumn(_LOCK, lock).withColumn(_KEY, F.to_json(F.struct(*keys)))  # null keys are left out of it
                .withColumn(_B, F.floor(F.col(ts) / F.lit(width)).cast("long"))
                .repartition(*seg).sortWithinPartitions(*seg, *order))

    # phase A reads the staged rows unpruned, so its shuffle is the same plan as phase C's and is reused
    summaries = staged.mapInPandas(_phase_a(ts, width, span), schema=f"{_KEY} string, {_B} long, cand_ts long, cand_exit long")
    joined = staged.join(_entries(summaries), seg, "left").sortWithinPartitions(*seg, *order)
    joined = joined.withColumn(_ENTRY, F.coalesce(F.col(_ENTRY), F.lit(int(_NO_ENTRY))))
    return joined.mapInPandas(_phase_c(ts, width, span, df.columns), schema=df.schema)


def suppress_sql(source: str, *, keys: Sequence[str], ts: str = "ts", tie: str | None = None,
                 ttl_ms: int, until: str | None = None, select: str = "*") -> str:
    """DuckDB twin of `suppress`: a recursive CTE stepping row by row through each key."""
    order = ts + (f", {tie}" if tie else "")
    klist = ", ".join(keys)
    kjoin = " AND ".join(f"s.{k} IS NOT DISTINCT FROM r.{k}" for k in keys)
    lock = f"greatest(({until})::BIGINT, {ts} + 1)" if until else f"{ts} + {ttl_ms}"
    slock = f"greatest((s.{until})::BIGINT, s.{ts} + 1)" if until else f"s.{ts} + {ttl_ms}"
    return f"""(WITH RECURSIVE sx AS (
        SELECT *, row_number() OVER (PARTITION BY {klist} ORDER BY {order}) AS __rn, {lock} AS __lock
        FROM ({source})),
      rx AS (
        SELECT {klist}, __rn, __lock AS __held, true AS __kept FROM sx WHERE __rn = 1
        UNION ALL
        SELECT {", ".join("s." + k for k in keys)}, s.__rn,
               CASE WHEN s.{ts} >= r.__held THEN {slock} ELSE r.__held END,
               s.{ts} >= r.__held
        FROM rx r JOIN sx s ON {kjoin} AND s.__rn = r.__rn + 1)
      SELECT {select} FROM (SELECT sx.* EXCLUDE (__lock) FROM sx JOIN rx USING ({klist}, __rn) WHERE rx.__kept)
      )"""
