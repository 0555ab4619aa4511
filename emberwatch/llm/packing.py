"""Best-fit packing by a configuration linear program.

Documents become token pieces of at most `capacity`; only their length histogram (at most `capacity` numbers) comes to
the driver. There the configuration LP - fewest sequences, each a pattern of lengths that fits, covering the
histogram - is solved by multiplicative weights: a length's price falls as its coverage grows, a knapsack dynamic
program finds the pattern of the highest total price, and the pattern is raised until it has covered a fixed share of
its scarcest length. The fractional solution is rounded down, then up where the remaining pieces still fill a whole
pattern; what is left is packed best-fit decreasing, into the open room of rounded patterns' sequences first.

The plan is a list of patterns; its size depends on the capacity, not on the number of pieces. On Spark, pieces of
equal length are numbered without gaps (split over hash buckets, so a frequent length is no hot group) and each looks
up its sequence and offset by (length, number).
"""

from __future__ import annotations

import bisect
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberwatch.llm import tokens
from emberwatch.llm.common import fresh, numbered, slices, staged, table

CAPACITY = 2048
END = 0              # id that closes every document
SHARE = 0.25         # of its scarcest length's pieces that one step of a pattern covers
ETA = 1.0            # how fast a length's price falls with its coverage
GROUPS = 192         # lengths priced at once: the dearest of each length group
SLOT_BUCKETS = 256


class Plan(NamedTuple):
    """Sorted (length, first number) keys with the sequence and offset of each range of numbers."""
    length: np.ndarray
    number: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


def dearest_pattern(sizes: np.ndarray, prices: np.ndarray, limits: np.ndarray, capacity: int) -> dict[int, int]:
    """Knapsack: index -> copies of the highest total price within capacity, at most limits[i] copies each (bounded
    copies by binary splitting)."""
    items = []
    for i, (s, most) in enumerate(zip(sizes.tolist(), limits.tolist(), strict=True)):
        most, k = min(most, capacity // s), 1
        while most > 0:
            items.append((i, min(k, most)))
            most -= k
            k *= 2
    best = np.zeros(capacity + 1)
    taken = np.zeros((len(items), capacity + 1), bool)
    for j, (i, k) in enumerate(items):
        s = int(sizes[i]) * k
        other = best[:-s] + prices[i] * k
        take = other > best[s:] + 1e-12
        taken[j, s:] = take
        best[s:] = np.where(take, other, best[s:])
    room, out = int(best.argmax()), {}
    for j in range(len(items) - 1, -1, -1):
        if taken[j, room]:
            i, k = items[j]
            out[i] = out.get(i, 0) + k
            room -= int(sizes[i]) * k
    return out


def fractional(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], float]]:
    """Patterns (index -> copies) with fractional multiplicities that cover every count."""
    covered = np.zeros(len(sizes))
    group = sizes * GROUPS // (capacity + 1)
    out: dict[tuple, float] = {}
    while True:
        open_ = np.flatnonzero(covered < 1 - 1e-9)
        if not len(open_):
            return [(dict(p), x) for p, x in out.items()]
        price = sizes / capacity * np.exp(-ETA * covered)
        order = open_[np.lexsort((-price[open_] / sizes[open_], group[open_]))]
        _, first = np.unique(group[order], return_index=True)
        chosen = order[first]
        limit = np.ceil((1 - covered[chosen]) * counts[chosen]).astype(int)
        found = dearest_pattern(sizes[chosen], price[chosen], limit, capacity)
        pattern = {int(chosen[i]): k for i, k in sorted(found.items())}
        idx, copies = np.array(list(pattern)), np.array(list(pattern.values()))
        rest = (1 - covered[idx]) * counts[idx] / copies
        step = min(rest.min(), max(1.0, SHARE * (counts[idx] / copies).min()))
        covered[idx] += step * copies / counts[idx]
        key = tuple(pattern.items())
        out[key] = out.get(key, 0.0) + step


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns (lengths, longest first) with whole multiplicities that use up the histogram exactly."""
    sizes = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[s] for s in sizes.tolist()], np.int64)
    left = counts.copy()
    out: list[tuple[list[int], int]] = []
    solution = fractional(sizes, counts.astype(float), capacity) if len(sizes) else []
    times = []
    for pattern, x in solution:
        n = min([int(x + 1e-9), *[int(left[i]) // k for i, k in pattern.items()]])
        for i, k in pattern.items():
            left[i] -= n * k
        times.append(n)
    for p in sorted(range(len(solution)), key=lambda p: (times[p] - solution[p][1], p)):
        pattern = solution[p][0]
        if solution[p][1] > times[p] + 1e-6 and all(left[i] >= k for i, k in pattern.items()):
            for i, k in pattern.items():
                left[i] -= k
            times[p] += 1
    # open room of rounded sequences: one sequence of a pattern may be taken out and filled further
    whole = [[[int(sizes[i]) for i in sorted(pattern, reverse=True) for _ in range(pattern[i])], n]
             for (pattern, _), n in zip(solution, times, strict=True) if n]
    rooms = sorted((capacity - sum(items), at) for at, (items, _) in enumerate(whole) if sum(items) < capacity)
    bins: list[list[int]] = []
    for i in range(len(sizes) - 1, -1, -1):
        s = int(sizes[i])
        for _ in range(int(left[i])):
            j = bisect.bisect_left(rooms, (s, -1 << 60))
            if j == len(rooms):
                bins.append([s])
                room, at = capacity - s, -len(bins)
            else:
                room, at = rooms.pop(j)
                room -= s
                if at >= 0:                          # a sequence of a pattern becomes a bin of its own
                    items, n = whole[at]
                    if n > 1:
                        bisect.insort(rooms, (room + s, at))
                    whole[at][1] -= 1
                    bins.append([*items, s])
                    at = -len(bins)
                else:
                    bins[-at - 1].append(s)
            if room:
                bisect.insort(rooms, (room, at))
    out = [(items, n) for items, n in whole if n]
    return out + [(items, 1) for items in bins]


def plan_of(patterns: list[tuple[list[int], int]]) -> Plan:
    rows, following, base = [], {}, 0
    for items, n in patterns:
        offset = 0
        for s in items:
            k = following.get(s, 0)
            rows.append((s, k, base, offset))
            following[s] = k + n
            offset += s
        base += n
    cols = np.array(sorted(rows), np.int64).reshape(-1, 4).T
    return Plan(*(c.copy() for c in cols), base)


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, paths: tuple[str, str] | None = None,
                 with_ids: bool = True) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A document is the ids of its whole text and then `end`; only a longer one than `capacity` is cut, into full pieces
    behind a first one that may be shorter. A null or empty text is the one id `end`; repeated rows give their pieces
    again; other columns are ignored."""
    paths = paths or tokens.default_paths()
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()),
              T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))

    def rows(batches):
        from emberwatch.llm.tokens import encode

        for batch in (part for whole in batches for part in slices(whole, 1)):
            out: list[list] = [[] for _ in fields]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or "", paths), np.uint32(end)).astype("<u4")
                head = len(ids) % capacity or capacity
                cuts = [0, *range(head, len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    values = (doc, piece, a, b - a, zlib.crc32(ids[a:b].tobytes()), *([ids[a:b].tolist()] if with_ids else []))
                    for col, v in zip(out, values, strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(col, t) for col, t in zip(out, [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(),
                                                          pa.list_(pa.int64())], strict=False)], [f.name for f in fields])

    return docs.select("doc_id", "text").mapInArrow(rows, T.StructType(fields))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (any columns; doc_id, piece and length are used, length 1 to capacity).

    Every row gets a place of its own, repeated ones too; an empty table gives no rows."""
    pieces = staged(pieces, "pieces")
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    if histogram and not 0 < min(histogram) <= max(histogram) <= capacity:
        raise ValueError("piece lengths must lie between 1 and the capacity")
    plan = plan_of(solve(histogram, capacity))
    span = max(histogram.values(), default=0) + 1
    keys, sequence, first, offset = plan.length * span + plan.number, plan.sequence, plan.number, plan.offset
    order = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in pieces.columns]
    bucket = F.pmod(F.xxhash64(*order), F.lit(SLOT_BUCKETS)).cast("int")  # with the ids' crc, so rows of one id are spread
    number_of = fresh("_number", pieces.columns)
    ranked = numbered(pieces, ["length"], bucket, order, number_of)
    schema = T.StructType([f for f in ranked.schema if f.name != number_of]
                          + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    at_length, at_number = ranked.columns.index("length"), ranked.columns.index(number_of)

    def rows(batches):
        for batch in batches:
            length = batch.column(at_length).to_numpy(zero_copy_only=False).astype(np.int64)
            number = batch.column(at_number).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(keys, length * span + number, side="right") - 1
            cols = [c for i, c in enumerate(batch.columns) if i != at_number]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence[at] + number - first[at]), pa.array(offset[at])],
                                             schema.names)

    return ranked.mapInArrow(rows, schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(table(spark, sf_dir, "documents"), with_ids=False)
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
