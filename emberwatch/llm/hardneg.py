"""Hard-negative mining by exact inner-product search in an inverted multi-index.

The vectors are cut into two halves. Each half has a codebook (k-means on a bounded sample); a row's pair of nearest
codes is its cell, and every row of the table is stored under its cell. The inner product of an anchor with any row of
cell (i, j) is at most the sum of two half scores: anchor half times code, plus the length of the anchor's half times
the code's radius (the largest distance of any row from the code, over the whole table). An anchor visits cells through
a heap over both sorted half scores (multi-sequence order: largest sum first) and stops at the first sum below the
score that its windows are certain to hold already. That certainty comes from the sample first (its rows are rows of
the table), and within a block of rows from what the visited cells gave. So results are exact, whatever the codebooks;
they only decide how many cells are opened.

Two searches run over one index: the nearest rows of the anchor's label (its positives), then for each positive the
best rows of other labels inside the window of scores that the positive's score sets.

Cells are gathered into blocks of bounded size; a cell of very many rows (copies of one vector) is split over several
blocks. Anchors meet blocks in parts of bounded size, and each such meeting keeps `k` rows for each window.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberwatch.llm.common import staged, table

SAMPLE = 4_096            # bound of the sample that the codebooks are fitted on ...
SAMPLE_CELLS = 1_000_000  # ... and of its numbers, for long vectors
CODES = 48                # codes of a half
ROW_BLOCK = 8_192         # rows that one task holds at a time
ANCHOR_BLOCK = 2_000      # anchors that meet a block of rows at a time
STEP = 1_024              # rows scored between two looks at what is certain
FAR = 1 << 62             # scores beyond this are held at it


def codebook(x: np.ndarray, codes: int = CODES, rounds: int = 8) -> np.ndarray:
    """k-means centres of the rows of x; fewer if there are fewer different rows."""
    start = np.unique(x, axis=0)
    centres = start[np.random.default_rng(11).permutation(len(start))[:codes]]
    for _ in range(rounds):
        near = nearest_code(x, centres)[0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest_code(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and distance of every row's nearest centre."""
    near = np.argmin((centres * centres).sum(1) - 2 * (x @ centres.T), axis=1)
    return near, np.sqrt(((x - centres[near]) ** 2).sum(1))


class Index:
    """What an anchor needs for choosing cells: codebooks, radii, and where each cell's rows lie. Its size depends on
    the number of codes and the sample alone."""

    def __init__(self, books, cells: pd.DataFrame, sample: np.ndarray, labels: np.ndarray, who: np.ndarray, row_block: int):
        self.books, self.sample, self.labels, self.who = books, sample, labels, who
        self.radius = [np.zeros(len(b)) for b in books]
        self.place: dict[tuple[int, int], tuple[int, int, int, float, float]] = {}
        block = held = 0
        for number, (a, b, n, ra, rb) in enumerate(zip(*(cells[c] for c in ("c1", "c2", "n", "r1", "r2")), strict=True)):
            self.radius[0][a], self.radius[1][b] = max(self.radius[0][a], ra), max(self.radius[1][b], rb)
            if held and held + n > row_block:
                block, held = block + 1, 0
            parts = max(1, -(-n // row_block))
            self.place[a, b] = (number, block, parts, ra, rb)
            block, held = (block + parts, 0) if parts > 1 else (block, held + n)
        self.blocks = block + 1

    def halves(self, q: np.ndarray) -> list[np.ndarray]:
        h = self.books[0].shape[1]
        return [q[:h], q[h:]]

    def visits(self, q: np.ndarray, least: float, most: float):
        """(cell number, first block, parts, bound) of the cells that may hold scores from `least` to `most`, by
        falling bound."""
        plain, slack, length = [], [], []
        for half, book in zip(self.halves(q), self.books, strict=True):
            plain.append(book @ half)
            length.append(float(np.linalg.norm(half)))
            slack.append(1e-9 * (np.abs(book) @ np.abs(half)) + 1e-6)
        top = [p + n * r * (1 + 1e-9) + s for p, n, r, s in zip(plain, length, self.radius, slack, strict=True)]
        order = [np.argsort(-t, kind="stable") for t in top]
        u, v = (t[o].tolist() for t, o in zip(top, order, strict=True))
        queue = [(-(u[0] + v[0]), 0, 0)]
        while queue:
            bound, i, j = heapq.heappop(queue)
            if -bound < least:
                return
            if j + 1 < len(v):
                heapq.heappush(queue, (-(u[i] + v[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(u):
                heapq.heappush(queue, (-(u[i + 1] + v[0]), i + 1, 0))
            a, b = int(order[0][i]), int(order[1][j])
            cell = self.place.get((a, b))
            if cell is not None:
                number, block, parts, ra, rb = cell
                lowest = plain[0][a] + plain[1][b] - length[0] * ra - length[1] * rb - slack[0][a] - slack[1][b]
                if lowest <= most:
                    yield number, block, parts, -bound


def scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products of integer rows with q (both as doubles), held at +-FAR."""
    if not len(x):
        return np.zeros(0, np.int64)
    if float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, len(q)) < 2**52:
        return np.rint(x @ q).astype(np.int64)
    exact = x.astype(np.int64).astype(object) @ q.astype(np.int64).astype(object)
    return np.array([max(-FAR, min(FAR, s)) for s in exact], np.int64)


def _matrix(column) -> np.ndarray:
    return np.clip(np.array([np.asarray(v, np.int64) for v in column]), -FAR, FAR).astype(np.float64)


def _kth(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def route(batches, index: Index, k: int, same: bool):
    """For every anchor and block that may hold rows of its windows: the cells to visit there, with their bounds."""
    for b in batches:
        out: list[list] = [[] for _ in range(9)]
        for who, vec_id, label, vector, lo, hi in zip(*(b[c] for c in ("who", "vec_id", "label", "vector", "lo", "hi")), strict=True):
            q = np.asarray(vector, np.int64).astype(np.float64)
            fits = (index.labels == label) == same
            known = scores(index.sample[fits & (index.who != who)], q)
            least = min(max(_kth(known[(known >= x) & (known <= y)], k), float(x)) for x, y in zip(lo, hi, strict=True))
            mine: dict[int, tuple[list, list]] = {}
            for number, block, parts, bound in index.visits(q, least, float(max(hi))):
                for at in range(block, block + parts):
                    cells, bounds = mine.setdefault(at, ([], []))
                    cells.append(number)
                    bounds.append(bound)
            for at, (cells, bounds) in mine.items():
                for column, value in zip(out, (at, who, vec_id, label, vector, lo, hi, cells, bounds), strict=True):
                    column.append(value)
        yield pd.DataFrame(dict(zip(("block", "who", "vec_id", "label", "vector", "lo", "hi", "cells", "bounds"), out, strict=True)))


def best_of_block(rows: pd.DataFrame, asked: pd.DataFrame, k: int, same: bool) -> pd.DataFrame:
    """The `k` best rows of this block for every window of every anchor: (anchor, win, score, vec_id)."""
    out: dict[str, list] = {"anchor": [], "win": [], "score": [], "vec_id": []}
    if len(rows) and len(asked):
        rows = rows.sort_values("cell", kind="stable")
        x, ids, label, who = _matrix(rows["vector"]), rows["vec_id"].to_numpy(), rows["label"].to_numpy(), rows["who"].to_numpy()
        cell = rows["cell"].to_numpy()
        names, first, size = np.unique(cell, return_index=True, return_counts=True)
        where = {int(c): (int(f), int(f + n)) for c, f, n in zip(names, first, size, strict=True)}
        for i in range(len(asked)):
            a = asked.iloc[i]
            q = np.asarray(a["vector"], np.int64).astype(np.float64)
            lo, hi = [int(v) for v in a["lo"]], [int(v) for v in a["hi"]]
            held = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in lo]
            todo, count = [], 0
            cells, bounds = a["cells"], a["bounds"]
            for at, c in enumerate(cells):
                f, t = where.get(int(c), (0, 0))
                if t > f:
                    todo.append(np.arange(f, t))
                    count += t - f
                if not todo or (count < STEP and at + 1 < len(cells)):
                    continue
                pick = np.concatenate(todo)
                todo, count = [], 0
                pick = pick[((label[pick] == a["label"]) == same) & (who[pick] != a["who"])]
                found = scores(x[pick], q)
                for w, (x0, x1) in enumerate(zip(lo, hi, strict=True)):
                    inside = (found >= x0) & (found <= x1)
                    s, v = np.concatenate([held[w][0], found[inside]]), np.concatenate([held[w][1], ids[pick[inside]]])
                    best = np.lexsort((v, -s))[:k]
                    held[w] = s[best], v[best]
                sure = min(s[-1] if len(s) == k else x0 for (s, _), x0 in zip(held, lo, strict=True))
                if at + 1 < len(cells) and bounds[at + 1] < sure:
                    break  # every window is certain: no cell that is left reaches it
            for w, (s, v) in enumerate(held):
                out["anchor"] += [a["who"]] * len(s)
                out["win"] += [w] * len(s)
                out["score"] += s.tolist()
                out["vec_id"] += v.tolist()
    return pd.DataFrame(out).astype({"anchor": "int64", "win": "int32", "score": "int64", "vec_id": "int64"})


def integer_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, vector: components floor(scale * x) of the rows that have a vec_id, a label and a vector without
    null or non-finite components."""
    keep = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vectors.where(keep).select(F.col("vec_id").cast("long").alias("vec_id"), "label",
                                      F.transform("embedding", lambda v: F.floor(v.cast("double") * scale)).alias("vector"))


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
                   codes: int = CODES, sample: int = SAMPLE, row_block: int = ROW_BLOCK, anchor_block: int = ANCHOR_BLOCK) -> DataFrame:
    """Hard negatives of every anchor row (where `is_anchor`, over vec_id and label, holds).

    `rows`: vec_id long, label, vector array<long>. Scores are integer inner products with the anchor; higher ones come
    first, ties by smaller vec_id. An anchor's positives are its `positives` first other rows of its label; for each,
    the first `negatives` rows of other labels with low * positive_score <= 100 * negative_score <= high *
    positive_score are returned: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Fewer rows where there are fewer; positives without such rows give none, nor do anchors without positives, nor does
    an empty table. Rows with a null vec_id, label or vector, and vectors of another length than most (the longer of
    equally frequent lengths), take no part. Rows that repeat vec_id, label and vector count once; rows that share only
    the vec_id are rows of their own. Other columns are ignored, whatever their names. Components and scores
    beyond +-2**62 are held at that bound."""
    spark = rows.sparkSession
    rows = rows.select("vec_id", "label", "vector").where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull())
    most = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if most is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    d = most["d"]
    rows = staged(rows.where(F.size("vector") == d).dropDuplicates(["vec_id", "label", "vector"])
                  .withColumn("who", F.xxhash64("vec_id", "label", "vector")).withColumn("is_anchor", is_anchor), "negatives-rows")

    picked = rows.orderBy("who", "vec_id").limit(min(sample, max(1, SAMPLE_CELLS // max(d, 1)))).select("vector", "label", "who").collect()
    known = _matrix([r["vector"] for r in picked])
    half = d // 2 or d
    books = [codebook(known[:, :half], codes), codebook(known[:, half:], codes)]
    kind = rows.schema["label"].dataType.simpleString()

    def assign(batches):
        for b in batches:
            if len(b):
                x = _matrix(b["vector"])
                (c1, r1), (c2, r2) = nearest_code(x[:, :half], books[0]), nearest_code(x[:, half:], books[1])
                yield b.assign(c1=c1.astype(np.int32), c2=c2.astype(np.int32), r1=r1, r2=r2)

    stored = staged(rows.select("vec_id", "label", "vector", "who").mapInPandas(
        assign, f"vec_id long, label {kind}, vector array<long>, who long, c1 int, c2 int, r1 double, r2 double"), "negatives-index")
    # at most codes * codes rows
    cells = stored.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2")).orderBy("c1", "c2").toPandas()
    index = Index(books, cells, known, np.array([r["label"] for r in picked]), np.array([r["who"] for r in picked], np.int64), row_block)
    shared = spark.sparkContext.broadcast(index)
    where = spark.createDataFrame([(int(a), int(b), *place[:3]) for (a, b), place in index.place.items()],
                                  "c1 int, c2 int, cell int, first int, parts int")
    blocks = (stored.join(F.broadcast(where), ["c1", "c2"])
              .select("vec_id", "label", "vector", "who", "cell", (F.col("first") + F.pmod("who", "parts")).cast("int").alias("block")))
    anchors = rows.where("is_anchor").select("who", "vec_id", "label", "vector")
    groups = max(1, -(-anchors.count() // anchor_block))

    def search(asked: DataFrame, k: int, same: bool) -> DataFrame:
        """(anchor, win, at, score, vec_id): the k first rows of every window [lo, hi] of every asking anchor."""
        sent = (asked.select("who", "vec_id", "label", "vector", "lo", "hi").repartition(max(1, min(200, groups * 8)), "who")
                .mapInPandas(lambda b: route(b, shared.value, k, same),
                             f"block int, who long, vec_id long, label {kind}, vector array<long>, lo array<long>, hi array<long>, "
                             "cells array<int>, bounds array<double>")
                .withColumn("part", F.pmod("who", F.lit(groups)).cast("int")))
        spread = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        found = spread.groupBy("block", "part").cogroup(sent.groupBy("block", "part")).applyInPandas(
            lambda a, b: best_of_block(a, b, k, same), "anchor long, win int, score long, vec_id long")
        order = Window.partitionBy("anchor", "win").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k)

    whole = lambda v: F.array(F.lit(v).cast("long"))
    near = search(anchors.withColumn("lo", whole(-FAR)).withColumn("hi", whole(FAR)), positives, same=True)
    best = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("at", "vec_id", "score"))).alias("good"))
    asking = staged(anchors.join(best.withColumnRenamed("anchor", "who"), "who"), "negatives-positives")
    # the window's ends in integers: ceil(low * s / 100) and floor(high * s / 100), by quotient and rest of s, so that
    # no product leaves 63 bits
    ends = F.transform("good", lambda g: F.struct(g["score"].alias("s")))
    windows = asking.withColumn("ends", ends).withColumn(
        "lo", F.expr(f"transform(ends, e -> ((e.s - pmod(e.s, 100)) div 100) * {low} + ({low} * pmod(e.s, 100) + 99) div 100)")).withColumn(
        "hi", F.expr(f"transform(ends, e -> ((e.s - pmod(e.s, 100)) div 100) * {high} + ({high} * pmod(e.s, 100)) div 100)"))
    far = search(windows, negatives, same=False)
    good = asking.select(F.col("who").alias("anchor"), F.col("vec_id").alias("anchor_id"), F.posexplode("good").alias("win", "g"))
    return good.join(far, ["anchor", "win"]).select(
        "anchor_id", F.col("g.vec_id").alias("positive_id"), F.col("at").alias("rank"), F.col("vec_id").alias("negative_id"),
        F.col("g.score").alias("positive_score"), F.col("score").alias("negative_score"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = integer_vectors(table(spark, sf_dir, "embeddings"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int")
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


#: Brute force over the whole table.
ORACLE = """
WITH v AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label,
    list_transform(embedding, x -> floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, x -> x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS anchor_label, o.vec_id, o.label,
    list_dot_product(a.e, o.e)::BIGINT AS score
  FROM v a, v o WHERE a.vec_id % 100 = 0 AND o.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.anchor_label
    AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
