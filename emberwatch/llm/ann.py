"""Approximate nearest neighbours by cosine: a forest of random-projection trees.

Each tree splits a bounded sample (the vectors of smallest hash) by the hyperplane between two random members, at the
median, down to small leaves. Every vector of the table is then routed to its leaf in every tree: that is the index. A
query walks all trees through one priority queue, always opening the branch whose hyperplane it misses by least, until
the leaves it has opened hold a given share of the sample; all indexed vectors of those leaves are its candidates and
are ranked by their exact cosine in double precision. The share is fitted: members of the sample are asked, and it is the
least with which they find RECALL of their true neighbours in the sample. Vectors with structure need a small share;
random directions, which no index tells apart, a large one. In a larger table true neighbours lie nearer, so the share
rather errs upwards, and it does not depend on the table's size otherwise.

Equal vectors are one class with its smallest ids (one more than the neighbours asked for, so that a query can leave
itself out), so copies make neither a large leaf nor more candidates; equal query vectors are searched once. Queries
meet the index in blocks of bounded size; each block pair keeps only its best rows.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberwatch.llm.common import staged, table

SAMPLE = 20_000          # bound of the sample the trees are fitted on ...
SAMPLE_CELLS = 4_000_000  # ... and of its numbers, for long vectors
TREES = 24
LEAF = 48
RECALL = 0.95            # share of their sample neighbours that sample queries are to find; sets how many leaves are opened
ASKED = 200              # sample members asked for that
ROW_BLOCK = 20_000
QUERY_BLOCK = 2_000


class Forest(NamedTuple):
    """Trees as arrays; child numbers below 0 are leaves -1, -2, ... numbered through the whole forest."""
    roots: list[int]
    normal: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    members: list[np.ndarray]  # sample members of each leaf
    size: int


def _matrix(column) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in column])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def build_forest(sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 7) -> Forest:
    """`sample`: unit vectors, one per row."""
    rng = np.random.default_rng(seed)
    roots, normal, cut, child, members = [], [], [], [], []

    def grow(rows: np.ndarray) -> int:
        if len(rows) <= leaf:
            members.append(rows)
            return -len(members)
        a, b = rng.choice(rows, 2, replace=False)
        n = sample[a] - sample[b]
        size = np.linalg.norm(n)
        n = n / size if size > 1e-9 else unit(rng.normal(size=(1, sample.shape[1])))[0]
        side = sample[rows] @ n
        ranked = np.sort(side)
        at = (ranked[len(rows) // 2 - 1] + ranked[len(rows) // 2]) / 2  # between members, so rounding moves none across
        left = side < at
        if left.all() or not left.any():
            at = (ranked[0] + ranked[-1]) / 2
            left = side < at
            if left.all() or not left.any():  # nothing tells these members apart
                members.append(rows)
                return -len(members)
        k = len(normal)
        normal.append(n)
        cut.append(at)
        child.append([0, 0])
        child[k] = [grow(rows[left]), grow(rows[~left])]
        return k

    for _ in range(trees):
        roots.append(grow(np.arange(len(sample))))
    d = sample.shape[1]
    return Forest(roots, np.array(normal).reshape(-1, d), np.array(cut), np.array(child, np.int64).reshape(-1, 2), members, len(sample))


def leaves_of(forest: Forest, x: np.ndarray) -> np.ndarray:
    """Leaf number of every row in every tree."""
    out = np.zeros((len(x), len(forest.roots)), np.int32)
    for t, root in enumerate(forest.roots):
        todo = [(root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows, t] = -node - 1
            elif len(rows):
                right = x[rows] @ forest.normal[node] >= forest.cut[node]
                todo += [(forest.child[node, 0], rows[~right]), (forest.child[node, 1], rows[right])]
    return out


def _walk(forest: Forest, q: np.ndarray):
    """Leaf numbers, nearest margin first over all trees."""
    side = (forest.normal @ q - forest.cut).tolist()
    child = forest.child.tolist()
    queue = [(0.0, root) for root in forest.roots]
    heapq.heapify(queue)
    while queue:
        margin, node = heapq.heappop(queue)
        while node >= 0:
            right = side[node] >= 0
            heapq.heappush(queue, (max(margin, abs(side[node])), child[node][not right]))
            node = child[node][right]
        yield -node - 1


def open_leaves(forest: Forest, q: np.ndarray, budget: float) -> list[int]:
    """Leaves a query opens until they hold `budget` sample members."""
    seen, held, out = np.zeros(forest.size, bool), 0, []
    for leaf in _walk(forest, q):
        rows = forest.members[leaf]
        held += len(rows) - int(seen[rows].sum())
        seen[rows] = True
        out.append(leaf)
        if held >= budget:
            break
    return out


def fitted_share(forest: Forest, sample: np.ndarray, k: int, recall: float = RECALL, asked: int = ASKED) -> float:
    """The least share of the sample that opened leaves must hold so that sample members find `recall` of their k
    nearest other members."""
    ask = np.random.default_rng(5).permutation(len(sample))[:asked]
    needed = []
    for i in ask:
        score = sample @ sample[i]
        score[i] = -np.inf
        near = np.argpartition(-score, min(k, len(sample) - 1) - 1)[:k] if len(sample) > 1 else np.zeros(0, int)
        held_at = np.full(len(sample), len(sample), float)
        seen, held, left = np.zeros(len(sample), bool), 0, set(near.tolist())
        for leaf in _walk(forest, sample[i]):
            rows = forest.members[leaf]
            new = rows[~seen[rows]]
            held += len(new)
            seen[new] = True
            held_at[new] = held
            left.difference_update(new.tolist())
            if not left:
                break
        needed += held_at[near].tolist()
    return float(np.quantile(needed, recall, method="higher")) / len(sample) if needed else 1.0


def _summed(x: np.ndarray) -> np.ndarray:
    """Row sums from left to right, the same however many rows there are."""
    return np.cumsum(x, axis=1)[:, -1]


def best_of_block(rows: pd.DataFrame, queries: pd.DataFrame, keep: int) -> pd.DataFrame:
    """The `keep` best (score, id) of each query among this block's rows in its leaves."""
    out = {"query": [], "score": [], "vec_id": []}
    if len(rows) and len(queries):
        x, q = _matrix(rows["embedding"]), _matrix(queries["embedding"])
        nx, nq = np.sqrt(_summed(x * x)), np.sqrt(_summed(q * q))
        ids = [np.asarray(v, np.int64) for v in rows["ids"]]
        leaves = np.array(rows["leaves"].tolist(), np.int64)
        flat = leaves.ravel()
        order = np.argsort(flat, kind="stable")
        starts = np.searchsorted(flat[order], np.arange(flat.max() + 2))
        owner = order // leaves.shape[1]
        for k, opened in enumerate(queries["opened"]):
            opened = np.asarray(opened)
            opened = opened[opened <= flat.max()]
            mine = np.zeros(len(x), bool)
            for leaf in opened:
                mine[owner[starts[leaf]:starts[leaf + 1]]] = True
            cand = np.flatnonzero(mine)
            if not len(cand):
                continue
            score = (x[cand] @ q[k]) / (nx[cand] * nq[k])
            if len(cand) > keep:  # all that tie with the last kept one, but for rounding, stay until ids decide
                near = score >= np.partition(score, len(cand) - keep)[len(cand) - keep] - 1e-12
                cand = cand[near]
            score = _summed(x[cand] * q[k]) / (nq[k] * nx[cand])
            n = [len(ids[c]) for c in cand]
            vec, val = np.concatenate([ids[c] for c in cand]), np.repeat(score, n)
            top = np.lexsort((vec, -val))[:keep]
            out["query"] += [queries["query"].iloc[k]] * len(top)
            out["score"] += val[top].tolist()
            out["vec_id"] += vec[top].tolist()
    return pd.DataFrame(out).astype({"query": "int64", "score": "float64", "vec_id": "int64"})


def nearest(vectors: DataFrame, is_query, k: int = 5, trees: int = TREES, leaf: int = LEAF, share: float | None = None,
            sample: int = SAMPLE, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The `k` nearest of every query row (those where the column `is_query` of vec_id holds) among all other rows.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id; all candidates if there are fewer
    than k. `share`: see the module text; fitted if None. Rows with a null vec_id or a null, empty or zero vector, with null or non-finite components, or of another
    length than most vectors (the longer of equally frequent lengths) take no part. Rows that repeat an id and vector
    count once. Other columns are ignored; an empty table gives no rows."""
    spark = vectors.sparkSession
    rows = (vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
            .where(~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
                   & F.exists("embedding", lambda v: v != 0)))
    widths = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if widths is None:
        return empty
    d = widths["d"]
    rows = rows.where(F.size("embedding") == d).dropDuplicates(["vec_id", "embedding"])
    first = Window.partitionBy("embedding").orderBy("vec_id")
    classes = staged(rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1)
                     .groupBy("embedding").agg(F.sort_array(F.collect_list(F.col("vec_id").cast("long"))).alias("ids")), "ann-classes")
    n = classes.count()
    bound = min(sample, max(1, SAMPLE_CELLS // d))
    picked = classes.orderBy(F.xxhash64("embedding"), F.col("ids")[0]).limit(bound).select("embedding").collect()
    known = unit(_matrix([r[0] for r in picked]))
    forest = build_forest(known, trees, leaf)
    budget = (fitted_share(forest, known, k) if share is None else share) * forest.size
    kind = classes.schema["embedding"].dataType.simpleString()

    def index(batches):
        for b in batches:
            if len(b):
                yield b.assign(leaves=list(leaves_of(forest, unit(_matrix(b["embedding"])))))

    def walk(batches):
        for b in batches:
            if len(b):
                yield b.assign(opened=[open_leaves(forest, q, budget) for q in unit(_matrix(b["embedding"]))])

    queries = rows.where(is_query)
    asked = queries.groupBy("embedding").agg(F.min(F.col("vec_id").cast("long")).alias("query"))
    row_blocks, n_queries = -(-n // row_block), asked.count()
    query_blocks = max(1, -(-n_queries // query_block))
    blocks = [F.explode(F.sequence(F.lit(0), F.lit(m - 1))) for m in (query_blocks, row_blocks)]
    left = (classes.mapInPandas(index, f"embedding {kind}, ids array<long>, leaves array<int>")
            .withColumn("rb", F.pmod(F.xxhash64("embedding"), F.lit(row_blocks)).cast("int")).withColumn("qb", blocks[0]))
    right = (asked.repartition(max(1, min(64, n_queries // 50)), "query")
             .mapInPandas(walk, f"embedding {kind}, query long, opened array<int>")
             .withColumn("qb", F.pmod(F.xxhash64("query"), F.lit(query_blocks)).cast("int")).withColumn("rb", blocks[1]))
    found = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInPandas(
        lambda a, b: best_of_block(a, b, k + 1), "query long, score double, vec_id long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = (found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1)
            .groupBy("query").agg(F.sort_array(F.collect_list(F.struct("_n", "vec_id", "score"))).alias("top")))
    # every query row takes the result of its vector's search, without itself
    owners = queries.select(F.col("vec_id").cast("long").alias("query_id"), "embedding").join(asked, "embedding").select("query_id", "query")
    own = F.slice(F.filter("top", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return (owners.join(best, "query").select("query_id", F.posexplode(own).alias("_at", "_hit"))
            .select("query_id", (F.col("_at") + 1).alias("rank"), F.col("_hit")["vec_id"].alias("vec_id"), F.col("_hit")["score"].alias("score")))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
