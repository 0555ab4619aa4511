"""Quality scores from a generalised additive model with pairwise interactions.

A text becomes a row of numeric features. Each feature is cut into quantile bins and has a lookup table (bin ->
log-odds); a few feature pairs have a two-way table. The tables are learned by cyclic boosting: round after round,
each feature in turn takes one shallow tree over its bins, fitted to the current gradients and shrunk, and the tree is
added to the table; the pairs whose best four-way cut gains most on the residuals are then boosted the same way.
Scoring is a sum of table entries, vectorised over a batch of texts.

The model is fitted on the driver from the feature rows (not the texts) of at most `max_train` labelled documents,
chosen by hash; scoring is one scan over all documents without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.llm.common import slices, table

MAX_TRAIN = 20_000   # bound of the labelled sample the model is fitted on
BINS = 32
ROUNDS = 150
PAIR_ROUNDS = 60
PAIRS = 6
RATE = 0.15
RIDGE = 1.0
THRESHOLD = 0.3

FEATURES = ("log_bytes", "log_words", "word_bytes", "upper", "digits", "marks", "stops", "breaks", "distinct_words",
            "doubled_words", "repeated_lines", "shouts", "bars", "symbols", "entropy", "top_word", "line_words", "non_ascii")

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LETTER = _UPPER | ((_BYTES >= 97) & (_BYTES <= 122))
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
_MARK = (_BYTES > 32) & (_BYTES < 127) & ~_LETTER & ~_DIGIT
_SYMBOL = np.isin(_BYTES, [ord(c) for c in "#$%&*+<=>@^_~\\{}[]"])


def features(text: str | None) -> np.ndarray:
    """Feature row of a whole text; a null or empty text gives zeros."""
    out = np.zeros(len(FEATURES))
    raw = (text or "").encode("utf-8", "replace")
    if not raw:
        return out
    n = len(raw)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    w = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = max(1, int(count[_LETTER].sum()))
    share = count[count > 0] / n
    seen = Counter(words)
    out[:] = (
        np.log1p(n), np.log1p(len(words)), (n - count[_SPACE].sum()) / w, count[_UPPER].sum() / letters, count[_DIGIT].sum() / n,
        count[_MARK].sum() / w, count[ord(".")] / w, count[10] / w, len(seen) / w,
        sum(map(bytes.__eq__, words, words[1:])) / w, 1 - len(set(lines)) / max(1, len(lines)), count[ord("!")] / w,
        count[ord("|")] / w, count[_SYMBOL].sum() / w, -(share * np.log2(share)).sum(), max(seen.values(), default=0) / w,
        len(words) / max(1, len(lines)), count[128:].sum() / n)
    return out


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Newton steps of a shallow tree over ordered bins: cut greedily, at most `leaves` leaves."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    value = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + RIDGE)
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for i, (a, b) in enumerate(parts):
            if b - a > 1:
                cut = np.arange(a + 1, b)
                gain = value(a, cut) + value(cut, b) - value(a, b)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], i, int(cut[k]))
        if best[1] is None:
            break
        a, b = parts[best[1]]
        parts[best[1]:best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + RIDGE)
    return out


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best four-leaf tree that cuts both axes once, and its gain over no cut."""
    cg = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    ch = np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    a, b = np.arange(1, g.shape[0])[:, None], np.arange(1, g.shape[1])[None, :]
    if not a.size or not b.size:
        return 0.0, np.zeros_like(g)
    quads = []
    for c in (cg, ch):
        ul, left, top, total = c[a, b], c[a, -1], c[-1, b], c[-1, -1]
        quads.append((ul, left - ul, top - ul, total - left - top + ul))
    gain = sum(x * x / (y + RIDGE) for x, y in zip(*quads, strict=True)) - cg[-1, -1] ** 2 / (ch[-1, -1] + RIDGE)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty_like(g)
    for (rows, cols), x, y in zip(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)),
                                   (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))),
                                  *quads, strict=True):
        out[rows, cols] = x[i, j] / (y[i, j] + RIDGE)
    return float(gain[i, j]), out


@dataclass
class Gam:
    bias: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        if self.edges and len(x):
            b = self.binned(x)
            for j, t in enumerate(self.tables):
                z += t[b[:, j]]
            for i, j, t in self.pairs:
                z += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-z))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Gam:
        """With no rows, or one class only, the score is the smoothed share of label 1."""
        share = (y.sum() + 1) / (len(y) + 2)
        model = cls(bias=float(np.log(share / (1 - share))))
        if len(y) == 0 or y.min() == y.max():
            return model
        model.edges = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) for j in range(x.shape[1])]
        sizes = [len(e) + 1 for e in model.edges]
        model.tables = [np.zeros(s) for s in sizes]
        b = model.binned(x)
        z = np.full(len(y), model.bias)

        def slopes():
            p = 1 / (1 + np.exp(-z))
            return y - p, p * (1 - p)

        for _ in range(ROUNDS):
            for j, s in enumerate(sizes):
                g, h = slopes()
                step = RATE * _tree(np.bincount(b[:, j], g, s), np.bincount(b[:, j], h, s))
                model.tables[j] += step
                z += step[b[:, j]]

        def grid(i, j, v):
            return np.bincount(b[:, i] * sizes[j] + b[:, j], v, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])

        g, h = slopes()
        ranked = sorted(((_cross(grid(i, j, g), grid(i, j, h))[0], i, j)
                         for i in range(len(sizes)) for j in range(i + 1, len(sizes))), reverse=True)[:PAIRS]
        model.pairs = [(i, j, np.zeros((sizes[i], sizes[j]))) for gain, i, j in ranked if gain > 0]
        for _ in range(PAIR_ROUNDS):
            for i, j, t in model.pairs:
                g, h = slopes()
                step = RATE * _cross(grid(i, j, g), grid(i, j, h))[1]
                t += step
                z += step[b[:, i], b[:, j]]
        return model


def _held_out(folds: int = 5):
    """Documents whose labels are never learned from; a null doc_id has no label and counts as held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(True))


def fit_quality(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Gam:
    """Fit on at most `max_train` labelled documents (those of smallest hash, the same at any partitioning) outside
    the held-out fold. Null labels do not count; of contradicting labels of one document the lower holds, and of several
    texts under one doc_id the one of smallest hash is learned from, so the rows are bounded as the labels are."""
    known = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~_held_out())
             .groupBy("doc_id").agg(F.min("quality").cast("double").alias("y"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train))
    # the sample's size is bounded by max_train, so it may be broadcast and the texts stay where they are
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "y", "doc_id", F.xxhash64("text").alias("h"))

    def rows(batches):
        for batch in batches:
            x = np.array([features(t) for t in batch.column(0).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), *batch.columns[1:]], ["x", "y", "doc_id", "h"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    one = texts.mapInArrow(rows, f"x array<double>, y double, doc_id {kind}, h long").groupBy("doc_id").agg(F.min(F.struct("h", "x", "y")).alias("r"))
    got = one.select("r.x", "r.y").toArrow()  # at most max_train rows of numbers
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    y = got.column("y").to_numpy()
    order = np.lexsort((*x.T[::-1], y))  # sums of doubles depend on the order
    return Gam.fit(x[order], y[order])


def scorer(model: Gam):
    """Arrow column of texts -> array of scores."""
    def score(texts) -> np.ndarray:
        return model.score(np.array([features(t) for t in texts.to_pylist()]).reshape(-1, len(FEATURES)))

    return score


def score_quality(docs: DataFrame, model: Gam, threshold: float = THRESHOLD) -> DataFrame:
    """Score every whole text.

    Returns doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold). Null and empty texts score as
    all-zero features; repeated rows score alike; other columns are ignored; an empty table gives no rows."""
    score = scorer(model)

    def rows(batches):
        for batch in (part for whole in batches for part in slices(whole, 2)):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score(batch.column(2)))],
                                             ["doc_id", "held_out", "score"])

    got = docs.select("doc_id", _held_out().alias("held_out"), "text").mapInArrow(
        rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double")
    return got.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: Gam, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` (all columns) whose text scores at least `threshold`."""
    score, at = scorer(model), docs.columns.index("text")

    def rows(batches):
        for batch in (part for whole in batches for part in slices(whole, at)):
            yield batch.filter(pa.array(score(batch.column(at)) >= threshold))

    return docs.mapInArrow(rows, docs.schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
