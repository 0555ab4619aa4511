"""Language identification by mixture inference.

Each language is a distribution over hashed byte trigrams (letters only, lower case), counted over every training
document. A document is taken as a mixture of languages: expectation-maximisation estimates the proportions from its
trigram likelihoods, and the set of languages is the one of the largest penalised likelihood (every language alone,
then growing sets in the order of their estimated proportions). The prediction is the largest member of that set; its
score is its proportion averaged over the compared sets, weighted by their penalised likelihoods.

Fitting is one scan that leaves one row of counts per task and language, then a small aggregation; the model has a
fixed size per language. Predicting is one scan without a shuffle, vectorised over batches of bounded size.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.llm.common import runs, slices, table

BUCKETS = 1 << 14
SMOOTH = 0.5
PENALTY = 3.0        # log-likelihood units per extra language and per log(trigram count)
STEPS = 15
ORDER_STEPS = 8      # of the first run, which only orders the languages
CELLS = 4_000_000    # trigrams x languages held at once
CHUNK = 1 << 20      # bytes counted at once, so that a text of any length takes bounded memory
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[c for c in range(128) if not (65 <= c <= 90 or 97 <= c <= 122)]] = 32


def has_letter(text: str) -> bool:
    """A character of the Unicode categories of letters; digits, fractions, powers and numerals are none."""
    return any(map(str.isalpha, text))


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed trigrams of a whole text and how often each occurs."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8)
    total = np.zeros(BUCKETS, np.int64) if len(raw) > CHUNK else None
    tail = np.zeros(0, np.uint8)  # the last two folded characters, so pieces count as the whole text would
    for start in range(0, len(raw), CHUNK):
        part = np.concatenate([tail, _FOLD[raw[start:start + CHUNK]]])
        part = part[np.concatenate([[True], (part[1:] != 32) | (part[:-1] != 32)])]
        tail, part = part[-2:], part.astype(np.uint32)
        code = ((part[:-2] << 16 | part[1:-1] << 8 | part[2:]) * np.uint32(2654435761)) >> np.uint32(32 - 14)
        if total is None:
            return np.unique(code, return_counts=True)
        total += np.bincount(code, minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at]


def _held_out(folds: int = 4):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 2, F.lit(True))


def fit_languages(docs: DataFrame) -> dict[str, np.ndarray]:
    """Language -> trigram log-probabilities, from every document outside the held-out fold that has text and lang.
    Without any such document the model is empty and every prediction is 'und'."""
    def rows(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in (part for whole in batches for part in slices(whole, 0)):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, n = grams(text)
                mine = sums.get(lang)
                if mine is None:
                    mine = sums[lang] = np.zeros(BUCKETS, np.int64)
                mine[at] += n
        for lang, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()),
                                              pa.array(v[at], pa.int64())], ["lang", "gram", "n"])

    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~_held_out())
    counts = (known.select("text", "lang").mapInArrow(rows, "lang string, gram int, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    out: dict[str, np.ndarray] = {}
    got = counts.groupBy("lang").agg(F.collect_list("gram").alias("grams"), F.collect_list("n").alias("ns")).collect()
    for r in sorted(got, key=lambda r: r.lang):  # one row of at most BUCKETS counts per language
        v = np.full(BUCKETS, SMOOTH)
        v[r.grams] += r.ns
        out[r.lang] = np.log(v / v.sum())
    return out


def _mixture(p, c, starts, doc, steps):
    """EM proportions (documents x languages) and log-likelihoods; p: probabilities of each (document, trigram) row."""
    total = np.add.reduceat(c, starts)
    pi = np.full((len(starts), p.shape[1]), 1 / p.shape[1])
    for _ in range(steps):
        r = pi[doc] * p
        r *= (c / r.sum(1))[:, None]
        pi = np.add.reduceat(r, starts, axis=0) / total[:, None]
    return pi, np.add.reduceat(c * np.log((pi[doc] * p).sum(1)), starts)


def predict(texts: list[str | None], langs: list[str], logp: np.ndarray) -> list[tuple[str, float, list[str], list[float]]]:
    """(language, score, chosen set, proportions) of each text; logp is trigrams x languages."""
    out = [(UNKNOWN, 0.0, [], [])] * len(texts)
    found = [i for i, t in enumerate(texts) if t and langs and has_letter(t)]
    sizes = [min(len(texts[i]), BUCKETS) for i in found]  # no text has more distinct trigrams
    for a, b in runs(sizes, max(1, CELLS // max(1, len(langs)))):
        ids = found[a:b]
        sets = [grams(texts[i]) for i in ids]
        lens = np.array([len(g) for g, _ in sets])
        starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
        doc = np.repeat(np.arange(len(ids)), lens)
        g = np.concatenate([g for g, _ in sets])
        c = np.concatenate([n for _, n in sets]).astype(float)
        alone = np.add.reduceat(c[:, None] * logp[g], starts, axis=0)
        k = len(langs)
        cand = np.argsort(-alone, axis=1, kind="stable")
        alone = np.take_along_axis(alone, cand, axis=1)
        lp = np.take_along_axis(logp[g], cand[doc], axis=1)
        p = np.exp(lp - lp.max(1, keepdims=True))
        shift = np.add.reduceat(c * lp.max(1), starts)
        unit = PENALTY * np.log(np.maximum(np.add.reduceat(c, starts), 2))
        # every language alone, then sets that grow in the order of the estimated proportions while that pays
        values, shares = [], []
        if k > 1:
            order = np.argsort(-_mixture(p, c, starts, doc, ORDER_STEPS)[0], axis=1, kind="stable")
            growing, last = np.arange(len(ids)), alone[:, 0]
            for size in range(2, k + 1):
                rows = np.isin(doc, growing)
                sub = np.repeat(np.arange(len(growing)), lens[growing])
                first = np.concatenate([[0], np.cumsum(lens[growing])[:-1]])
                members = order[growing, :size]
                pi, ll = _mixture(np.take_along_axis(p[rows], members[sub], axis=1), c[rows], first, sub, STEPS)
                value = np.full(len(ids), -np.inf)
                value[growing] = ll + shift[growing] - unit[growing] * (size - 1)
                values.append(value)
                shares.append((growing, members, pi))
                growing = growing[value[growing] > last[growing]]
                last = value
                if not len(growing):
                    break
        values = np.concatenate([alone, *[v[:, None] for v in values]], axis=1)
        best = values.argmax(1)
        weight = np.exp(values - values.max(1, keepdims=True))
        weight /= weight.sum(1, keepdims=True)
        mean, chosen_share = weight[:, :k].copy(), np.zeros((len(ids), k))
        alone_best = np.flatnonzero(best < k)
        chosen_share[alone_best, best[alone_best]] = 1
        for m, (at, members, pi) in enumerate(shares, k):  # only the documents whose set has grown so far
            mean[at[:, None], members] += weight[at, m][:, None] * pi
            mine = best[at] == m
            chosen_share[at[mine][:, None], members[mine]] = pi[mine]
        for d, i in enumerate(ids):
            share = chosen_share[d]
            chosen = [j for j in np.argsort(-share, kind="stable") if share[j] > 0]
            out[i] = (langs[cand[d, chosen[0]]], float(min(1.0, mean[d, chosen[0]])),
                      [langs[cand[d, j]] for j in chosen], [float(share[j]) for j in chosen])
    return out


def _packed(model: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    return list(model), np.stack(list(model.values()), 1) if model else np.zeros((BUCKETS, 0))


def identify_languages(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """Predict the languages of every whole text.

    Returns doc_id, held_out, lang_pred, score, lang_set and lang_shares (largest first). A null text, or one without
    a letter, is 'und' with score 0 and an empty set. Equal likelihoods go to the first language by name; repeated
    rows are predicted alike; other columns are ignored; an empty table gives no rows."""
    langs, logp = _packed(model)

    def rows(batches):
        for batch in (part for whole in batches for part in slices(whole, 2)):
            got = predict(batch.column(2).to_pylist(), langs, logp)
            cols = list(zip(*got, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()),
                 pa.array(cols[2], pa.list_(pa.string())), pa.array(cols[3], pa.list_(pa.float64()))],
                ["doc_id", "held_out", "lang_pred", "score", "lang_set", "lang_shares"])

    return docs.select("doc_id", _held_out().alias("held_out"), "text").mapInArrow(
        rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, "
              "lang_set array<string>, lang_shares array<double>")


def keep_identified(docs: DataFrame, model: dict[str, np.ndarray], min_score: float = 0.3) -> DataFrame:
    """The rows of `docs` (all columns) whose text has a language of at least `min_score`."""
    langs, logp = _packed(model)
    at = docs.columns.index("text")

    def rows(batches):
        for batch in (part for whole in batches for part in slices(whole, at)):
            yield batch.filter(pa.array([lang != UNKNOWN and s >= min_score
                                         for lang, s, _, _ in predict(batch.column(at).to_pylist(), langs, logp)], pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify_languages(docs, fit_languages(docs))
