"""Spelling variants: words one edit apart, found by walking a trie as a relation.

The trie of all words is a table of edges (node, letter, child); a node is the hash of its prefix. A search state is
(word, position in the word, node, edits spent). Level by level the states are joined with the edges of their node:
without an edit so far a state may read another letter (replaced), an additional one (inserted) or skip one of its own
(deleted); after its edit it may only read its own letters. A state that reaches a word's end with its one edit spent
has found a near word; below a node that only one word is left of, the two remainders are compared at once.

An edit lies in the first or in the second half of a word. So each word walks two tries, of all words read forwards and
backwards, and edits only beyond the half of it that it shares with the other word: its states start deep in the trie,
where few letters branch, and the nodes near the root, through which all words pass, are never joined. A node of very
many words has its edges in several copies, and states choose theirs by the word. Two nodes of one hash (chance about
n*n / 2**65) would only add candidates; every pair is confirmed by its edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.llm.common import slices, staged, table

FLUSH = 200_000     # different words that a counting task holds
HOT = 4_096         # words below a node from which on its edges are copied ...
SHARE = 1_000       # ... or one of so many parts of all words, if that is more
HOT_DEPTH = 64      # so the table of hot nodes has at most SHARE * HOT_DEPTH rows

_RUN = re.compile("[a-z\u00c0-\u00ff]+")  # once A-Z are lower-cased

Change = Callable[[str, str], str]


def word_counts(docs: DataFrame, change: Change | None = None) -> DataFrame:
    """word, n: how often each maximal run of letters (A-Z, a-z, U+00C0 to U+00FF; A-Z lower-cased) occurs in the whole
    texts. `change(doc_id as text, run)` may put another word in a run's place. A null text has no words; a null doc_id
    is the empty text; a run that `change` leaves nothing of is no word."""
    def rows(batches):
        held: Counter = Counter()
        for batch in (part for whole in batches for part in slices(whole, 1)):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                low = text.encode("utf-8", "replace").lower().decode()  # bytes.lower changes A-Z only
                found = Counter(_RUN.findall(low))
                name = "" if doc is None else str(doc)
                for run, n in found.items():
                    held[run if change is None else change(name, run)] += n
                if len(held) > FLUSH:
                    yield _counted(held)
                    held = Counter()
        yield _counted(held)

    return (docs.select("doc_id", "text").mapInArrow(rows, "word string, n long").where(F.col("word") != "")
            .groupBy("word").agg(F.sum("n").alias("n")))


def _counted(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])


def _paths(words: DataFrame, skip: int) -> DataFrame:
    """Every word's way through both tries, from depth `skip` on: one row for each node, with the letter that follows
    ('' at the word's end), the child it leads to, the letter after that, and whether the word may spend its edit here."""
    half = F.expr("length(word) div 2")
    turned = words.select("word", F.explode(F.array(F.lit(False), F.lit(True))).alias("back")).select(
        F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word")).alias("word"), "back", F.length("word").alias("size"),
        F.when(F.col("back"), F.length("word") - half).otherwise(half).alias("start"))
    nodes = turned.select("*", F.explode(F.sequence(F.lit(skip), F.col("size"))).alias("depth"))
    a = F.expr("substring(word, depth + 1, 1)")
    return nodes.select(
        "depth", F.expr("xxhash64(back, substring(word, 1, depth))").alias("node"), a.alias("a"),
        F.when(a != "", F.expr("xxhash64(back, substring(word, 1, depth + 1))")).alias("child"),
        F.expr("substring(word, depth + 2, 1)").alias("b"), "word", "size", "back", (F.col("depth") >= F.col("start")).alias("open"))


def near_words(words: DataFrame) -> DataFrame:
    """word, near: all pairs (in both orders) of the given distinct words (column `word`) that differ by exactly one
    inserted, deleted or replaced code point. Empty and null words are near to nothing."""
    spark = words.sparkSession
    words = words.select("word").where(F.length("word") > 0)
    count, shortest = words.agg(F.count(F.lit(1)), F.min(F.length("word"))).first()
    none = spark.createDataFrame([], "word string, near string")
    if not count:
        return none
    path = staged(_paths(words, shortest // 2), "spelling-paths")
    edges = path.groupBy("depth", "node", "a", "child").agg(F.count(F.lit(1)).alias("n"), F.max("word").alias("any"))
    edges = staged(edges, "spelling-edges")
    limit = max(HOT, count // SHARE)
    nodes = (edges.groupBy("node").agg(
        F.max("depth").alias("depth"), F.sum("n").alias("below"), F.concat_ws("", F.collect_list("a")).alias("letters"),
        F.max(F.when(F.col("a") == "", F.col("any"))).alias("ends"))
        .withColumn("parts", F.when((F.col("below") > limit) & (F.col("depth") <= HOT_DEPTH), F.ceil(F.col("below") / limit)).otherwise(1).cast("int")))
    nodes = staged(nodes, "spelling-nodes")
    shared = nodes.where("below > 1")  # below any other node there is one word only
    deepest = shared.agg(F.max("depth")).first()[0]
    if deepest is None:
        return none
    # an edge with what stands at its end: `hit` is the word that ends there, or the only one that is left below
    below = nodes.select(F.col("node").alias("child"), "ends", "letters", F.col("below").alias("under"), F.col("parts").alias("child_parts"))
    ways = (edges.where("a <> ''").join(shared.select("node", "parts"), "node").join(below, "child")
            .select("depth", "node", F.col("a").alias("letter"), "child", "child_parts", "letters", (F.col("under") == 1).alias("leaf"),
                    F.when(F.col("under") == 1, F.col("any")).otherwise(F.col("ends")).alias("hit"),
                    F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")))
    hot = shared.where("parts > 1").select("node", "parts")  # at most SHARE * HOT_DEPTH nodes
    salt = lambda parts: F.pmod(F.xxhash64("word"), F.coalesce(parts, F.lit(1)).cast("long")).cast("int").alias("part")
    own = path.where("open").join(shared.select("node", "ends"), "node")
    last = own.where("a <> '' and b = '' and ends is not null").select("word", F.col("ends").alias("hit"), "back")  # its last letter deleted
    unspent = own.join(F.broadcast(hot), "node", "left").select("depth", "node", salt(F.col("parts")), "word", "size", "back", "a", "b")
    unspent, ways = _by_depth(unspent, "spelling-unspent"), _by_depth(ways, "spelling-ways")

    hits, spent = [last], None
    for depth in range(shortest // 2, deepest + 1):
        here = ways.where(F.col("depth") == depth).drop("depth")
        states = unspent.where(F.col("depth") == depth).select("node", "part", "word", "size", "back", F.lit(depth).alias("pos"), "a", "b")
        other, skipped = F.col("letter") != F.col("a"), (F.col("letter") == F.col("b")) & (F.col("b") != F.col("a"))
        after = F.array(F.when(other & (F.col("a") != ""), F.col("pos") + 1), F.when(other, F.col("pos")), F.when(skipped, F.col("pos") + 2))
        moved = states.join(here, ["node", "part"]).where(other).withColumn("to", F.explode(after)).where("to is not null")
        cols = ["word", "size", "back", "to", "child", "child_parts", "letters", "leaf", "hit"]
        moved = moved.select(*cols)
        if spent is not None:
            read = spent.join(here.withColumnRenamed("letter", "a"), ["node", "part", "a"]).withColumn("to", F.col("pos") + 1)
            moved = moved.unionByName(read.select(*cols))
        rest = F.expr("substring(word, to + 1)")
        goes_on = ~F.col("leaf") & (F.col("to") < F.col("size")) & F.expr("instr(letters, substring(word, to + 1, 1)) > 0")
        found = F.when(F.col("leaf"), F.expr(f"substring(hit, {depth + 2})") == rest).otherwise((F.col("to") == F.col("size")) & F.col("hit").isNotNull())
        level = staged(moved.where(goes_on | found).select(
            F.col("child").alias("node"), salt(F.col("child_parts")), "word", "size", "back", F.col("to").alias("pos"),
            F.expr("substring(word, to + 1, 1)").alias("a"), F.when(found, F.col("hit")).alias("hit")), "spelling-level")
        hits.append(level.where("hit is not null").select("word", "hit", "back"))
        spent = level.where("hit is null").drop("hit")
    pairs = hits[0]
    for more in hits[1:]:
        pairs = pairs.union(more)
    turned = lambda c: F.when(F.col("back"), F.reverse(c)).otherwise(F.col(c))
    return (pairs.select(turned("word").alias("word"), turned("hit").alias("near")).distinct()
            .where(F.levenshtein("word", "near") == 1))


def _by_depth(df: DataFrame, label: str) -> DataFrame:
    """Staged with one folder for each depth, so that a level reads only its own rows."""
    from emberwatch.session import ensure_checkpoint_dir
    import uuid

    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/llm/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy("depth").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def variant_groups(words: DataFrame, ratio: int = 5) -> DataFrame:
    """Groups spelling variants. `words`: distinct words with their frequency (word, n).

    Returns word, form, root, n, n_near, form_n: n_near counts the near words (one edit away); form is the near word of
    the largest n (ties: the smallest in code-point order) if that n is at least `ratio` (more than 1) times the word's,
    else null; root is the last word when forms are followed from the word, itself if it has none. Rows with a null or
    empty word take no part; an empty table gives no rows; other columns are ignored, whatever their names. Words that
    stand in the table more than once count as one with the sum of their n."""
    words = staged(words.where(F.length("word") > 0).groupBy("word").agg(F.sum("n").alias("n")), "spelling-words")
    near = near_words(words)
    best = (near.join(words.select(F.col("word").alias("near"), F.col("n").alias("m")), "near")
            .groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("neg"), F.col("near").alias("form"))).alias("best")))
    wins = -F.col("best.neg") >= F.col("n") * ratio
    out = staged(words.join(best, "word", "left").select(
        "word", F.when(wins, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(wins, -F.col("best.neg")).alias("form_n")), "spelling-forms")
    # frequencies grow by `ratio` with every step, so chains are short and have no circles; each round doubles the steps
    up = staged(out.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = up.join(up.select(F.col("word").alias("root"), F.col("root").alias("far")), "root", "left").select(
            "word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved"))
        further = staged(further, "spelling-roots")
        if further.where("moved").isEmpty():
            break
        up = further.drop("moved")
    return out.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _misspelt(doc: str, run: str) -> str:
    """The query's rule: with h the crc32 of `<doc_id>:<run>`, a run whose h 199 divides loses code point h % length."""
    h = zlib.crc32(f"{doc}:{run}".encode())
    if h % 199:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = word_counts(table(spark, sf_dir, "documents"), _misspelt)
    return variant_groups(words.where((F.length("word") >= 6) & (F.col("n") >= 5)))
