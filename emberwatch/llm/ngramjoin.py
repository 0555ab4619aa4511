"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is its set of distinct word n-grams (64-bit hashes). All sets share one order of tokens, rare first; the
rarity comes from a fixed-size table of counts over every token of every document. If two sets are similar enough, the
l-prefixes of both (size - least overlap + l tokens) share at least l tokens, for any l. So each set picks its own l:
lengthening the prefix by one token adds that token's estimated partners to the scan, but a candidate must then share
one token more, which bounds how many candidates can be left; the l of the least estimated cost wins. A pair is a
candidate if its prefixes share at least the smaller of its two l, and candidates are verified on the whole sets.

Large groups of near copies share their prefix tokens and would make all pairs of the group candidates. The result
here is the linked groups (connected components), so pairs inside one group need no verification once the group is
known to hang together. Every bucket (sets that share a prefix token) names one hub, the member of smallest hash, and
every set is first compared with the hub that most of its tokens name; what links joins groups, and with new hubs this
goes on while it pays. Sets that were compared with one hub form a family, and their further pairs are found by what
differs from the family's most typical member: for a pair to be similar while one side is not linked to that, the
differences of the two must overlap by a known number of tokens, so a prefix filter over the (small) differences finds
and decides them. All
other pairs of different groups go through the multi-match join, each with at least one side outside the bucket's
largest family. No pair of sets that may link is left out: it is verified, or both sides are already in one group.

Equal sets are one class from the start, so exact copies cost one row each. The collision chance of 64-bit hashes
(about n*n / 2**65 for n distinct sets or n tokens of a pair) is accepted.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberwatch.llm.common import components, runs, slices, staged, table

WIDTH = 1 << 22      # cells of the token count table (4 bytes each)
CHUNKS = 16
MOST = 4             # largest l tried
PARTNERS = 0.05      # partners a token is thought to have at least: the table does not show rare ones
SCAN, VERIFY = 1.0, 8.0   # estimated cost of a shared posting, and of a verified candidate (plus its size / 16)
MERGES = 4           # rounds of merging families, at most; they only save candidates, so any number is right
BATCH = 1 << 20      # bytes hashed at once

_U = np.uint64
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_BYTE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), 0x9E3779B97F4A7C15, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word (run of bytes other than blank and control spaces) of lower-cased bytes."""
    arr = np.frombuffer(raw, np.uint8)
    at = np.flatnonzero(~_SPACE[arr])
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.concatenate([[True], np.diff(at) > 1])
    heads = np.flatnonzero(first)
    starts = at[heads]
    length = np.diff(np.concatenate([heads, [len(at)]]))
    place = np.arange(len(at)) - np.repeat(heads, length)
    sums = np.add.reduceat(_BYTE[arr[at]] * _powers(int(length.max()))[place], heads)
    return _mix(sums + length.astype(np.uint64)), starts


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct n-gram hashes of one document's word hashes, ascending."""
    if not len(words):
        return words
    n = min(n, len(words))
    h = np.full(len(words) - n + 1, n, np.uint64)
    for j in range(n):
        h = _mix(h * _U(0x9FB21C651E98DF25) + words[j:len(words) - n + 1 + j])
    return np.unique(h)


def shingle_sets(texts: list[str | None], n: int):
    """The n-gram set of every whole text, in order: ASCII letters lower-cased; with fewer words than n the whole
    sequence is one n-gram; no words, no n-grams."""
    raws = [(t or "").encode("utf-8", "replace").lower() for t in texts]
    for a, b in runs([len(r) for r in raws], BATCH):
        if b - a == 1 and len(raws[a]) > 2 * BATCH:  # a very long text: hash its words in pieces cut at blanks
            raw, at, parts = raws[a], 0, []
            while at < len(raw):
                end = at + BATCH
                while end < len(raw) and not _SPACE[raw[end]]:
                    end += 1
                parts.append(word_hashes(raw[at:end])[0])
                at = end
            yield _grams(np.concatenate(parts), n)
            continue
        words, starts = word_hashes(b"\n".join(raws[a:b]))
        ends = np.cumsum([len(r) + 1 for r in raws[a:b]])
        cuts = np.concatenate([[0], np.searchsorted(starts, ends)])
        for i in range(b - a):
            yield _grams(words[cuts[i]:cuts[i + 1]], n)


def set_hash(s: np.ndarray) -> int:
    """64-bit hash of a set of n-gram hashes."""
    h = np.array([_mix(s + _U(1)).sum(), np.bitwise_xor.reduce(_mix(s))], np.uint64)
    return int(_mix(h[:1] * _U(3) + h[1:] + _U(len(s))).view(np.int64)[0])


def _cells(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> _U(64 - WIDTH.bit_length() + 1)).astype(np.int64)


def _signed(h) -> np.ndarray:
    return np.asarray(h, np.uint64).view(np.int64)


def _summed(parts: DataFrame) -> np.ndarray:
    """Add up one table of WIDTH counts per task, in chunks and two steps (a group holds at most a 16th of the tables
    of one chunk, then 16). The result has WIDTH numbers whatever the input."""
    kind = "chunk int, part int, counts binary"

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(WIDTH // CHUNKS, np.uint64)
        for c in rows.column("counts"):
            total += np.frombuffer(zlib.decompress(c.as_py()), np.uint32)
        total = np.minimum(total, 0xFFFFFFFF).astype(np.uint32)
        return pa.table({"chunk": rows.column("chunk").slice(0, 1), "part": pa.array([0], pa.int32()),
                         "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    first = parts.groupBy("chunk", F.pmod("part", F.lit(16))).applyInArrow(lambda x: add(x), kind)
    got = {r.chunk: r.counts for r in first.groupBy("chunk").applyInArrow(lambda x: add(x), kind).collect()}
    empty = zlib.compress(np.zeros(WIDTH // CHUNKS, np.uint32).tobytes(), 1)
    return np.concatenate([np.frombuffer(zlib.decompress(got.get(c, empty)), np.uint32) for c in range(CHUNKS)])


def _table_of(batches, cells):
    """One row per chunk with how often each cell occurs in this task; `cells` gives arrays of cells of a batch."""
    total = np.zeros(WIDTH, np.uint32)
    for batch in batches:
        for at in cells(batch):
            np.add.at(total, at, 1)
    part = TaskContext.get().partitionId()
    yield pa.RecordBatch.from_arrays(
        [pa.array(range(CHUNKS), pa.int32()), pa.array([part] * CHUNKS, pa.int32()),
         pa.array([zlib.compress(x.tobytes(), 1) for x in np.split(total, CHUNKS)], pa.binary())], ["chunk", "part", "counts"])


def token_counts(docs: DataFrame, n: int) -> np.ndarray:
    """How many sets hold a token of each cell, over all documents."""
    def cells(batch):
        return (_cells(s) for part in slices(batch, 0) for s in shingle_sets(part.column(0).to_pylist(), n))

    return _summed(docs.select("text").mapInArrow(lambda b: _table_of(b, cells), "chunk int, part int, counts binary"))


def least_overlap(size: int, percent: int) -> int:
    """The least overlap of a set of this size with any set that is similar enough."""
    return -(-percent * size // 100)


def adaptive_prefix(tokens: np.ndarray, counts: np.ndarray, load: float, percent: int) -> tuple[int, np.ndarray]:
    """(l, l-prefix) of the least estimated cost. With P partners in all postings of the prefix, at most P / l sets
    can share l of its tokens."""
    size = len(tokens)
    need = least_overlap(size, percent)
    cell = counts[_cells(tokens)]
    order = np.lexsort((tokens, cell))[:size - need + MOST]
    partners = np.cumsum(np.maximum(cell[order].astype(float) - 1 - load, PARTNERS))
    best, level = None, 1
    for lv in range(1, min(MOST, need) + 1):
        p = partners[size - need + lv - 1]
        cost = SCAN * p + (VERIFY + size / 16) * p / lv
        if best is None or cost < best:
            best, level = cost, lv
    return level, tokens[order[:size - need + level]]


def prefixes(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, cls (hash of the set, null if empty), level, prefix of every document."""
    spark = docs.sparkSession
    counts = token_counts(docs, n)
    load = float(counts.sum(dtype=np.float64)) / WIDTH
    shared = spark.sparkContext.broadcast(counts)  # WIDTH numbers

    def rows(batches):
        for batch in (part for whole in batches for part in slices(whole, 1)):
            size, cls, level, prefix = [], [], [], []
            for s in shingle_sets(batch.column(1).to_pylist(), n):
                size.append(len(s))
                if not len(s):
                    cls.append(None)
                    level.append(0)
                    prefix.append([])
                    continue
                cls.append(set_hash(s))
                lv, p = adaptive_prefix(s, shared.value, load, percent)
                level.append(lv)
                prefix.append(_signed(p))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(cls, pa.int64()), pa.array(level, pa.int32()),
                 pa.array(prefix, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "cls", "level", "prefix"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        rows, f"doc_id {kind}, n_shingles long, cls long, level int, prefix array<long>")


def _cells_of(wanted: DataFrame):
    """Broadcast of WIDTH bits: the cells of the hashes in wanted's column `who`."""
    held = _summed(wanted.select("who").mapInArrow(
        lambda b: _table_of(b, lambda x: [x.column(0).to_numpy() % WIDTH]), "chunk int, part int, counts binary")) > 0
    return wanted.sparkSession.sparkContext.broadcast(np.packbits(held))


def _in_cells(batches, column: int, shared):
    """The rows whose hash in that column lies in one of the cells."""
    want = np.unpackbits(shared.value).astype(bool)
    for batch in batches:
        yield batch.filter(pa.array(want[batch.column(column).to_numpy() % WIDTH]))


def whole_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """cls, n-gram set and who (hash of the doc_id) of the documents whose doc_id is in `wanted`, made again from the
    texts: a fixed-size table of the wanted ids' cells picks the rows (a few more may come along, which `who` tells
    apart), so no text is shuffled."""
    who = F.xxhash64("doc_id").alias("who")
    shared = _cells_of(wanted.select(who))

    def rows(batches):
        for batch in (part for whole in _in_cells(batches, 0, shared) for part in slices(whole, 1)):
            cls, sets, ids = [], [], []
            for i, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist(), n), strict=True):
                if len(s):
                    cls.append(set_hash(s))
                    sets.append(s.tobytes())
                    ids.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(sets, pa.binary()), pa.array(ids, pa.int64())],
                                             ["cls", "grams", "who"])

    return docs.select(who, "text").mapInArrow(rows, "cls long, grams binary, who long")


def _named(pairs: DataFrame) -> DataFrame:
    """cls of every class in the pairs (a, b), once."""
    return pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()


def sets_in(pairs: DataFrame, sets: DataFrame, who: DataFrame) -> DataFrame:
    """The rows of `sets` that the pairs name, and perhaps a few more: a fixed-size table of cells picks them where they
    lie, so the others are not shuffled."""
    shared = _cells_of(who.join(_named(pairs), "cls"))
    return sets.select("cls", "grams", "who").mapInArrow(lambda b: _in_cells(b, 2, shared), "cls long, grams binary, who long")


def _with_sets(pairs: DataFrame, sets: DataFrame, who: DataFrame) -> DataFrame:
    """(a, b, ga, gb): pairs of classes with their whole sets, each taken from the one document that stands for the
    class (`who`: cls, who)."""
    for side in ("a", "b"):  # before the sets, which are wide
        pairs = pairs.join(who.select(F.col("cls").alias(side), F.col("who").alias(f"w{side}")), side)
    for side in ("a", "b"):
        grams = sets.select(F.col("cls").alias(side), F.col("who").alias(f"w{side}"), F.col("grams").alias(f"g{side}"))
        pairs = pairs.join(grams, [side, f"w{side}"])
    return pairs.select("a", "b", "ga", "gb")


def _sets_of(batch):
    for i in range(batch.num_rows):
        yield (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))


def verified(pairs: DataFrame, sets: DataFrame, who: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets are similar enough: 100 * intersection >= percent * union."""
    def check(batches):
        for batch in batches:
            ok = []
            for x, y in _sets_of(batch):
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return _with_sets(pairs, sets, who).mapInArrow(check, "a long, b long")


def compared_with_hub(pairs: DataFrame, sets: DataFrame, who: DataFrame, percent: int) -> DataFrame:
    """Pairs (a: hub, b: member) with: linked, size, hub_size and - for members that share at least a third - what differs
    from the hub: added and missing tokens (else null)."""
    def check(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for h, x in _sets_of(batch):
                added, gone = np.setdiff1d(x, h, assume_unique=True), np.setdiff1d(h, x, assume_unique=True)
                common = len(h) - len(gone)
                near = 3 * common >= max(len(h), len(x))
                row = (100 * common >= percent * (len(h) + len(added)), len(x), len(h),
                       _signed(added) if near else None, _signed(gone) if near else None)
                for col, v in zip(out, row, strict=True):
                    col.append(v)
            kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, out, kinds)],
                                             ["a", "b", "linked", "size", "hub_size", "added", "missing"])

    return _with_sets(pairs, sets, who).mapInArrow(
        check, "a long, b long, linked boolean, size long, hub_size long, added array<long>, missing array<long>").dropDuplicates(["a", "b"])


def _alike(a: str, b: str, percent: int):
    """The sizes leave room for enough overlap."""
    a, b = F.col(a), F.col(b)
    return (a * percent <= b * 100) & (b * percent <= a * 100)


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (cls, grp) after joining the groups that links (a, b) of classes connect."""
    la = labels.select(F.col("cls").alias("a"), F.col("grp").alias("ga"))
    lb = labels.select(F.col("cls").alias("b"), F.col("grp").alias("gb"))
    roots = components(links.join(la, "a").join(lb, "b").select(F.col("ga").alias("a"), F.col("gb").alias("b")))
    return staged(labels.join(roots.withColumnRenamed("node", "grp"), "grp", "left")
                  .select("cls", F.coalesce("root", "grp").alias("grp")), "labels")


def _hub_pairs(posts: DataFrame, percent: int) -> DataFrame:
    """Every set with the hub that most of its tokens name, if they share enough prefix tokens and the sizes allow a link
    (`percent` 0: whatever the sizes). A token's hub is its set of smallest hash; so where a set's best hub is in a
    bucket, it is the hub there or a smaller one is, and following hubs ends."""
    hub = F.min(F.struct(F.xxhash64("cls").alias("h"), F.col("cls").alias("a"), F.col("size").alias("na"), F.col("level").alias("la")))
    hubs = (posts.groupBy("token").agg(hub.alias("hub"), F.max("cls").alias("hi"), F.min("cls").alias("lo"))
            .where(F.col("lo") != F.col("hi")).select("token", "hub"))
    named = (posts.join(hubs, "token").where((F.col("hub.a") != F.col("cls")))
             .select("cls", "size", "level", "hub").where(_alike("hub.na", "size", percent))
             .groupBy("cls", "hub", "level").agg(F.count(F.lit(1)).alias("n"))
             .where(F.col("n") >= F.least("level", "hub.la")))
    best = named.groupBy("cls").agg(F.max(F.struct("n", F.col("hub.h").alias("h"), F.col("hub.a").alias("a"))).alias("best"))
    return best.select(F.col("best.a").alias("a"), F.col("cls").alias("b"))


def _followed(steps: DataFrame) -> DataFrame:
    """(cls, root) of steps (cls, root) that lead from each cls to another: the ends, by doubling the steps."""
    steps = staged(steps.select("cls", "root"), "steps")
    while True:
        ends = steps.select(F.col("cls").alias("root"), F.col("root").alias("far"))
        steps = staged(steps.join(ends, "root", "left").select("cls", F.coalesce("far", "root").alias("root"),
                                                              F.col("far").isNotNull().alias("moved")), "steps")
        if steps.where("moved").isEmpty():
            return steps.select("cls", "root")
        steps = steps.select("cls", "root")


def families(posts: DataFrame, tried: DataFrame, compare) -> DataFrame:
    """The differences of every member from the hub of its family, as compared_with_hub gives them. `tried`: every set
    with its own hub. Sets whose hubs are near each other belong to one family: hubs are followed to their ends, the
    ends that meet in a bucket are compared, and near ones followed on, a few rounds; then each set is compared with
    the hub it ended at. `compare` compares pairs (a, b) of sets among those in `tried`."""
    near = lambda t: t.where(F.col("added").isNotNull()).select(F.col("b").alias("cls"), F.col("a").alias("root"))
    active = tried.select(F.col("a").alias("cls")).union(tried.select(F.col("b").alias("cls"))).distinct()
    ends = _followed(near(tried))
    fam = staged(active.join(ends, "cls", "left").select("cls", F.coalesce("root", "cls").alias("root")), "ends")
    seen = tried.select("a", "b")
    for _ in range(MERGES):
        here = posts.select("token", "cls").join(fam, "cls").select("token", F.col("root").alias("cls"), F.lit(1).alias("size"), F.lit(1).alias("level")).distinct()
        pairs = staged(_hub_pairs(here, 0).join(seen, ["a", "b"], "left_anti"), "end-pairs")
        if pairs.isEmpty():
            break
        steps = staged(compare(pairs), "ends-compared")
        seen = seen.union(pairs)
        if steps.where(F.col("added").isNotNull()).isEmpty():
            break
        further = _followed(near(steps)).select(F.col("cls").alias("root"), F.col("root").alias("far"))
        fam = staged(fam.join(further, "root", "left").select("cls", F.coalesce("far", "root").alias("root")), "ends")
    own = fam.where(F.col("cls") != F.col("root")).select(F.col("root").alias("a"), F.col("cls").alias("b"))
    direct = tried.join(own, ["a", "b"], "left_semi")
    other = staged(own.join(tried.select("a", "b"), ["a", "b"], "left_anti"), "family-pairs")
    return staged(direct.unionByName(compare(other)), "families")


def _rest_pairs(posts: DataFrame, percent: int) -> DataFrame:
    """All candidates of different groups and families by the multi-match rule. In a bucket, sets outside its largest
    family meet all others; two sets of that family are not compared here."""
    kinds = posts.groupBy("token", "fam").agg(F.count(F.lit(1)).alias("n"))
    major = (kinds.groupBy("token").agg(F.max(F.struct("n", "fam")).alias("top"), F.count(F.lit(1)).alias("fams"))
             .where(F.col("fams") > 1).select("token", F.col("top.fam").alias("major")))
    mixed = posts.join(major, "token")
    few = mixed.where(F.col("fam") != F.col("major")).select("token", *[F.col(c).alias(f"{c}1") for c in ("cls", "size", "level", "grp", "fam")])
    pairs = few.join(mixed, "token").where(
        (F.col("grp1") != F.col("grp")) & (F.col("fam1") != F.col("fam")) & _alike("size1", "size", percent)
        # two outsiders meet in both orders: keep one
        & ((F.col("fam") == F.col("major")) | (F.col("cls1") < F.col("cls"))))
    return (pairs.select(F.least("cls1", "cls").alias("a"), F.greatest("cls1", "cls").alias("b"), F.least("level1", "level").alias("level"))
            .groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.min("level").alias("level"))
            .where(F.col("shared") >= F.col("level")).select("a", "b"))


def _tokens_of(members: DataFrame) -> DataFrame:
    """fam, cls, kind (0 added, 1 missing), tok of every difference."""
    one = lambda c, k: F.transform(c, lambda t: F.struct(F.lit(k).alias("kind"), t.alias("tok")))
    return members.select("fam", "cls", F.explode(F.concat(one("added", 0), one("missing", 1))).alias("t")).select(
        "fam", "cls", "t.kind", "t.tok")


def centred(tried: DataFrame, percent: int) -> DataFrame:
    """Families around their most typical member. `tried`: members compared with a hub. What more than half of a family
    has or lacks against its hub tells what is typical; the member that differs least from that is the centre, and all
    differences are turned to it. Returns fam, cls, linked (to the centre), centre, size, centre_size, gone, added,
    missing and need: the tokens that a member's differences share at least with those of a similar member that is - or
    if it itself is - not linked to the centre."""
    none = F.array().cast("array<long>")
    near = tried.where(F.col("added").isNotNull()).select(F.col("a").alias("fam"), F.col("b").alias("cls"), "size", "added", "missing")
    hubs = tried.where(F.col("added").isNotNull()).select(F.col("a").alias("fam"), F.col("hub_size").alias("size")).distinct()
    m = near.unionByName(hubs.select("fam", F.col("fam").alias("cls"), "size", none.alias("added"), none.alias("missing")))
    tokens = _tokens_of(m)
    typical = (tokens.groupBy("fam", "kind", "tok").agg(F.count(F.lit(1)).alias("n"))
               .join(m.groupBy("fam").agg(F.count(F.lit(1)).alias("of")), "fam").where(F.col("n") * 2 > F.col("of")).select("fam", "kind", "tok"))
    hits = tokens.join(typical, ["fam", "kind", "tok"]).groupBy("fam", "cls").agg(F.count(F.lit(1)).alias("hits"))
    far = F.size("added") + F.size("missing") - F.coalesce("hits", F.lit(0)) * 2
    centre = (m.join(hits, ["fam", "cls"], "left").groupBy("fam").agg(F.min(F.struct(far.alias("far"), F.col("cls").alias("centre"))).alias("c"))
              .select("fam", F.col("c.centre").alias("centre")))
    centre = centre.join(m.select("fam", F.col("cls").alias("centre"), F.col("size").alias("centre_size"),
                                  F.col("added").alias("added0"), F.col("missing").alias("missing0")), ["fam", "centre"])
    turned = m.join(centre, "fam").select(
        "fam", "cls", "centre", "size", "centre_size",
        F.concat(F.array_except("added", "added0"), F.array_except("missing0", "missing")).alias("added"),
        F.concat(F.array_except("missing", "missing0"), F.array_except("added0", "added")).alias("missing"))
    gone = F.size("missing").cast("long")
    # similar sets x, y share p(|x| + |y|)/(100 + p) tokens or more, and |c| - gone(x) - gone(y) + the overlap of their
    # differences is what they share; y not linked to the centre c bounds y's part from below (strictly)
    need = F.greatest(F.lit(1).cast("long"), F.floor(
        ((F.col("size") - F.col("centre_size")) * percent + gone * (100 + percent)) / F.lit(float(100 + percent)) + 1e-9).cast("long") + 1)
    linked = (F.col("centre_size") - gone) * (100 + percent) >= (F.col("size") + F.col("centre_size")) * percent
    return turned.select("*", gone.alias("gone"), need.alias("need"), linked.alias("linked"))


def _family_links(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) inside families, found and decided on the members' differences from the centre. `members`: those of
    `centred` with their groups (grp)."""
    m = members.withColumn("width", F.size("added").cast("long") + F.col("gone"))
    tokens = _tokens_of(m)
    often = tokens.groupBy("fam", "kind", "tok").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    facts = m.select("fam", "cls", "grp", "linked", "size", "gone", "centre_size", "width", "need")
    # one order for all of a family, rare first: a member's tokens that no other has stand before these
    mine = Window.partitionBy("fam", "cls")
    alone = F.col("width") - F.count(F.lit(1)).over(mine)
    spots = tokens.join(often, ["fam", "kind", "tok"]).join(facts, ["fam", "cls"]).withColumn(
        "pos", alone + F.row_number().over(mine.orderBy("n", "kind", "tok")) - 1)
    spots = spots.withColumn("early", F.col("pos") < F.col("width") - F.col("need") + 1).where(F.col("early") | ~F.col("linked"))
    # least overlap of two differences: ceil(p * (|x| + |y|) / (100 + p)) - |c| + gone(x) + gone(y)
    far = spots.where(~F.col("linked")).select("fam", "kind", "tok", *[F.col(c).alias(f"{c}1") for c in ("cls", "grp", "size", "gone", "width", "early")])
    enough = (F.ceil((F.col("size1") + F.col("size")) * percent / F.lit(float(100 + percent)) - 1e-9) - F.col("centre_size")
              + F.col("gone1") + F.col("gone"))
    pairs = far.join(spots, ["fam", "kind", "tok"]).where(
        (F.col("grp1") != F.col("grp")) & (F.least("width1", "width") >= enough)
        & F.when(F.col("linked"), F.col("early")).otherwise(F.col("early") & F.col("early1") & (F.col("cls1") < F.col("cls"))))
    pairs = pairs.select("fam", F.col("cls1").alias("a"), F.col("cls").alias("b")).distinct()
    side = lambda k: m.select("fam", F.col("cls").alias(k), "centre_size", *[F.col(c).alias(f"{c}_{k}") for c in ("size", "gone", "added", "missing")])
    both = pairs.join(side("a"), ["fam", "a"]).join(side("b").drop("centre_size"), ["fam", "b"])
    common = (F.col("centre_size") - F.col("gone_a") - F.col("gone_b")
              + F.size(F.array_intersect("added_a", "added_b")) + F.size(F.array_intersect("missing_a", "missing_b")))
    return both.where(common * (100 + percent) >= (F.col("size_a") + F.col("size_b")) * percent).select("a", "b")


def grouped(docs: DataFrame, every: DataFrame, classes: DataFrame, posts: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id of the documents `every` (doc_id, n_shingles, cls). Two classes of equal sets
    are candidates if they share at least the smaller of their levels of posted tokens; links are confirmed on the whole
    sets. `classes`: cls, size, level, rep (smallest doc_id); `posts`: token, cls, size, level of the tokens that several
    classes have."""
    labels = posts.select("cls", F.col("cls").alias("grp")).distinct()
    doc_of = classes.select("cls", F.col("rep").alias("doc_id"))
    who = doc_of.select("cls", F.xxhash64("doc_id").alias("who"))

    def sets_for(pairs: DataFrame) -> DataFrame:
        return whole_sets(docs, doc_of.join(_named(pairs), "cls").select("doc_id"), n)

    pairs = staged(_hub_pairs(posts, percent), "hub-pairs")
    fam = posts.select("cls").distinct().withColumn("fam", F.col("cls"))
    if not pairs.isEmpty():
        sets = staged(sets_for(pairs), "sets")
        tried = staged(compared_with_hub(pairs, sets, who, percent), "compared")
        compared = families(posts, tried, lambda p: compared_with_hub(p, sets_in(p, sets, who), who, percent))
        members = staged(centred(compared, percent), "members")
        star = members.withColumn("grp", F.when(F.col("linked"), F.col("centre")).otherwise(F.col("cls")))
        links = (tried.where("linked").select("a", "b").union(compared.where("linked").select("a", "b"))
                 .union(members.where("linked").select(F.col("centre").alias("a"), F.col("cls").alias("b")))
                 .union(_family_links(star, percent)))
        labels = _relabelled(labels, staged(links, "family-links"))
        fam = fam.join(members.select("cls", F.col("fam").alias("own")), "cls", "left").select("cls", F.coalesce("own", "cls").alias("fam"))
    rest = staged(_rest_pairs(posts.join(labels, "cls").join(fam, "cls"), percent), "rest-pairs")
    if not rest.isEmpty():
        labels = _relabelled(labels, verified(rest, staged(sets_for(rest), "sets"), who, percent))

    grouped = classes.select("cls", "rep").join(labels, "cls", "left").select("cls", "rep", F.coalesce("grp", "cls").alias("grp"))
    smallest = grouped.groupBy("grp").agg(F.min("rep").alias("component_id"))
    ids = grouped.join(smallest, "grp").select("cls", "component_id")
    return every.select("doc_id", "n_shingles", "cls").join(ids, "cls", "left").select(
        "doc_id", "n_shingles", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def linked_groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Link documents whose sets of distinct word n-grams have 100 * intersection >= percent * union.

    Returns doc_id, n_shingles (size of the set) and component_id: the smallest doc_id reachable by links, itself
    included. ASCII letters are lower-cased; words are runs of anything but blanks and control spaces; with fewer
    words than n the whole sequence is one n-gram. Documents without words, or null texts, have 0 n-grams and are
    linked with nothing. Null doc_ids are never the smallest (a group of nothing else has a null component_id).
    Repeated rows are returned each; other columns are ignored; an empty table gives no rows."""
    every = staged(prefixes(docs, n, percent), "prefixes")
    full = every.where(F.col("cls").isNotNull())  # a set's hash decides its size, level and prefix
    classes = staged(full.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("size"), F.max("level").alias("level")), "classes")
    single = full.select("cls", "prefix").dropDuplicates(["cls"]).select("cls", F.explode("prefix").alias("token"))
    several = single.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("token"))).where(F.col("m") > 1).drop("m")
    posts = staged(several.join(classes.select("cls", "size", "level"), "cls").select("cls", "token", "size", "level"), "postings")
    return grouped(docs, every.select("doc_id", "n_shingles", "cls"), classes, posts, n, percent)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_groups(table(spark, sf_dir, "documents"), n=4, percent=85)
