"""Token counts that follow edits.

A document keeps a tree over segments of its text. Segments are cut only where a pre-token must begin (a blank between
two non-blanks), so their token counts add up to the document's; the tree holds the sums of characters and tokens
below every node. An edit finds its segments by descending the character sums, re-encodes those and one neighbour on
either side - with it the cuts at both ends of the region lie in unchanged text and stay valid - and updates the sums
on the paths above. Everything else keeps its counts.

Trees are built and edited row by row inside Arrow batches: no shuffle, and a row's memory is a few times its text.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from emberwatch.llm import tokens
from emberwatch.llm.common import slices, table

SEGMENT = 512        # characters of a segment, up to the next safe cut
WIDEST = 8           # a segment that grew to so many times SEGMENT makes the tree be laid out anew


class CountTree:
    """Sums of (characters, tokens) over the segments of a text; `count` gives the tokens of a segment."""

    def __init__(self, parts: list[str], counts: list[int], count):
        self._count = count
        self.encoded = 0  # characters encoded since the tree was made
        self._lay(parts, counts)

    @classmethod
    def of(cls, text: str, count) -> CountTree:
        parts = tokens.pieces_of(text, SEGMENT)
        tree = cls(parts, [count(p) for p in parts], count)
        tree.encoded = len(text)
        return tree

    def _lay(self, parts: list[str], counts: list[int]) -> None:
        self.parts = parts
        self.base = 1 << max(0, len(parts) - 1).bit_length()
        self.chars, self.ids = [0] * (2 * self.base), [0] * (2 * self.base)
        self.chars[self.base:self.base + len(parts)] = map(len, parts)
        self.ids[self.base:self.base + len(parts)] = counts
        for node in range(self.base - 1, 0, -1):
            self._add_up(node)

    def _add_up(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.ids[node] = self.ids[2 * node] + self.ids[2 * node + 1]

    @property
    def total(self) -> int:
        return self.ids[1]

    @property
    def counts(self) -> list[int]:
        return self.ids[self.base:self.base + len(self.parts)]

    def _segment_at(self, position: int) -> tuple[int, int]:
        """Segment that holds a character position (the last one for the end of the text), and its start."""
        node, start = 1, 0
        while node < self.base:
            node *= 2
            if position >= start + self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return node - self.base, start

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replace text[start:end]; positions outside the text are moved to its ends."""
        size = self.chars[1]
        start = min(max(start, 0), size)
        end = min(max(end, start), size)
        first, at = self._segment_at(start)
        last, _ = self._segment_at(max(start, end - 1))
        for step in (-1, 1):  # one neighbour of two characters or more on either side, unless the text ends
            k = first if step < 0 else last
            while 0 <= k + step < len(self.parts):
                k += step
                if len(self.parts[k]) > 1:
                    break
            if step < 0:
                at -= sum(map(len, self.parts[k:first]))
                first = k
            else:
                last = k
        old = "".join(self.parts[first:last + 1])
        new = tokens.pieces_of(old[:start - at] + replacement + old[end - at:], SEGMENT)
        slots = last + 1 - first
        if len(new) > slots * WIDEST:  # too much for these slots: lay the tree out anew, keeping the other counts
            counts = self.counts
            self.encoded += sum(map(len, new))
            self._lay([*self.parts[:first], *new, *self.parts[last + 1:]],
                      [*counts[:first], *map(self._count, new), *counts[last + 1:]])
            return
        share = -(-len(new) // slots)
        for k in range(slots):
            text = "".join(new[k * share:(k + 1) * share])
            self.parts[first + k] = text
            node = self.base + first + k
            if text != "" or self.chars[node]:
                self.chars[node], self.ids[node] = len(text), self._count(text)
                self.encoded += len(text)
        touched = {(self.base + first + k) // 2 for k in range(slots)} - {0}
        while touched:
            for node in touched:
                self._add_up(node)
            touched = {node // 2 for node in touched} - {0}


TREE = T.StructType([T.StructField("segments", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.IntegerType()))])
EDIT = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("replacement", T.StringType())])


def build_trees(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, segments and their token counts (the leaves of the tree), n_tokens of every whole text. A null or empty
    text is one empty segment; a special token's string counts as ordinary text; repeated rows each get a tree."""
    paths = paths or tokens.default_paths()
    schema = T.StructType([docs.schema["doc_id"], *TREE, T.StructField("n_tokens", T.LongType())])

    def rows(batches):
        from emberwatch.llm.tokens import count

        for batch in (part for whole in batches for part in slices(whole, 1)):
            trees = [CountTree.of(t or "", lambda s: count(s, paths)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([t.parts for t in trees], pa.list_(pa.string())),
                 pa.array([t.counts for t in trees], pa.list_(pa.int32())), pa.array([t.total for t in trees], pa.int64())],
                schema.names)

    return docs.select("doc_id", "text").mapInArrow(rows, schema)


def apply_edits(trees: DataFrame, edits_of=None, paths: tuple[str, str] | None = None) -> DataFrame:
    """Edit trees (doc_id, segments, counts) in place.

    Edits come from a column `edits` - an array of (start, end, replacement), in the order they are made, each in the
    positions of the text as it then stands - or from `edits_of`, a function of the text. Returns doc_id, segments,
    counts, n_before, n_tokens, n_edits, n_chars (before), n_encoded (characters encoded for the edits). No edits, or a
    null list, leave the tree as it is; null positions and replacements count as 0 and ''."""
    paths = paths or tokens.default_paths()
    numbers = ["n_before", "n_tokens", "n_edits", "n_chars", "n_encoded"]
    schema = T.StructType([trees.schema["doc_id"], *TREE, *[T.StructField(n, T.LongType()) for n in numbers]])
    cols = ["doc_id", "segments", "counts", *([] if edits_of else ["edits"])]

    def rows(batches):
        from emberwatch.llm.tokens import count

        for batch in (whole.slice(a, 256) for whole in batches for a in range(0, whole.num_rows, 256)):
            lists = batch.column(3).to_pylist() if not edits_of else [None] * batch.num_rows
            out: list[list] = [[] for _ in range(len(numbers) + 2)]
            for parts, counts, edits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), lists, strict=True):
                tree = CountTree(list(parts), counts, lambda s: count(s, paths))
                if edits_of:
                    edits = [dict(zip(("start", "end", "replacement"), e, strict=True)) for e in edits_of("".join(parts))]
                before, size = tree.total, tree.chars[1]
                for e in edits or ():
                    tree.edit(e["start"] or 0, e["end"] or 0, e["replacement"] or "")
                for col, v in zip(out, (tree.parts, tree.counts, before, tree.total, len(edits or ()), size, tree.encoded), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out[0], pa.list_(pa.string())), pa.array(out[1], pa.list_(pa.int32())),
                 *[pa.array(c, pa.int64()) for c in out[2:]]], schema.names)

    return trees.select(*cols).mapInArrow(rows, schema)


_RUN = re.compile(r"[\w.+-]+")
_DOMAIN = re.compile(r"[\w-]++(?:\.[\w-]++)+")
_MAIL = re.compile(r"(?<![\w.+-])[\w.+-]++@[\w-]++(?:\.[\w-]++)+")  # a run is entered at its start only: linear
_NUMBER = re.compile(r"\+?\d[\d ().-]{6,}\d|AKIA[0-9A-Z]{16}")


def personal_spans(text: str):
    """Spans of mail addresses, phone numbers and access keys, from left to right without overlap; where two begin at one
    place the address wins. The work is linear in the text, whatever its unbroken runs."""
    pos, run_end = 0, 0
    mail, number = _MAIL.search(text), _NUMBER.search(text)
    while True:
        if number is not None and number.start() < pos:
            number = _NUMBER.search(text, pos)
        if mail is not None and mail.start() < pos:
            mail = _MAIL.search(text, pos)
        first = None if mail is None else mail.span()
        if pos:  # a number may have ended inside a run, which then goes on here
            if pos >= run_end:
                rest = _RUN.match(text, pos)
                run_end = rest.end() if rest else pos
            if run_end > pos and text.startswith("@", run_end):
                domain = _DOMAIN.match(text, run_end + 1)
                if domain:
                    first = pos, domain.end()
        if number is not None and (first is None or number.start() < first[0]):
            first = number.span()
        if first is None:
            return
        yield first
        pos = first[1]


def cleaning_edits(text: str) -> list[tuple[int, int, str]]:
    """The edits of a usual cleaning pass, from the end of the text to its start: personal data and keys become a tag,
    lines that repeat an earlier line of the text go."""
    edits = [(a, b, "[redacted]") for a, b in personal_spans(text)]
    seen, at, gone = set(), 0, []
    for line in text.split("\n"):
        end = at + len(line)
        if line.strip():
            if line in seen:
                gone.append((max(0, at - 1), end, ""))
            seen.add(line)
        at = end + 1
    if gone:  # a tag never reaches over a line that goes, as neither kind of match holds part of the other's line break
        starts = [a for a, _, _ in gone]

        def inside(e) -> bool:
            k = bisect_right(starts, e[0]) - 1
            return k >= 0 and e[1] <= gone[k][1]

        edits = [e for e in edits if not inside(e)]
    return sorted(edits + gone, reverse=True)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document before and after the cleaning pass."""
    trees = build_trees(table(spark, sf_dir, "documents"))
    return apply_edits(trees, cleaning_edits).drop("segments", "counts")
