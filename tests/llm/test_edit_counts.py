import random

from emberwatch.llm import tokens
from emberwatch.llm.edit_counts import CountTree, apply_edits, build_trees, cleaning_edits

PATHS = tokens.default_paths()


def count(text):
    return tokens.count(text, PATHS)


def test_tree_equals_a_full_count_after_every_edit():
    rng = random.Random(5)
    base = [" ".join(rng.choice(["the", "Wörter", "x1", "don't", "...", "\n\n", "  ", "日本"]) for _ in range(n)) for n in (0, 1, 40, 900)]
    for text in [*base, "x" * 4000, " " * 3000, "a\n" * 2000]:
        tree = CountTree.of(text, count)
        for _ in range(25):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.choice([0, 0, 1, 2, 40, 900]))
            new = rng.choice(["", " ", "  ", "'s", " a", "a ", "\n", "word", " many new words" * rng.choice([1, 600])])
            text = text[:a] + new + text[b:]
            tree.edit(a, b, new)
            assert "".join(tree.parts) == text and tree.total == count(text) == sum(tree.counts)


def test_only_the_region_of_an_edit_is_encoded():
    text = "some plain words " * 20000
    tree = CountTree.of(text, count)
    tree.encoded = 0
    tree.edit(170_000, 170_004, "another")
    assert 0 < tree.encoded < 3000 and tree.total == count(text[:170_000] + "another" + text[170_004:])


def test_positions_outside_the_text():
    tree = CountTree.of("abc", count)
    tree.edit(10, 20, "d")
    tree.edit(-5, 0, "_")
    assert "".join(tree.parts) == "_abcd" and tree.total == count("_abcd")


def test_frames(spark, edge_docs, no_docs):
    trees = build_trees(edge_docs)
    rows = trees.collect()
    assert len(rows) == edge_docs.count()
    texts = {r.doc_id: r.text or "" for r in edge_docs.collect()}
    assert all(r.n_tokens == count(texts[r.doc_id]) == sum(r.counts) and "".join(r.segments) == texts[r.doc_id] for r in rows)
    edits = spark.createDataFrame([(r.doc_id, r.segments, r.counts, [(0, 0, "Title\n"), (2, 4, None)] if r.doc_id != 4 else None, 1)
                                   for r in rows], "doc_id long, segments array<string>, counts array<int>, "
                                                   "edits array<struct<start:long,end:long,replacement:string>>, n_tokens int")
    for r in apply_edits(edits).collect():
        text = texts[r.doc_id]
        if r.doc_id != 4:
            text = "Title\n" + text
            text = text[:2] + text[4:]
        assert "".join(r.segments) == text and r.n_tokens == count(text) and r.n_edits == (0 if r.doc_id == 4 else 2)
    assert apply_edits(build_trees(no_docs), cleaning_edits).count() == 0


def test_cleaning_edits():
    text = "Mail a.b@c.org now\nsame line\nother\nsame line\n\n\ncall +1 (555) 123-4567"
    for a, b, new in cleaning_edits(text):
        text = text[:a] + new + text[b:]
    assert text == "Mail [redacted] now\nsame line\nother\n\n\ncall [redacted]"


def test_personal_spans_equal_the_plain_pattern_and_take_linear_time():
    import random
    import re
    import time

    from emberwatch.llm.edit_counts import personal_spans

    plain = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|\+?\d[\d ().-]{6,}\d|AKIA[0-9A-Z]{16}")
    rng = random.Random(5)
    parts = ["a", "b.c", "@", "@x.y", "12 345 678", "+49 (30) 123-45", " ", "-", "AKIA" + "A1" * 8, "9", "\n", "ü", "(1) 234 567", "."]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert list(personal_spans(text)) == [m.span() for m in plain.finditer(text)], text
    for text in ("x" * 5_000_000, "a@" + "b-" * 1_000_000, "12345678-a" * 200_000, "1" + " " * 2_000_000):
        start = time.time()
        list(personal_spans(text))
        assert time.time() - start < 10
