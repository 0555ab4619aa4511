import bisect
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from emberwatch.llm.packing import dearest_pattern, pack, plan_of, solve, token_pieces
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer


def best_fit_decreasing(lengths, capacity):
    rooms, n = [], 0
    for s in sorted(lengths, reverse=True):
        j = bisect.bisect_left(rooms, s)
        if j == len(rooms):
            n, room = n + 1, capacity - s
        else:
            room = rooms.pop(j) - s
        bisect.insort(rooms, room)
    return n


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), min_size=1, max_size=12))
def test_patterns_use_up_the_histogram(histogram):
    patterns = solve(histogram, 40)
    used = Counter()
    for items, n in patterns:
        assert sum(items) <= 40 and n > 0
        for s in items:
            used[s] += n
    assert used == Counter(histogram)
    lengths = list(Counter(histogram).elements())
    assert sum(n for _, n in patterns) <= 1.12 * best_fit_decreasing(lengths, 40) + 2


def test_near_the_bound_on_many_pieces():
    rng = np.random.default_rng(4)
    lengths = np.minimum(2048, rng.lognormal(6, 1, 20000).astype(int) + 1).tolist()
    used = sum(n for _, n in solve(dict(Counter(lengths)), 2048))
    assert used <= -(-sum(lengths) // 2048) * 1.01


def test_knapsack_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(20):
        sizes, prices, most = rng.integers(1, 9, 4), rng.random(4), rng.integers(0, 4, 4)
        got = dearest_pattern(sizes, prices, most, 15)
        assert all(k <= most[i] for i, k in got.items()) and sum(sizes[i] * k for i, k in got.items()) <= 15
        best = max(np.dot(prices, c) for c in np.ndindex(*(most + 1)) if np.dot(sizes, c) <= 15)
        assert abs(sum(prices[i] * k for i, k in got.items()) - best) < 1e-9


def test_empty_plan():
    assert solve({}, 8) == [] and plan_of([]).sequences == 0


def test_pieces_and_places_of_edge_texts(spark, edge_docs, no_docs):
    docs = edge_docs.unionByName(spark.createDataFrame(
        [(20, "a<|endoftext|>b", None, "s", 0, 7, "x", 1.5, -1), (21, "tab\t" * 3000, None, "s", 0, 7, "x", 1.5, -1)], edge_docs.schema))
    pieces = token_pieces(docs, capacity=64)
    rows = pack(pieces.drop("ids"), capacity=64).collect()
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter()
    for r in docs.collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        head = len(ids) % 64 or 64
        cuts = [0, *range(head, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[r.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for v in places.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 64
    assert pack(token_pieces(no_docs)).count() == 0
    one = token_pieces(docs, capacity=64).where("doc_id = 8").first()
    assert one.ids[-1] == 0 and len(one.ids) == one.length
    with pytest.raises(ValueError):
        pack(pieces.drop("ids"), capacity=32)
