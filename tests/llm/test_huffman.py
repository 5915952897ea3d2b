import heapq

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import bpe, huffman
from loomgraph.llm.queries import VOCABULARY


def plain_cost(counts):
    heap = [c for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    return cost


def limited_cost(counts, limit):
    """The least cost of lengths 1..limit under Kraft's inequality, by dynamic programming."""
    order = sorted((c for c in counts if c), reverse=True)
    best = {(0, 1): 0}  # symbols done, nodes free on this level
    answer = None
    for _ in range(limit):
        after = {}
        for (done, free), cost in best.items():
            nodes = min(2 * free, len(order) - done)
            for leaves in range(nodes + 1):
                c = cost + sum(order[done:])  # every symbol left goes a level deeper
                key = (done + leaves, nodes - leaves)
                if key[0] == len(order):
                    answer = c if answer is None else min(answer, c)
                elif key[1] and c < after.get(key, 1 << 60):
                    after[key] = c
        best = after
    return answer


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 200), min_size=2, max_size=9), st.integers(4, 6))
def test_lengths_are_optimal(counts, limit):
    used = sum(c > 0 for c in counts)
    lengths = huffman.code_lengths(np.array(counts), limit)
    assert ((lengths > 0) == (np.array(counts) > 0)).all() and lengths.max() <= limit
    if used > 1:
        assert sum(2.0 ** -int(n) for n in lengths if n) <= 1
        assert int((lengths * np.array(counts)).sum()) == limited_cost(counts, limit)
        assert int((huffman.code_lengths(np.array(counts), 20) * np.array(counts)).sum()) == plain_cost(counts)


def test_blocks_of_any_size():
    rng = np.random.default_rng(1)
    counts = (rng.pareto(0.5, 3000) * 10).astype(np.int64)
    book = huffman.Book.of(huffman.code_lengths(counts))
    used = np.flatnonzero(counts)
    sizes = np.array([0, 1, 5000, 0, 1024, 1025, 7])
    ids = rng.choice(used, sizes.sum())
    payloads, checkpoints, bits = book.encode(ids, sizes)
    assert (book.decode(payloads, checkpoints, sizes) == ids).all()
    text = "".join(format(int(book.codes[i]), f"0{book.lengths[i]}b") for i in ids[1:5001])
    assert bits[2] == len(text) and payloads[2] == int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")
    # Decoding can begin at a checkpoint.
    tail = book.decode([payloads[2]], [checkpoints[2][3:]], np.array([5000 - 3 * huffman.EVERY]))
    assert (tail == ids[1 + 3 * huffman.EVERY : 5001]).all()
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(20, np.int64), 4)


def test_documents(spark):
    long = "many words of one text, " * 30_000
    texts = {1: None, 2: "", None: "hello", 4: long, 5: "again", 6: "élan ñ 中"}
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(5, "again", "y")], "doc_id bigint, text string, block string")
    tokens, size = huffman.token_table(docs, VOCABULARY)
    blocks, book = huffman.compress(tokens, size)
    rows = blocks.collect()
    assert all(r.round_trip for r in rows if r.payload is not None)
    back = {}
    for r in huffman.decompress(blocks, book).orderBy("block").collect():
        if r.doc_id != 5:
            back[r.doc_id] = None if r.token_ids is None else back.get(r.doc_id, []) + r.token_ids
    want = {r.doc_id: r.token_ids for r in bpe.encode(docs, VOCABULARY).collect() if r.doc_id != 5}
    assert back == want
    assert sum(r.doc_id == 5 for r in rows) == 2 and sum(r.doc_id == 4 for r in rows) > 1
    assert huffman.encode_documents(docs.limit(0), VOCABULARY).count() == 0
    assert huffman.encode_documents(docs.where("text IS NULL OR text = ''"), VOCABULARY).count() == 2
