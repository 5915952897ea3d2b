import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import bpe, huffman
from loomgraph.llm.queries import TOKENIZERS, VOCABULARY
from loomgraph.llm.tokencount import count_piece, load_ranks, token_counts

PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TEXTS = ["", "a", "Hello world's end, they're  here\n\n  indented\t!", "élève ñandú 中文字符 🙂🙂  x", "it's'll''ve 12345 6.7", " " * 50, "\n", "'", "a'", "x 's"]


@pytest.fixture(scope="module")
def public():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=load_ranks(VOCABULARY), special_tokens={})


def test_matches_a_public_encoder(spark, public):
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choices("abcdeé '\n1.9AB-", k=rng.randint(1, 400))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    rows = bpe.encode_and_check(docs, VOCABULARY).collect()
    assert len(rows) == len(texts)
    counts = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts(docs, VOCABULARY).collect()}
    for r in rows:
        assert r.token_ids == public.encode_ordinary(texts[r.doc_id])
        assert r.round_trip and r.n_tokens == len(r.token_ids)
        assert counts[r.doc_id] == (len(texts[r.doc_id].encode()), r.n_tokens)
    back = bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY)
    assert {r.doc_id: r.text for r in back.collect()} == dict(enumerate(texts))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aeiouthnsrd", min_size=1, max_size=300))
def test_pieces_by_brute_force(text):
    ranks = load_ranks(VOCABULARY)
    parts = [bytes([b]) for b in text.encode()]
    while pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]:
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    want = [ranks[p] for p in parts]
    token, sizes = bpe.coder(VOCABULARY).contract([text.encode(), b"x"])
    assert token.tolist()[:-1] == want and sizes.tolist() == [len(want), 1]
    assert bpe.merge_long(text.encode(), ranks) == want
    assert count_piece(text.encode(), ranks) == len(want)


def test_odd_rows(spark, public):
    long = "abcde" * 40_000 + " tail" + " word" * 300_000
    rows = [(1, None, 9), (2, "", 9), (None, "hello", 9), (4, long, 9), (5, "hello", 9), (5, "hello", 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, token_ids int")
    got = {r.doc_id: r for r in bpe.encode_and_check(docs, VOCABULARY).collect()}
    assert got[1].token_ids is None and got[1].round_trip is None and got[2].token_ids == []
    assert got[4].round_trip and got[4].token_ids == public.encode_ordinary(long)
    assert bpe.encode(docs, VOCABULARY).where("doc_id = 5").count() == 2
    counts = {r.doc_id: r.n_tokens for r in token_counts(docs, VOCABULARY).collect()}
    assert counts == {1: None, 2: 0, None: 1, 4: len(got[4].token_ids), 5: 1}
    assert bpe.encode_and_check(docs.limit(0), VOCABULARY).count() == 0
    assert token_counts(docs.limit(0), VOCABULARY).count() == 0
    assert TOKENIZERS in VOCABULARY


def twins(n):
    """Two words of n letters, each other's complement, that a polynomial hash modulo a power of two confuses."""
    one = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("text", ["a" * 300, "漢" * 100, "今天的天气很好" * 50, "x" * 257, "漢" * 3000, "ab" * 1024])
def test_one_long_piece_alone(spark, public, text):
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    (row,) = bpe.encode_and_check(docs, VOCABULARY).collect()
    assert row.token_ids == public.encode_ordinary(text) and row.round_trip
    assert token_counts(docs, VOCABULARY).first().n_tokens == len(row.token_ids)
    assert huffman.encode_documents(docs, VOCABULARY).first().round_trip


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_of_a_regular_build_stay_apart(spark, public, n):
    docs = spark.createDataFrame(list(enumerate(["x y", *twins(n), " ".join(twins(n))])), "doc_id bigint, text string").coalesce(1)
    want = [public.encode_ordinary(r.text) for r in docs.collect()]
    rows = sorted(bpe.encode_and_check(docs, VOCABULARY).collect())
    assert [r.token_ids for r in rows] == want and all(r.round_trip for r in rows)
    assert [r.n_tokens for r in sorted(token_counts(docs, VOCABULARY).collect())] == [len(x) for x in want]
    ids, _ = huffman.token_table(docs, VOCABULARY)
    assert [len(r.ids) // 2 for r in sorted(ids.collect())] == [len(x) for x in want]
    assert [list(memoryview(r.ids).cast("H")) for r in sorted(ids.collect())] == want
