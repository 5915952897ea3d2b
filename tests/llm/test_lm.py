import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import lm

SCHEMA = "doc_id bigint, text string, levels int, part int"


def middle(count):
    return (3 * 2 ** math.floor(math.log2(count)) - 1) / 2 if count else 0


def brute(texts):
    counts = Counter()
    split = [t.lower().split() for t in texts]
    for w in split:
        for n in (1, 2, 3):
            counts.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    held = {g: middle(c) for g, c in counts.items()}
    vocabulary, total = sum(len(g) == 1 for g in counts), sum(c for g, c in counts.items() if len(g) == 1)
    out = []
    for w in split:
        logp = 0.0
        for i in range(len(w)):
            p = 1 / (vocabulary + 1)
            for n in (1, 2, 3):
                c = held.get(tuple(w[i - n + 1 : i + 1]), 0) if i >= n - 1 else 0
                h = total if n == 1 else held.get(tuple(w[i - n + 1 : i]), 0) if i >= n - 1 else 0
                p = (min(c, h) + lm.PRIOR * p) / (h + lm.PRIOR)
            logp += math.log2(p)
        out.append(logp / len(w))
    return out


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    return [" ".join(rng.choices(words, k=rng.randint(1, 80))) for _ in range(n)]


@pytest.mark.parametrize("limit", [lm.BROADCAST_BYTES, 9000])
def test_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(lm, "BROADCAST_BYTES", limit)
    texts = corpus(150, 1)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    model = lm.train(docs, bits=200)  # next to no false positives
    assert (model.bytes > limit) == (limit == 9000)
    got = {r.doc_id: r for r in lm.score(model, docs).collect()}
    for i, want in enumerate(brute(texts)):
        assert got[i].n_words == len(texts[i].split())
        assert got[i].mean_log2_prob == pytest.approx(want, rel=1e-9)
        assert got[i].perplexity == pytest.approx(2**-want)


def test_ngrams_that_occur_once_are_held(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma", 1, 2), (2, "delta", 1, 2)], SCHEMA)
    got = {r.doc_id: r.mean_log2_prob for r in lm.score(lm.train(docs, bits=200), docs).collect()}
    one = (1 + lm.PRIOR / 5) / (4 + lm.PRIOR)
    two = (1 + lm.PRIOR * one) / (1 + lm.PRIOR)
    three = (1 + lm.PRIOR * two) / (1 + lm.PRIOR)
    assert got[1] == pytest.approx((math.log2(one) + math.log2(two) + math.log2(three)) / 3)
    assert got[2] == pytest.approx(math.log2(one))


def test_documents_that_occur_twice_score_higher(spark):
    rng = random.Random(8)
    texts = [" ".join(f"w{int(rng.paretovariate(0.5))}" for _ in range(60)) for _ in range(200)]
    rows = [(i, t, 1, 2) for i, t in enumerate(texts + texts[:20])]
    got = {r.doc_id: r.mean_log2_prob for r in lm.scores(spark.createDataFrame(rows, SCHEMA)).collect()}
    once = sorted(got[i] for i in range(20, 200))
    assert sum(got[i] > once[-18] for i in range(20)) >= 18


def test_scores_do_not_depend_on_neighbours(spark):
    texts = corpus(60, 3)
    rows = [(i, t, 1, 2) for i, t in enumerate(texts)]
    model = lm.train(spark.createDataFrame(rows, SCHEMA))
    one = {r.doc_id: r.mean_log2_prob for r in lm.score(model, spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()}
    other = {r.doc_id: r.mean_log2_prob for r in lm.score(model, spark.createDataFrame(rows[::-1], SCHEMA).repartition(7)).collect()}
    assert one == other


def test_parts_follow_the_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(corpus(150, 1))], SCHEMA)
    want = {r.doc_id: r.mean_log2_prob for r in lm.score(lm.train(docs, bits=200), docs).collect()}
    monkeypatch.setattr(lm, "PART_BYTES", 100)
    model = lm.train(docs, bits=200)
    assert model.parts >= 256
    for limit, shard in ((lm.BROADCAST_BYTES, lm.SHARD_BYTES), (lm.BROADCAST_BYTES, 5000), (10, 5000)):
        monkeypatch.setattr(lm, "BROADCAST_BYTES", limit)
        monkeypatch.setattr(lm, "SHARD_BYTES", shard)
        assert {r.doc_id: r.mean_log2_prob for r in lm.score(model, docs).collect()} == pytest.approx(want)


def test_false_positives_are_rare(spark):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(corpus(300, 2))], SCHEMA)
    model = lm.train(docs)
    filter_ = lm.Filter(model.name, model.parts, list(lm.shards_of(model)))
    rng = np.random.default_rng(0)
    found = filter_.levels(np.sort(rng.integers(1, 1 << model.name, 50_000, dtype=np.uint64)))
    assert (found > 0).mean() < 0.02


@pytest.mark.parametrize("limit", [lm.BROADCAST_BYTES, 0])
def test_odd_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(lm, "BROADCAST_BYTES", limit)
    long = "alpha beta gamma " * 150_000
    rows = [(1, None), (2, ""), (3, "..."), (None, "alpha beta"), (4, long), (5, "one"), (5, "one")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    got = {r.doc_id: tuple(r)[1:] for r in lm.scores(docs).collect()}
    assert got[1] == (None, None, None) and got[2] == got[3] == (0, None, None)
    assert got[4][0] == 450_000 and got[4][2] < got[5][2] and got[None][0] == 2
    assert lm.scores(docs).count() == len(rows)
    assert lm.scores(docs.limit(0)).count() == 0
    assert lm.scores(docs.where("text IS NULL")).count() == 1


def test_rows_sent_to_a_part_do_not_grow_with_the_batches(monkeypatch):
    monkeypatch.setattr(lm, "AT_ONCE", 2000)
    batch = pa.record_batch([pa.array(corpus(400, 5))], names=["text"])
    rows = sum(x.num_rows for x in lm._count(40, 64)(iter([batch] * 3)))
    assert rows <= 64  # of 100 batches


def test_counted_and_scored_together(spark, monkeypatch):
    texts = [*corpus(150, 1), None, "", "one", "one"]
    rows = [(i if i % 7 else None, t, 1, 2) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for part, gathered in ((lm.PART_BYTES, lm.GATHERED), (300, 3000)):
        monkeypatch.setattr(lm, "PART_BYTES", part)
        monkeypatch.setattr(lm, "GATHERED", gathered)
        # As few bits as to confuse some n-grams: the filter is the same, so are its mistakes.
        for bits in (3, lm.BITS):
            want = sorted(map(str, lm.score(lm.train(docs, bits=bits), docs).collect()))
            assert sorted(map(str, lm.together(docs, bits=bits).collect())) == want


def test_order_of_names_that_leave_no_room_for_places():
    rng = np.random.default_rng(0)
    for low, high, n in ((0, 1 << 60, 50_000), (1 << 59, (1 << 59) + 99, 1000), (1, 2, 5), (0, 1, 0)):
        names = np.r_[rng.integers(low, high, n, dtype=np.uint64), rng.integers(0, 3, n, dtype=np.uint64), np.uint64(low) + rng.integers(0, 3, n, dtype=np.uint64)]
        assert (names[lm._argsort(names)] == np.sort(names)).all()


def test_a_filter_that_was_released_is_sent_again(spark):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(corpus(60, 3))], SCHEMA)
    first = lm.scores(docs)
    want = sorted(map(tuple, first.collect()))
    assert sorted(map(tuple, lm.scores(docs.limit(30)).collect())) != want
    assert sorted(map(tuple, first.collect())) == want
