import random

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import simhash
from loomgraph.llm.components import components

SCHEMA = "doc_id bigint, text string, id string, f0 string"


def brute(texts, radius):
    prints = simhash.fingerprints(texts)
    group = list(range(len(texts)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] and texts[j] and int(np.bitwise_count(prints[i] ^ prints[j]).sum()) <= radius:
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(3000)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.4:
            w = rng.choice(texts).split()
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(rng.choices(words, k=rng.randint(30, 200))))
    return texts


def test_groups_match_brute_force(spark):
    texts = corpus(400, 1)
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.class_id for r in simhash.near_duplicates(docs).collect()}
    want = brute(texts, simhash.RADIUS)
    found = sum(got[i] == w for i, w in enumerate(want) if w != i)
    assert found >= 0.9 * sum(w != i for i, w in enumerate(want)) > 0
    assert all(want[got[i]] == want[i] for i in got)  # nothing joined that brute force keeps apart
    exact = brute(texts, 11)
    near = {r.doc_id: r.class_id for r in simhash.near_duplicates(docs, radius=11).collect()}
    assert [near[i] for i in range(len(texts))] == exact


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 40])
def test_links_are_all_counted_once(spark, monkeypatch, bucket):
    """Also where buckets are cut into salts: 200 texts that differ in a word or two fill the buckets."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(7)
    base = [f"word{i}" for i in range(120)]
    texts = corpus(100, 5)
    for i in range(200):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(120)] = f"other{rng.randrange(1000)}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA)
    hot = simhash._hot(simhash.with_fingerprints(docs, "doc_id", "text").select("f0", "f1").distinct())
    assert (hot is not None and hot.count() > 0) == (bucket == 40)
    prints = simhash.fingerprints(texts)
    distinct = np.unique(prints, axis=0)
    want = [int((np.bitwise_count(distinct ^ p).sum(1) <= simhash.RADIUS).sum()) - 1 for p in prints]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert [got[i].n_links for i in range(len(texts))] == want and max(want) > 100
    assert [got[i].class_id for i in range(len(texts))] == brute(texts, simhash.RADIUS)


def test_columns_of_any_name(spark):
    rows = [(1, "alpha beta gamma", "z", 1, 2), (1, "alpha beta gamma", "y", 1, 2), (2, "", "x", 3, 4), (None, "alpha beta gamma", None, None, None), (None, "delta", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, `meta.lang` string, _LG0 int, `_lg``1` int")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    once = sorted(map(tuple, kept.collect()), key=str)
    assert len(once) == 3 and once == sorted(map(tuple, simhash.keep_one(docs.repartition(3)).collect()), key=str)


def test_pairs_within_eleven_bits_are_all_found():
    rng = np.random.default_rng(3)
    one = rng.integers(0, 1 << 63, 2, dtype=np.uint64)
    for _ in range(300):
        other = one.copy()
        for bit in rng.choice(128, 11, replace=False):
            other[bit // 64] ^= np.uint64(1 << (int(bit) % 64))
        import pyarrow as pa

        both = np.array([one, other]).view(np.int64)
        rows = next(simhash._keys([pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["f0", "f1"])]))
        a, _, _ = simhash._verify(*[rows.column(i).to_numpy(zero_copy_only=False) for i in range(4)], 11)
        assert len(a)


@pytest.mark.parametrize("distance", range(12, 18))
def test_recall_by_distance(distance):
    rng = np.random.default_rng(distance)
    found = 0
    for _ in range(300):
        one = rng.integers(0, 1 << 64, 2, dtype=np.uint64)
        other = one.copy()
        for bit in rng.choice(128, distance, replace=False):
            other[bit // 64] ^= np.uint64(1 << (int(bit) % 64))
        both = np.array([one, other]).view(np.int64)
        rows = next(simhash._keys([pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["f0", "f1"])]))
        cols = [rows.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        found += len(simhash._verify(*cols, distance)[0]) > 0
        assert not len(simhash._verify(*cols, distance - 1)[0])
    assert found / 300 == 1, f"recall {found / 300:.2f} at {distance} bits"


def test_odd_rows(spark):
    long = "word " * 200_000 + "end"
    rows = [(1, None, "a", "b"), (2, "", "a", "b"), (3, "", "a", "b"), (None, "alpha beta gamma delta", "a", "b"), (5, "alpha beta gamma delta", "a", "b"), (5, "alpha beta gamma delta", "c", "d"), (6, long, "a", "b"), (7, "!!! ???", "a", "b"), (8, "!!! ???", "a", "b"), (1, None, "a", "b")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id is None, r.doc_id, r.class_id, r.class_size) for r in simhash.near_duplicates(docs).collect() if r.doc_id)
    assert [x[1:] for x in got] == [(1, 1, 1), (1, 1, 1), (2, 2, 1), (3, 3, 1), (5, 5, 3), (5, 5, 3), (6, 6, 1), (7, 7, 2), (8, 7, 2)]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 1, 2, 3, 5, 6, 7]
    empty = docs.limit(0)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 140)]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in edges:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame([*edges, (None, 1)], "a bigint, b bigint")).collect()}
    assert got == root
