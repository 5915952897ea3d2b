import math
import random

import pytest

from loomgraph.llm import toxicity

LABELS = "doc_id bigint, toxic int, text string"


def every_maximal(scores):
    """Maximal segments by definition: of the intervals whose all prefixes and suffixes are positive, those in no other."""
    sums = [0.0]
    for s in scores:
        sums.append(sums[-1] + s)
    n = len(scores)
    good = []
    for i in range(n):
        for j in range(i + 1, n + 1):
            inner = sums[i : j + 1]
            if all(x > sums[i] for x in inner[1:]) and all(x < sums[j] for x in inner[:-1]):
                good.append((i, j))
    return sorted((i, j - 1, sums[j] - sums[i]) for i, j in good if not any(a <= i and j <= b and (a, b) != (i, j) for a, b in good))


@pytest.mark.parametrize("seed", range(20))
def test_segments_are_the_maximal_ones(seed):
    rng = random.Random(seed)
    scores = [rng.choice([2.25, 5.5, 1.125]) if rng.random() < 0.3 else -0.75 for _ in range(40)]
    places = [i for i, s in enumerate(scores) if s > 0]
    got = toxicity.segments([scores[i] for i in places], places, -0.75)
    assert sorted(got) == every_maximal(scores)  # the scores add without rounding


def corpus(n, seed):
    rng = random.Random(seed)
    clean = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(2000)]
    bad = ["zzfool", "zzidiot", "zzscum", "zzmoron"]
    out = []
    for i in range(n):
        w = rng.choices(clean, k=rng.randint(20, 300))
        toxic = i % 10 == 0
        if toxic:
            for _ in range(rng.randint(2, 8)):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        out.append((i, " ".join(w), toxic))
    return out


def test_held_out(spark):
    rows = corpus(1200, 5)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id bigint, text string, toxic string")
    labels = spark.createDataFrame([(i, int(x), "y") for i, _, x in rows if i % 3], LABELS)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [(i, x) for i, _, x in rows if i % 3 == 0]
    assert sum(got[i].is_toxic for i, x in held if x) >= 0.95 * sum(x for _, x in held)
    assert sum(got[i].is_toxic for i, x in held if not x) <= 0.01 * len(held)
    words = {i: t.split() for i, t, _ in rows}
    for r in got.values():
        assert r.n_words == len(words[r.doc_id])
        for s in r.segments:
            assert words[r.doc_id][s["first"]].startswith("zz") and words[r.doc_id][s["last"]].startswith("zz")
    kept = toxicity.reject_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.is_toxic}


def test_a_model_too_large_to_send(spark, monkeypatch):
    """It is joined to the words of each text, with the same results."""
    rows = corpus(300, 6) + [(900, None, False), (901, "", False)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id bigint, text string, place string").repartition(3)
    labels = spark.createDataFrame([(i, int(x), "y") for i, _, x in rows if i % 3], LABELS)
    want = sorted(map(tuple, toxicity.toxicity(docs, labels).collect()))
    kept = sorted(map(tuple, toxicity.reject_toxic(docs, labels).collect()), key=str)
    monkeypatch.setattr(toxicity, "MOST_WORDS", 1)
    assert toxicity.fit(docs, labels).words.count() > 1
    assert sorted(map(tuple, toxicity.toxicity(docs, labels).collect())) == want and any(r[2] for r in want)
    again = toxicity.reject_toxic(docs, labels)
    assert again.columns == docs.columns and sorted(map(tuple, again.collect()), key=str) == kept


def test_odd_rows(spark):
    train = [(i, ("zzbad " if i % 2 else "") + f"good day number{i} to all", "s") for i in range(100, 200)]
    long = "fine words here " * 100_000
    odd = [(1, None, "s"), (2, "", "s"), (None, "zzbad zzbad zzbad", "s"), (4, long, "s"), (5, long + " zzbad" * 20, "s"), (5, "...", "s"), (5, "...", "s")]
    docs = spark.createDataFrame(train + odd, "doc_id bigint, text string, is_toxic string")
    labels = spark.createDataFrame([(i, i % 2, None) for i, _, _ in train] + [(1, None, "n"), (None, 1, "n"), (101, 0, "n"), (2, 0, "n")], LABELS)
    got = toxicity.toxicity(docs, labels)
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].p_value == by[2][0].p_value == 1.0 and by[1][0].segments == []
    assert by[None][0].is_toxic and not by[4][0].is_toxic
    assert sorted(r.is_toxic for r in by[5]) == [False, False, True]
    assert toxicity.reject_toxic(docs, labels).where("doc_id IN (1, 2)").count() == 2
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    none = toxicity.toxicity(docs, labels.limit(0))
    assert none.where("is_toxic").count() == 0 and none.count() == docs.count()


def test_rate_is_the_root():
    import numpy as np

    values, chances = np.array([-0.1, 4.0]), np.array([0.999, 0.001])
    rate = toxicity._rate(values, chances)
    assert math.isclose(float((chances * np.exp(rate * values)).sum()), 1, rel_tol=1e-6)
