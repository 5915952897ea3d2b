import random
import re

from loomgraph.llm import decontaminate as d

SCHEMA = "doc_id bigint, text string, item_id string, kind string"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute_phrases(text, item):
    t, w = words(text), words(item)
    width = min(d.PHRASE, len(w))
    if not w:
        return set()
    hits = {(i, o) for i in range(len(t) - width + 1) for o in range(len(w) - width + 1) if t[i : i + width] == w[o : o + width]}
    out = set()
    for i, o in hits:
        if (i - 1, o - 1) not in hits:
            n = 1
            while (i + n, o + n) in hits:
                n += 1
            out.add((i, n + width - 1))
    return out


def brute_near(text, item):
    t, w = words(text), words(item)
    distinct = set(w)
    span = int(d.SPREAD * len(w))
    return len(distinct) >= d.LEAST and any(len(distinct & set(t[i : i + span])) >= d.SHARE * len(distinct) for i in range(len(t)))


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [" ".join(rng.choices(vocabulary, k=rng.choice([1, 4, 7, 8, 12, 13, 14, 30, 45]))) for _ in range(30)]
    docs = []
    for i in range(200):
        w = rng.choices(vocabulary, k=rng.randint(0, 120))
        kind = i % 5
        item = rng.choice(items).split()
        if kind == 1:
            w[10:10] = item
        elif kind == 2:
            w[5:5] = item[3:20]
        elif kind == 3:
            rng.shuffle(item)
            w[7:7] = item[: int(len(item) * 0.95)]
        elif kind == 4:
            item[len(item) // 2] = "other"
            w += item
        docs.append((i, ", ".join(w).upper(), "a", "b"))
    frame = spark.createDataFrame(docs, SCHEMA).repartition(3)
    tests = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id bigint, text string, doc_id int")
    got = d.decontaminate(frame, tests).collect()
    phrases = {(r.doc_id, r.item_id, r.position, r.n_words) for r in got if r.kind == "phrase"}
    assert phrases == {(i, j, *x) for i, t, *_ in docs for j, item in enumerate(items) for x in brute_phrases(t, item)}
    near = {(r.doc_id, r.item_id) for r in got if r.kind == "proximity"}
    assert near == {(i, j) for i, t, *_ in docs for j, item in enumerate(items) if brute_near(t, item)}
    bad = {r.doc_id for r in got if len(words(items[r.item_id])) >= d.LEAST}
    assert bad < {r.doc_id for r in got}
    kept = d.keep_clean(frame, tests)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, *_ in docs} - bad
    old, d.PASS_CHARS = d.PASS_CHARS, 500
    try:
        again = d.decontaminate(frame, tests).collect()
    finally:
        d.PASS_CHARS = old
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_odd_rows(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    long = "filler words " * 150_000 + item
    rows = [(1, None, "a", "b"), (2, "", "a", "b"), (None, item, "a", "b"), (4, long, "a", "b"), (5, item, "a", "b"), (5, item, "c", "d"), (6, "clean", "a", "b"), (7, "one two three four five six seven", "a", "b"), (8, "eight nine ten eleven twelve thirteen fourteen", "a", "b")]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    tests = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, item), (5, "clean")], "item_id bigint, text string")
    got = d.decontaminate(docs, tests)
    rows_ = sorted((str(r.doc_id), str(r.item_id), r.position) for r in got.where("kind = 'phrase'").collect())
    assert rows_ == sorted([(a, b, p) for a, p in (("None", 0), ("4", 300_000), ("5", 0), ("5", 0)) for b in ("1", "None")] + [("6", "5", 0)])
    assert sorted(r.doc_id for r in d.keep_clean(docs, tests).collect()) == [1, 2, 6, 7, 8]
    assert d.decontaminate(docs.limit(0), tests).count() == 0
    assert d.decontaminate(docs, tests.limit(0)).count() == 0
    assert d.keep_clean(docs, tests.limit(0)).count() == docs.count()


def test_columns_of_any_name(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = spark.createDataFrame([(1, item, "a", 1, 2), (2, "clean", "b", 1, 2), (None, None, None, None, None)], "doc_id bigint, text string, `meta.lang` string, _LG0 int, `_lg``1` int")
    kept = d.keep_clean(docs, spark.createDataFrame([(1, item)], "item_id bigint, text string"))
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "None"]
