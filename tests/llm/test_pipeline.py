import random

import tiktoken
from test_bpe import PATTERN
from test_decontaminate import brute_near, brute_phrases
from test_linededup import brute as brute_lines
from test_simhash import brute as brute_groups

import corpus_pipeline
from loomgraph.llm import simhash
from loomgraph.llm.queries import VOCABULARY
from loomgraph.llm.tokencount import load_ranks


def test_run_against_brute_force(spark, tmp_path):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(4000)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    items = [prose(rng.randint(15, 40)) for _ in range(10)]
    boilerplate = "\n".join(prose(20) for _ in range(4))
    texts = []
    for i in range(300):
        lines = [prose(rng.randint(10, 40)) for _ in range(rng.randint(1, 6))]
        if i % 10 == 0:
            lines[0] += " zzfool zzidiot zzscum zzfool"
        if i % 7 == 3:
            lines.append(boilerplate)
        if i % 31 == 5:
            lines.append(rng.choice(items))
        text = "\n".join(lines)
        if i % 9 == 4 and i > 50:
            w = texts[i - 40].split(" ")
            w[rng.randrange(len(w))] = rng.choice(words)
            text = " ".join(w)
        texts.append(text)
    texts[17:19] = [None, ""]
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), i * 2, "extra") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, h1 int, f0 string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int("zz" in (t or ""))) for i, t in enumerate(texts) if i % 3], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = [(i, t) for i, t in enumerate(texts) if "zz" not in (t or "")]
    cut, gone = brute_lines(docs)
    assert gone
    docs = [(i, k) for (i, t), k in zip(docs, cut, strict=True) if t is None or k == t or k.strip(" ")]
    groups = brute_groups([t for _, t in docs], simhash.RADIUS)
    assert any(g != n for n, g in enumerate(groups))
    docs = [d for n, d in enumerate(docs) if groups[n] == n]
    bad = {i for i, t in docs for item in items if brute_phrases(t, item) or brute_near(t, item)}
    assert bad
    public = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=load_ranks(VOCABULARY), special_tokens={})
    want = {i: None if t is None else public.encode_ordinary(t) for i, t in docs if i not in bad}

    out = corpus_pipeline.run(spark, str(tmp_path))
    got = {r.doc_id: r for r in out.collect()}
    assert {i: r.token_ids for i, r in got.items()} == want and out.count() == len(want)
    assert all(r.round_trip for r in got.values() if r.token_ids is not None)


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "en", "s", 1), (1, "a", "en", "s", 1), (None, None, None, None, None)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.select("doc_id").limit(0).selectExpr("doc_id", "1 AS toxic").write.parquet(f"{tmp_path}/labels.parquet")
    docs.select(docs.doc_id.alias("item_id"), "text").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    for frame, n in ((docs, 2), (docs.limit(0), 0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, str(tmp_path))
            assert out.columns == docs.columns
            frame = out
        assert frame.count() == n
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
