import random

from loomgraph.llm import linededup

SCHEMA = "doc_id bigint, text string, id string, th string, starts string"


def brute(docs):
    """Texts without the later occurrences of windows; docs in order of id."""
    seen, gone = set(), {}
    for i, (_, text) in enumerate(docs):
        lines = [] if text is None else text.split("\n")
        for at in range(len(lines) - 2):
            window = tuple(lines[at : at + 3])
            if not any(x.strip(" ") for x in window):
                continue
            if window in seen:
                gone.setdefault(i, set()).update(range(at, at + 3))
            seen.add(window)
    return [None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(i, ())) for i, (_, t) in enumerate(docs)], gone


def test_against_brute_force(spark):
    rng = random.Random(9)
    docs = [(i, "\n".join(rng.choice(["a", "b", "c", "", " ", "long line"]) for _ in range(rng.randint(0, 14)))) for i in range(120)]
    frame = spark.createDataFrame([(*d, "x", "y", "z") for d in docs], SCHEMA).repartition(5)
    want, gone = brute(docs)
    got = {r.doc_id: r for r in linededup.dedup_lines(frame).collect()}
    for (i, text), kept in zip(docs, want, strict=True):
        assert (got[i].text, got[i].n_removed, got[i].n_lines) == (kept, len(gone.get(i, ())), text.count("\n") + 1)
    applied = linededup.apply_to(frame)
    assert applied.columns == frame.columns
    assert {r.doc_id: r.text for r in applied.collect()} == {i: k for (i, t), k in zip(docs, want, strict=True) if k.strip(" ") or t == k}


def test_odd_rows(spark):
    passage = "first line\nsecond line\nthird line"
    long = "\n".join(f"line {i}" for i in range(50_000)) + "\n" + passage
    rows = [(1, None), (2, ""), (None, passage), (4, long), (5, "a\nb\n" + passage), (6, passage), (6, passage), (7, "one\ntwo")]
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    got = {r.doc_id: (r.text, r.n_removed) for r in linededup.dedup_lines(frame).collect()}
    assert got == {1: (None, 0), 2: ("", 0), None: (passage, 0), 4: ("\n".join(long.split("\n")[:-3]), 3), 5: ("a\nb", 3), 6: ("", 3), 7: ("one\ntwo", 0)}
    assert linededup.dedup_lines(frame).count() == len(rows)
    assert sorted(str(r.doc_id) for r in linededup.apply_to(frame).collect()) == ["1", "2", "4", "5", "7", "None"]
    assert linededup.dedup_lines(frame.limit(0)).count() == 0 and linededup.apply_to(frame.limit(0)).count() == 0


def test_passages_on_one_line_are_cut(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = " ".join(prose(12) + "." for _ in range(5))
    bare = prose(300)  # no sentence end
    rows = [(1, f"{prose(10)}. {passage} {prose(10)}"), (2, f"{prose(5)}! {passage} {prose(7)}"), (3, f"{passage}"), (4, prose(100) + " " + bare), (5, prose(90) + " " + bare), (6, "Yes. No. Yes. No. Yes. No."), (7, "Yes. No. Yes. No. Yes. No."), (8, f"{passage}  {prose(3)}\nlast")]
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    got = {r.doc_id: r.text for r in linededup.apply_to(frame).collect()}
    texts = dict(rows)
    assert {i: got[i] for i in (1, 4, 6, 7)} == {i: texts[i] for i in (1, 4, 6, 7)}
    assert got[2] == texts[2].replace(" " + passage, "") and 3 not in got and got[8] == texts[8].replace(passage, "").lstrip()
    assert len(got[5].split()) < 190


def test_columns_of_any_name(spark):
    passage = "first line\nsecond line\nthird line"
    rows = [(1, passage, "a", 1, "b"), (2, "x\n" + passage, "a", 1, "b"), (3, passage, "a", 1, "b"), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, `meta.lang` string, _LG0 int, `_lg``1` string")
    out = linededup.apply_to(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([rows[0], (2, "x", "a", 1, "b"), rows[3]], key=str)
