import gzip
import io
import random

import pytest

from loomgraph.llm import warc

SCHEMA = "page_id bigint, url string, html string, digest string, file string"


def pages(n):
    rng = random.Random(3)
    return [(i, f"http://a.example/{i}?q=é", "<p>" + "".join(rng.choices("abcé \r\n", k=rng.randint(0, 3000))), "x", "y") for i in range(n)]


@pytest.mark.parametrize("compress", [True, False])
def test_index_and_ranges(spark, tmp_path, monkeypatch, compress):
    rows = pages(200)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    files = warc.write(docs, str(tmp_path), compress=compress)
    index = warc.index(files)
    by_file = {}
    for r in index.collect():
        by_file.setdefault(r.file, []).append(r)
    assert len(by_file) == files.count() and sum(map(len, by_file.values())) == 200
    for name, own in by_file.items():
        data, at = open(name, "rb").read(), 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            part = data[at : at + r.length]
            part = gzip.decompress(part) if compress else part
            head, _, body = part.partition(b"\r\n\r\n")
            html = rows[r.id][2].encode()
            assert body == html + b"\r\n\r\n" and r.digest == warc.digest(html) and r.url == rows[r.id][1]
            at += r.length
        assert at == len(data)
    some = index.where("id % 7 IN (1, 2) OR id > 150")
    got = {r.id: r.html for r in warc.read(some).collect()}
    assert got == {i: rows[i][2] for i in range(200) if i % 7 in (1, 2) or i > 150}
    monkeypatch.setattr(warc, "GAP_BYTES", 0)
    tight = warc.ranges(some).collect()
    for r in tight:
        assert r.start == r.records[0].offset and r.end == sum(r.records[-1])
        assert all(sum(a) == b.offset for a, b in zip(r.records, r.records[1:], strict=False))
    monkeypatch.setattr(warc, "GAP_BYTES", 1 << 20)
    assert warc.ranges(some).count() == len(by_file) < len(tight)


def test_odd_rows(spark):
    rows = [(1, "http://a", None), (2, "http://b", ""), (None, None, "<p>x"), (4, "http://d", "<p>long " * 300_000), (5, "http://e", "<p>x"), (5, "http://e", "<p>x"), (6, "http://f\r\nX: 1", "<p>y")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = sorted(((r.page_id, r.url, r.html) for r in warc.round_trip(spark, docs).collect()), key=str)
    assert got == sorted([rows[0], rows[1], rows[3], rows[4], (6, "http://f  X: 1", "<p>y")], key=str)
    assert warc.round_trip(spark, docs.limit(0)).count() == 0
    alone = warc.round_trip(spark, docs.where("page_id IS NULL")).collect()
    assert [tuple(r) for r in alone] == [rows[2]]


def test_ties_spaces_and_foreign_metadata(spark):
    rows = [(1, "http://b ", "<p>x"), (1, " http://a", "<p>x"), (1, None, "<p>x"), (2, "  http://c  ", "<p>z"), (3, " ", None)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    for n in (1, 3):
        got = sorted(((r.page_id, r.url, r.html) for r in warc.round_trip(spark, docs.repartition(n)).collect()), key=str)
        assert got == [(1, " http://a", "<p>x"), (2, "  http://c  ", "<p>z"), (3, " ", None)]
    foreign = b"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length:  3 \r\n\r\nabc\r\n\r\n"
    header, body = warc.parse(foreign)
    assert body == b"abc" and warc.NULL_HEADER.lower() not in header


def test_tasks_follow_the_work(spark):
    cores = spark.sparkContext.defaultParallelism
    assert warc._tasks(spark, 0, 0) == 1 and warc._tasks(spark, 10**6, 0.5) == 4 * cores and warc._tasks(spark, 10**6, 5000.5) == 5001


def test_broken_files():
    data = warc.record(1, "u", b"abc") + warc.record(2, "v", b"def")
    assert [n for _, n, _ in warc.scan(io.BytesIO(data))] == [len(warc.record(1, "u", b"abc")), len(warc.record(2, "v", b"def"))]
    with pytest.raises(ValueError):
        list(warc.scan(io.BytesIO(data[:-9])))
    with pytest.raises(ValueError):
        list(warc.scan(io.BytesIO(gzip.compress(data)[:-9])))
