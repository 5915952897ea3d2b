"""Benchmark decontamination over a distributed positional inverted index.

The training texts are cut into shards, each indexed where it is read: every word of every text
gets a posting (its position in the shard), postings of a word lie together in order, and the
words are spread over ``BLOCKS`` blocks by hash. The index is written as Parquet in the shared
folder; no posting moves to be indexed. Words are lower-cased and named by 64-bit hashes.

A test item is searched shard by shard, from the shortest list of postings to the longest:

* phrase: ``PHRASE`` consecutive words of the item, in order; lists are shifted by the word's
  offset and intersected; phrases that follow each other on one diagonal make one match. Items of
  fewer words are one phrase;
* proximity: ``SHARE`` of the item's distinct words, in any order, within ``SPREAD`` times its
  length; one of the rarest words must be among them, so that only places around these are
  looked at. Items need ``LEAST`` distinct words. Overlapping places make one match.

``decontaminate`` reports the matches of all items. ``keep_clean``, the pipeline's stage, takes items of fewer than ``LEAST``
words for no evidence that a text holds the test, and lets none of them remove a document.

Only the lists of test words leave the index, to meet in their shard. Test items go to the
workers in passes of at most ``PASS_CHARS`` characters, so their number is not bounded.

Defined results: null and empty texts and items, and items without a word, match nothing; null ids are reported as null;
each of several rows alike is reported; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.simhash import row_hashes
from loomgraph.llm.text import Batch, chunks, fresh, quoted
from loomgraph.plans import scratch

PHRASE = 13
LEAST = 8
SHARE = 0.8
SPREAD = 1.25
BLOCKS = 32
SHARD_CHARS = 1 << 22
PASS_CHARS = 1 << 24
#: Positions between two texts of a shard, more than a phrase has words.
GAP = 64
#: Pairs of a place and one that follows it that are looked at at once.
CELLS = 1 << 20
_NONE = np.zeros(0, np.int64)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, h1, h2) to rows of the index; block -1 has the texts of a shard."""
    names = ["shard", "block", "terms", "counts", "places", "ids", "h1", "h2", "starts"]
    task, serial = TaskContext.get().partitionId() if TaskContext.get() else 0, 0
    for batch in batches:
        for a, b, texts in chunks(batch.column(1), SHARD_CHARS):
            starts, _, hashes = texts.words()
            sizes = texts.counts(starts)
            first = np.zeros(b - a + 1, np.int64)
            np.cumsum(sizes + GAP, out=first[1:])
            place = np.arange(len(hashes)) + np.repeat(np.arange(b - a) * GAP, sizes)
            order = np.argsort(hashes, kind="stable")
            hashes, place = hashes[order], place[order].astype(np.uint32)
            edge = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, np.int64)
            terms, counts = hashes[edge], np.diff(np.r_[edge, len(hashes)]).astype(np.uint32)
            gaps = np.diff(place, prepend=np.uint32(0))
            gaps[edge] = place[edge]
            shard = (task << 32) | serial
            serial += 1
            block = (terms >> np.uint64(64 - BLOCKS.bit_length() + 1)).astype(np.int64)
            cut = np.searchsorted(block, np.arange(BLOCKS + 1))
            ends = np.r_[edge, len(hashes)]
            n = BLOCKS + 1
            part = lambda x, lo, hi: x[lo:hi].tobytes()
            rows = range(BLOCKS)
            # Byte planes of the gaps: the high ones are nearly constant and compress away.
            yield pa.record_batch(
                [
                    pa.array([shard] * n, pa.int64()),
                    pa.array([-1, *rows], pa.int32()),
                    pa.array([None, *[part(terms, cut[i], cut[i + 1]) for i in rows]], pa.binary()),
                    pa.array([None, *[part(counts, cut[i], cut[i + 1]) for i in rows]], pa.binary()),
                    pa.array([None, *[gaps[ends[cut[i]] : ends[cut[i + 1]]].view(np.uint8).reshape(-1, 4).T.tobytes() for i in rows]], pa.binary()),
                    pa.array([batch.column(0).slice(a, b - a).to_pylist(), *[None] * BLOCKS], pa.list_(batch.column(0).type)),
                    *[pa.array([batch.column(c).slice(a, b - a).to_pylist(), *[None] * BLOCKS], pa.list_(pa.int64())) for c in (2, 3)],
                    pa.array([first[:-1].tolist(), *[None] * BLOCKS], pa.list_(pa.int64())),
                ],
                names=names,
            )


def _columns(kind: str) -> str:
    return f"shard bigint, block int, terms binary, counts binary, places binary, ids array<{kind}>, h1 array<bigint>, h2 array<bigint>, starts array<bigint>"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all words of all texts, written to the shared folder."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    base = base.select("id", "text", *row_hashes("id", "text"))
    columns = _columns(base.schema["id"].dataType.simpleString())
    path = scratch.scratch_path(docs.sparkSession, "index")
    base.mapInArrow(_index, columns).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(columns).parquet(path)


def _places(counts: np.ndarray, planes: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a block's words, and where each word's begin."""
    gaps = np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel().astype(np.int64)
    edge = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=edge[1:])
    sums = np.cumsum(gaps)
    before = np.r_[0, sums][edge[:-1]]
    return sums - np.repeat(before, counts), edge


def _select(wanted: np.ndarray):
    """Blocks to blocks of the wanted words alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                if row["block"] < 0:
                    continue
                terms = np.frombuffer(row["terms"], np.uint64)
                hit = np.flatnonzero(np.isin(terms, wanted, assume_unique=True))
                counts = np.frombuffer(row["counts"], np.uint32).astype(np.int64)
                if len(hit):
                    places, edge = _places(counts, row["places"])
                    kept = [places[edge[i] : edge[i + 1]] for i in hit]
                    row["places"] = np.concatenate(kept).astype(np.uint32).tobytes()
                else:
                    row["places"] = b""
                row["terms"], row["counts"] = terms[hit].tobytes(), counts[hit].astype(np.uint32).tobytes()
            rows = [r for r in rows if r["block"] < 0 or r["terms"]]
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    return run


def _has(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_, values)
    ok = at < len(sorted_)
    ok[ok] = sorted_[at[ok]] == values[ok]
    return ok


def find_phrases(words: np.ndarray, lists: dict[int, np.ndarray], width: int) -> list[tuple[int, int, int]]:
    """(position of the first word, offset in the item, words) of the longest runs of phrases."""
    own = [lists.get(w, _NONE) for w in words.tolist()]
    sizes = np.array([len(x) for x in own])
    missing = np.r_[0, np.cumsum(sizes == 0)]
    whole = np.flatnonzero(missing[width:] == missing[: len(missing) - width])
    found: dict[int, list[int]] = {}
    at = 0
    while at < len(whole):
        # The rarest word of a phrase, from which it is grown to either side; all phrases that have it are met so.
        first = int(whole[at])
        rare = first + int(sizes[first : first + width].argmin())
        diagonal = own[rare] - rare
        left, right = np.zeros(len(diagonal), np.int64), np.zeros(len(diagonal), np.int64)
        after = min(len(own), rare + width)
        for side, steps in ((left, range(rare - 1, first - 1, -1)), (right, range(rare + 1, after))):
            alive = np.arange(len(diagonal)) if side is left else np.flatnonzero(left + after - rare >= width)
            for j in steps:
                alive = alive[_has(own[j], diagonal[alive] + j)]
                if not len(alive):
                    break
                side[alive] += 1
        full = left + 1 + right >= width
        for d, lo, hi in zip(diagonal[full].tolist(), (rare - left[full]).tolist(), (rare + right[full] - width + 2).tolist(), strict=True):
            found.setdefault(d, []).extend(range(lo, hi))
        at = int(np.searchsorted(whole, rare, side="right"))
    out = []
    for diagonal, offsets in found.items():
        runs = np.split(np.array(offsets), np.flatnonzero(np.diff(offsets) > 1) + 1)
        out += [(diagonal + int(r[0]), int(r[0]), int(r[-1] - r[0]) + width) for r in runs]
    return sorted(out)


def _around(places: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The sorted places that lie in the disjoint stretches from ``begin`` to ``end``."""
    if len(places) <= len(begin):
        at = np.searchsorted(begin, places, side="right") - 1
        return places[(at >= 0) & (places <= end[at])]
    lo, hi = np.searchsorted(places, begin), np.searchsorted(places, end, side="right")
    n = hi - lo
    return places[np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)]


def find_near(words: np.ndarray, lists: dict[int, np.ndarray], starts: np.ndarray) -> list[tuple[int, int, float]]:
    """(first position, last position, share) of places that hold most of the item's distinct words."""
    terms = np.unique(words)
    need = math.ceil(SHARE * len(terms))
    have = sorted((lists[t] for t in terms.tolist() if t in lists), key=len)
    if len(terms) < LEAST or len(have) < need:
        return []
    span = int(SPREAD * len(words))
    # ``need`` of the words cannot all be among the most frequent ``need - 1``.
    seeds = np.sort(np.concatenate(have[: len(have) - need + 1]))
    apart = np.flatnonzero(np.diff(seeds) > 2 * span)
    begin, end = seeds[np.r_[0, apart + 1]] - span + 1, seeds[np.r_[apart, len(seeds) - 1]] + span
    near = [_around(x, begin, end) for x in have]
    every = np.concatenate(near)
    order = np.argsort(every, kind="stable")
    place, term = every[order], np.repeat(np.arange(len(near)), [len(x) for x in near])[order]
    # A place ends with its text.
    ends = np.r_[starts[1:], np.iinfo(np.int64).max][np.searchsorted(starts, place, side="right") - 1]
    upto = np.searchsorted(place, np.minimum(place + span, ends))
    some = np.flatnonzero(upto - np.arange(len(place)) >= need)
    if not len(some):
        return []
    # A place counts a word where the word was not yet met since that place.
    by = np.argsort(term, kind="stable")
    before = np.full(len(term), -1)
    again = np.flatnonzero(term[by][1:] == term[by][:-1])
    before[by[again + 1]] = by[again]
    width = int((upto[some] - some).max())
    out: list[list] = []
    for cut in range(0, len(some), max(1, CELLS // width)):
        own = some[cut : cut + max(1, CELLS // width)]
        cell = own[:, None] + np.arange(width)
        shares = ((before[np.minimum(cell, len(place) - 1)] < own[:, None]) & (cell < upto[own][:, None])).sum(1)
        for i, share in zip(own[shares >= need].tolist(), shares[shares >= need].tolist(), strict=True):
            first, last = int(place[i]), int(place[upto[i] - 1])
            if out and first <= out[-1][1]:
                out[-1] = [out[-1][0], last, max(out[-1][2], share)]
            else:
                out.append([first, last, share])
    return [(a, b, n / len(terms)) for a, b, n in out]


def _search(items: list[tuple[object, np.ndarray]], id_type: pa.DataType, item_type: pa.DataType):
    schema = pa.schema([("id", id_type), ("h1", pa.int64()), ("h2", pa.int64()), ("item", item_type), ("kind", pa.string()), ("position", pa.int64()), ("n_words", pa.int64()), ("share", pa.float64())])

    def run(table: pa.Table) -> pa.Table:
        lists: dict[int, np.ndarray] = {}
        ids, h1, h2, starts = [], [], [], np.zeros(0, np.int64)
        for row in table.to_pylist():
            if row["block"] < 0:
                ids, h1, h2, starts = row["ids"], row["h1"], row["h2"], np.array(row["starts"], np.int64)
                continue
            places, at = np.frombuffer(row["places"], np.uint32).astype(np.int64), 0
            for term, n in zip(np.frombuffer(row["terms"], np.uint64).tolist(), np.frombuffer(row["counts"], np.uint32).tolist(), strict=True):
                lists[term] = places[at : at + n]
                at += n
        out = []
        for item, words in items:
            hits = [("phrase", a, n, n / len(words)) for a, _, n in find_phrases(words, lists, min(PHRASE, len(words)))]
            hits += [("proximity", a, b - a + 1, share) for a, b, share in find_near(words, lists, starts)]
            for kind, a, n, share in hits:
                doc = int(np.searchsorted(starts, a, side="right")) - 1
                out.append((ids[doc], h1[doc], h2[doc], item, kind, a - int(starts[doc]), n, share))
        return pa.Table.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return run


def search(index: DataFrame, items: DataFrame, item_col: str = "item_id", item_text: str = "text", least: int = 1) -> DataFrame:
    """(id, h1, h2, item, kind, position, n_words, share) of all matches of items of at least so many words.

    Positions are in words of the text, from 0.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    tests = items.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).where("text IS NOT NULL")
    chars = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, math.ceil(chars / PASS_CHARS))
    element = index.schema["ids"].dataType.elementType
    kinds = to_arrow_type(element), to_arrow_type(tests.schema["item"].dataType)
    columns = f"id {element.simpleString()}, h1 bigint, h2 bigint, item {tests.schema['item'].dataType.simpleString()}, kind string, position bigint, n_words bigint, share double"
    results = []
    for k in range(passes):
        rows = tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k).collect()
        words = [(r.item, Batch([r.text]).words()[2]) for r in rows]
        words = [(item, w) for item, w in words if len(w) >= least]
        wanted = np.unique(np.concatenate([w for _, w in words])) if words else np.zeros(0, np.uint64)
        chosen = index.mapInArrow(_select(wanted), index.schema)
        results.append(chosen.groupBy("shard").applyInArrow(_search(words, *kinds), columns))
    out = results[0]
    for more in results[1:]:
        out = out.unionAll(more)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, kind, position, n_words, share) of every match of a test item in a text."""
    with scratch.within(docs.sparkSession) as kept:
        kept.append(scratch.materialize(search(build_index(docs, id_col, text_col), items, item_col, item_text), "matches"))
    return kept[0].select(F.col("id").alias(id_col), F.col("item").alias(item_col), "kind", "position", "n_words", "share")


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents in which no test item of ``LEAST`` words is found, in their own columns."""
    h1, h2, b1, b2 = fresh(docs.columns, 4)
    with scratch.within(docs.sparkSession) as kept:
        bad = search(build_index(docs, id_col, text_col), items, item_col, item_text, LEAST).select("h1", "h2").distinct()
        kept.append(scratch.materialize(bad.toDF(b1, b2), "contaminated"))
    bad = kept[0]
    hashes = row_hashes(id_col, text_col)
    named = docs.select("*", hashes[0].alias(h1), hashes[1].alias(h2))
    return named.join(bad, (F.col(h1) == F.col(b1)) & (F.col(h2) == F.col(b2)), "left_anti").select(*[quoted(c) for c in docs.columns])
