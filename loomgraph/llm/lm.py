"""Language-model scores from a log-frequency Bloom filter.

Counting. The lower-cased words of all texts give n-grams of orders 1 to ``ORDER``, named by hashes of ``SPARE`` bits more
than number the bytes of all texts, so that of 2 ** ``SPARE`` n-grams about one shares another's name, far fewer than the filter
confuses. Up to ``GATHERED`` characters of a task's texts at a time sort their hashes, and send them as compressed differences, in one
row for all orders, to the part that their highest bits name; a part sums its counts. Every n-gram of the corpus is counted. Parts are as many as
keep each to the n-grams of about ``PART_BYTES`` of text; so rows are as many as such gatherings times parts, and each has the more names the more is gathered.

Filter. A count c has the level 1 + floor(log2 c), and its n-gram is inserted together with each of the levels 1
to that, all n-grams of all orders from their first occurrence on.
A part builds its own segment, of ``BITS`` bits an insertion, so that no two tasks write to one.

Scoring. Levels are probed from 1 until one is missing; a level stands for the middle of its
counts. The probability of a word is smoothed by Dirichlet priors, from order to order: (c + ``PRIOR`` p) / (h + ``PRIOR``) of the
count c of the n-gram, the count h of the n - 1 words before it, and the probability p by one order less, that of order 0 being
uniform. So an n-gram that always follows its history scores the higher the more often both occur. False positives only raise a
level, and c is taken as h at most.

The filter is broadcast, in shards of about ``SHARD_BYTES``, if it has at most ``BROADCAST_BYTES``. Where the texts let expect a larger
one, ``scores`` counts and scores together: the texts are gathered into batches once, whose n-grams and counts go to their parts; a part builds
its segment and at once sends back the levels that it has for each batch. What was inserted is found without a probe, so only
higher levels, which may be false positives, are probed; results are those of the filter. ``score`` with a model of a larger filter leaves its segments
where they are, and distinct n-grams of the batches go there and come back as levels. In either way no filter moves.

Defined results: a null text has null results; one without words has 0 words and a null probability and
perplexity; ids may be null or repeated, rows alike are counted each and score alike; an
empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.text import Batch, chunks, mix, spans, tidy
from loomgraph.plans import scratch

ORDER = 3
BITS = 10
PROBES = 7
#: Occurrences that the next lower order's probability counts for.
PRIOR = 2.0
BROADCAST_BYTES = 256 << 20
#: Bytes of the filter for a byte of text, about; texts that let expect a larger one than is broadcast are counted and scored together.
FILTER_SHARE = 0.28
PART_BYTES = 8 << 20
#: Bytes of a shard, about, of which the driver has one at a time.
SHARD_BYTES = 24 << 20
#: Characters that are counted, and that are scored, at once; beside the filter less is held.
AT_ONCE = 1 << 21
SCORED = 1 << 20
#: Characters whose n-grams go to the parts together: so many for each part, at most so many. Rows that leave a worker at once.
ROW_CHARS = 1 << 15
GATHERED = 1 << 24
ROWS = 64
#: N-grams whose bits are set or probed at once.
SET = 1 << 18
#: Words whose levels a worker remembers.
REMEMBERED = 1_000_000
RESULT = {"n_words": "bigint", "mean_log2_prob": "double", "perplexity": "double"}
SPARE = 14
_SALTS = [np.uint64(0), np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25)]


def ngrams(texts: Batch, name: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the name, of so many bits, of the n-gram that ends at each word (0 if its text has too few before), and words of each text."""
    starts, _, hashes = texts.words()
    sizes = texts.counts(starts)
    place = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = [hashes]
    for order in range(1, ORDER):
        # The n-gram before, and this word; the salt keeps orders apart.
        longer = np.zeros_like(hashes)
        longer[1:] = mix(out[-1][:-1] * np.uint64(3) + hashes[1:] + _SALTS[order])
        longer[place < order] = 0
        out.append(longer)
    return [np.where(x == 0, x, np.maximum(x >> np.uint64(64 - name), np.uint64(1))) for x in out], sizes


_ZIP, _UNZIP = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _unzip(data: bytes) -> bytes:
    return _UNZIP.decompress(data)


def _pack(*columns: np.ndarray) -> bytes:
    """Differences of ascending numbers, and other columns after them, as compressed byte planes."""
    return _ZIP.compress(b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() for x in columns))


def _unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    """What ``_pack`` packed: the ascending numbers, and columns of the kinds."""
    kinds = (np.uint64, *kinds)
    rest = np.frombuffer(_unzip(data), np.uint8)
    widths = [np.dtype(k).itemsize for k in kinds]
    n, out, at = len(rest) // sum(widths), [], 0
    for kind, width in zip(kinds, widths, strict=True):
        out.append(np.ascontiguousarray(rest[at : at + n * width].reshape(width, n).T).view(kind).ravel())
        at += n * width
    return [np.cumsum(out[0], dtype=np.uint64), *out[1:]]


def _part(names: np.ndarray, name: int, parts: int) -> np.ndarray:
    return (names >> np.uint64(name - parts.bit_length() + 1)).astype(np.int64)


def _by_part(held: list[list[np.ndarray]], name: int, parts: int, counted: bool) -> Iterator[tuple[int, list[bytes]]]:
    """(part, data of each order): the distinct names, and if wished their counts, of chunks whose names by order are held; empties the list."""
    out: dict[int, list[bytes]] = {}
    chunks_ = [held.pop() for _ in range(len(held))]
    for order in range(ORDER):
        every = np.concatenate([x[order] for x in chunks_])
        for x in chunks_:
            x[order] = None
        each, counts = np.unique(every[every != 0], return_counts=True)
        del every
        if not len(each):
            continue
        part = _part(each, name, parts)
        edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        # Each part begins anew.
        step = np.diff(each, prepend=np.uint64(0))
        step[edge] = each[edge]
        columns = [step, counts.astype(np.uint32)] if counted else [step]
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(each)], strict=True):
            out.setdefault(int(part[a]), [b""] * ORDER)[order] = _pack(*(x[a:b] for x in columns))
    while out:
        yield out.popitem()


def _sent(rows: Iterator[tuple[int, list[bytes]]], batch: str | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of ``_by_part``, some at a time, before them the batch if there is one."""
    while own := list(itertools.islice(rows, ROWS)):
        part, data = zip(*own, strict=True)
        columns = {"batch": pa.array([batch] * len(own))} if batch else {}
        yield pa.record_batch(columns | {"part": pa.array(part, pa.int32()), "data": pa.array(data, pa.list_(pa.binary()))})
    del own
    tidy()


def _gathering(parts: int) -> int:
    """Characters that go to so many parts together."""
    return min(GATHERED, max(AT_ONCE, parts * ROW_CHARS))


def _count(name: int, parts: int):
    """Texts to (part, data): the names and counts of some texts of a task together."""
    most = _gathering(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, texts in chunks(batch.column(0), AT_ONCE):
                held.append(ngrams(texts, name)[0])
                size += len(texts.codes)
                if size >= most:
                    yield from _sent(_by_part(held, name, parts, True))
                    size = 0
        if held:
            yield from _sent(_by_part(held, name, parts, True))

    return run


def _joined(data: pa.ChunkedArray, order: int, *kinds: type) -> tuple[list[int], list[np.ndarray]]:
    """Of one order, how many names each row has, and the columns of all rows."""
    every = [_unpack(x, *kinds) if x else [np.zeros(0, k) for k in (np.uint64, *kinds)] for x in pc.list_element(data, order).to_pylist()]
    return [len(x[0]) for x in every], [np.concatenate(x) for x in zip(*every, strict=True)]


def _argsort(names: np.ndarray) -> np.ndarray:
    """The order that sorts names: sorted is what holds a name and its place in one number, which takes a third of the time."""
    if not len(names):
        return np.zeros(0, np.int64)
    low, place = names.min(), np.uint64(len(names).bit_length())
    more = max(0, int(names.max() - low).bit_length() + int(place) - 64)
    keys = ((names - low) >> np.uint64(more) << place) | np.arange(len(names), dtype=np.uint64)
    keys.sort()
    order = (keys & ((np.uint64(1) << place) - np.uint64(1))).astype(np.int64)
    every = names[order]
    # Names that differ in no bit that had room; few, if any.
    return order[np.argsort(every, kind="stable")] if more and (every[1:] < every[:-1]).any() else order


def _distinct(names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts names, where each one begins in it, and the distinct names."""
    order = _argsort(names)
    every = names[order]
    edge = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, np.int64)
    return order, edge, every[edge]


def _spread(values: np.ndarray, order: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Values of distinct names to all names that ``_distinct`` was given."""
    out = np.empty(len(order), values.dtype)
    out[order] = np.repeat(values, np.diff(edge, append=len(order)))
    return out


def _levels(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(float))[1]  # 1 + floor(log2 c)


def _start(names: np.ndarray, level: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first probe, and the step from one to the next."""
    h = mix(names * np.uint64(0x9E3779B97F4A7C15) + np.asarray(level, np.uint64))
    return h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)


def _seat(a: np.ndarray, b: np.ndarray, i: int, bits: np.ndarray | np.uint64) -> np.ndarray:
    """The bit of probe i: a fraction of 32 bits of a segment's bits, of which there are fewer than 2 ** 32."""
    return ((((a + np.uint64(i) * b) & np.uint64(0xFFFFFFFF)) * bits) >> np.uint64(32)).astype(np.int64)


def _bits(held: list[tuple[np.ndarray, np.ndarray]], per: int) -> tuple[int, np.ndarray]:
    """How many bits a segment of the names and levels of all orders has, and its bytes."""
    size = max(64, sum(int(levels.sum(dtype=np.int64)) for _, levels in held) * per)
    bits = np.zeros(size, bool)
    for names, levels in held:
        for low in range(0, len(names), SET):
            own, top = names[low : low + SET], levels[low : low + SET]
            for level in range(1, int(top.max()) + 1):
                a, b = _start(own[top >= level], level)
                for i in range(PROBES):
                    bits[_seat(a, b, i, np.uint64(size))] = True
    return size, np.packbits(bits, bitorder="little")


def _segment(per: int):
    def run(table: pa.Table) -> pa.Table:
        """One part's rows to its segment of the filter."""
        held: list[tuple[np.ndarray, np.ndarray]] = []
        words = total = 0
        for k in range(ORDER):
            names, counts = _joined(table.column("data"), k, np.uint32)[1]
            if not len(names):
                continue
            order, edge, each = _distinct(names)
            many = np.add.reduceat(counts[order].astype(np.int64), edge)
            if k == 0:
                words, total = len(each), int(many.sum())
            held.append((each, _levels(many).astype(np.uint8)))
        size, bits = _bits(held, per)
        return pa.table({"part": table.column("part")[:1], "size": [size], "bits": pa.array([bits.tobytes()], pa.binary()), "words": [words], "total": [total]})

    return run


def _probe(names: np.ndarray, bits: np.ndarray, base: np.ndarray, data: np.ndarray, sure: np.ndarray | None = None) -> np.ndarray:
    """The level of each name by a segment of so many bits that begins at byte ``base``; 0 where it has no bits.

    ``sure`` has levels that were inserted, of which no probe is needed.
    """
    found = np.zeros(len(names), np.uint8) if sure is None else sure.copy()
    at = np.flatnonzero(bits)
    names, bits, base = names[at], bits[at].astype(np.uint64), base[at]
    while len(at):
        alive = np.arange(len(at))
        a, b = _start(names, found[at] + np.uint64(1))
        size, start = bits, base
        for i in range(PROBES):
            seat = _seat(a, b, i, size)
            hit = np.flatnonzero((data[start + (seat >> 3)] >> (seat & 7).astype(np.uint8)) & 1)
            if len(hit) < len(alive):
                alive, a, b, size, start = alive[hit], a[hit], b[hit], size[hit], start[hit]
        at, names, bits, base = at[alive], names[alive], bits[alive], base[alive]
        found[at] += 1
    return found


def _probe_one(names: np.ndarray, size: int, data: np.ndarray, sure: np.ndarray | None = None) -> np.ndarray:
    """The same by one segment, some names at a time, so that they stay in the cache."""
    out = np.zeros(len(names), np.uint8)
    for low in range(0, len(names), SET):
        own = slice(low, low + SET)
        n = len(names[own])
        out[own] = _probe(names[own], np.full(n, size), np.zeros(n, np.int64), data, None if sure is None else sure[own])
    return out


@dataclass(frozen=True)
class Shard:
    """The parts from ``low`` on; ``offset`` is where each part's bytes begin, ``size`` its bits."""

    low: int
    offset: np.ndarray
    size: np.ndarray
    data: np.ndarray


@dataclass
class Filter:
    """The filter, as shards in the order of their parts."""

    name: int
    parts: int
    shards: list[Shard]
    seen: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    seen_levels: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint8))

    def levels(self, names: np.ndarray) -> np.ndarray:
        """The level of each sorted name, 0 of those that are not held."""
        part, found = _part(names, self.name, self.parts), np.zeros(len(names), np.uint8)
        for shard in self.shards:
            own = slice(*np.searchsorted(part, [shard.low, shard.low + len(shard.size)]))
            at = part[own] - shard.low
            found[own] = _probe(names[own], shard.size[at], shard.offset[at], shard.data)
        return found

    def recall(self, names: np.ndarray) -> np.ndarray:
        """The same for names that come again and again: what was probed is remembered."""
        if len(self.seen) > REMEMBERED:
            self.seen, self.seen_levels = self.seen[:0], self.seen_levels[:0]
        at = np.minimum(np.searchsorted(self.seen, names), max(0, len(self.seen) - 1))
        known = self.seen[at] == names if len(self.seen) else np.zeros(len(names), bool)
        found = np.zeros(len(names), np.uint8)
        found[known] = self.seen_levels[at[known]]
        new = names[~known]
        if len(new):
            found[~known] = self.levels(new)
            every = np.concatenate([self.seen, new])
            order = np.argsort(every, kind="stable")
            self.seen, self.seen_levels = every[order], np.concatenate([self.seen_levels, found[~known]])[order]
        return found


@dataclass(frozen=True)
class Model:
    segments: DataFrame
    name: int
    parts: int
    words: int
    total: int
    bytes: int


def _bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0


def _sizes(size: int) -> tuple[int, int]:
    """The bits of a name and the parts, for so many bytes of text."""
    return min(60, max(36, size.bit_length() + SPARE)), 1 << max(4, (math.ceil(size / PART_BYTES) - 1).bit_length())


def train(docs: DataFrame, text_col: str = "text", bits: int = BITS) -> Model:
    """Count the n-grams of all texts and build the filter, part by part."""
    texts = docs.select(F.col(text_col).alias("text"))
    name, parts = _sizes(_bytes(docs, text_col))
    counted = texts.mapInArrow(_count(name, parts), "part int, data array<binary>")
    segments = counted.groupBy("part").applyInArrow(_segment(bits), "part int, size bigint, bits binary, words bigint, total bigint")
    segments = scratch.materialize(segments, "filter")
    words, total, size = segments.agg(F.sum("words"), F.sum("total"), F.sum(F.length("bits"))).first()
    return Model(segments, name, parts, words or 0, total or 0, size or 0)


def shards_of(model: Model) -> Iterator[Shard]:
    """The filter, some parts at a time, so that the driver never has all of it."""
    step = max(1, model.parts * SHARD_BYTES // max(SHARD_BYTES, model.bytes))
    for low in range(0, model.parts, step):
        own = model.segments.where((F.col("part") >= low) & (F.col("part") < low + step)).select("part", "size", "bits").toArrow()
        offset, size = np.zeros(step, np.int64), np.zeros(step, np.int64)
        data, at = [], 0
        for part, n, bits in zip(own.column(0).to_pylist(), own.column(1).to_pylist(), own.column(2), strict=True):
            data.append(np.frombuffer(bits.as_buffer(), np.uint8))
            offset[part - low], size[part - low] = at, n
            at += len(data[-1])
        shard = Shard(low, offset, size, np.concatenate(data) if data else np.zeros(0, np.uint8))
        # Else the driver has this shard's copies beside the next.
        del own, data
        yield shard
        del shard
        tidy()


def _middle(levels: np.ndarray) -> np.ndarray:
    """The count that a level stands for: 0, 1, 2.5, 5.5, ..."""
    return np.where(levels > 0, (3 * np.exp2(levels - 1.0) - 1) / 2, 0.0)


def probability(levels: list[np.ndarray], first: np.ndarray, words: int, total: int) -> np.ndarray:
    """Of each word, by the levels of the n-grams that end at it; ``first`` marks the first words of texts."""
    counts = [_middle(x.astype(float)) for x in levels]
    before = [np.full(len(levels[0]), float(total)), *[np.r_[0.0, c[:-1]] for c in counts[:-1]]]
    out = np.full(len(levels[0]), 1 / (words + 1))
    for order, (count, history) in enumerate(zip(counts, before, strict=True)):
        if order:
            history[first] = 0
        out = (np.minimum(count, history) + PRIOR * out) / (history + PRIOR)
    return out


def _results(ids: pa.Array, null: np.ndarray, sizes: np.ndarray, levels: list[np.ndarray], words: int, total: int) -> pa.RecordBatch:
    some = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[some]
    mean = np.zeros(len(sizes))
    if len(some):
        # Text by text, so that a score does not depend on those beside it.
        mean[some] = np.add.reduceat(np.log2(probability(levels, starts, words, total)), starts) / sizes[some]
    none = null | (sizes == 0)
    return pa.record_batch([ids, pa.array(sizes.astype(np.int64), mask=null), pa.array(mean, mask=none), pa.array(np.exp2(-mean), mask=none)], names=["id", *RESULT])


def _broadcast(shared: list, name: int, parts: int, words: int, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = Filter(name, parts, [x.value for x in shared])
        for batch in batches:
            for a, b, texts in chunks(batch.column(1), SCORED):
                names, sizes = ngrams(texts, name)
                levels = []
                for order, every in enumerate(names):
                    # Each n-gram is probed once, in the order of the segments.
                    by_name, edge, each = _distinct(every)
                    known = filter_.levels(each) if order else filter_.recall(each)
                    known[each == 0] = 0
                    levels.append(_spread(known, by_name, edge))
                yield _results(batch.column(0).slice(a, b - a), texts.null, sizes, levels, words, total)

    return run


def _gather(most: int):
    """(id, text) to (batch, ids, texts) of so many characters each, about; the texts are compressed."""

    def row(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids, texts = (pa.concat_arrays([x.column(i) for x in held]) for i in range(2))
        with pa.BufferOutputStream() as sink:
            with pa.ipc.new_stream(sink, pa.schema({"text": texts.type}), options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))) as to:
                to.write_batch(pa.record_batch([texts], names=["text"]))
            data = sink.getvalue().to_pybytes()
        return pa.record_batch([pa.array([uuid.uuid4().hex]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([data], pa.binary())], names=["batch", "ids", "texts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for a, b, n in spans(batch.column(1), most):
                if held and size + n > most:
                    yield row(held)
                    held, size = [], 0
                held.append(batch.slice(a, b - a))
                size += n
        if held:
            yield row(held)
        held = []
        tidy()

    return run


def _texts(data: bytes) -> pa.ChunkedArray:
    return pa.ipc.open_stream(data).read_all().column(0)


def _ask(name: int, parts: int, counted: bool):
    """(batch, texts) to (batch, part, data): its distinct names, and if wished their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held = [ngrams(texts, name)[0] for _, _, texts in chunks(_texts(data.as_py()), AT_ONCE)]
                yield from _sent(_by_part(held, name, parts, counted), own)

    return run


def _told(asked: pa.Table, levels: list[np.ndarray], sizes: list[list[int]]) -> pa.Table:
    """The levels of all names of a part, order by order, to the rows that asked."""
    each: list[list[bytes]] = []
    for own, counts in zip(levels, sizes, strict=True):
        to = np.cumsum(counts).tolist()
        each.append([_ZIP.compress(own[b - n : b].tobytes()) if n else b"" for n, b in zip(counts, to, strict=True)])
    return pa.table({"batch": asked.column("batch"), "part": asked.column("part"), "levels": pa.array(list(zip(*each, strict=True)), pa.list_(pa.binary()))})


def _answer(asked: pa.Table, segment: pa.Table) -> pa.Table:
    """The levels of all names asked of one part."""
    bits = np.frombuffer(segment.column("bits")[0].as_buffer(), np.uint8) if segment.num_rows else np.zeros(0, np.uint8)
    size = segment.column("size")[0].as_py() if segment.num_rows else 0
    if not asked.num_rows:
        return pa.table({"batch": pa.array([], pa.string()), "part": pa.array([], pa.int32()), "levels": pa.array([], pa.list_(pa.binary()))})
    levels, sizes = [], []
    for k in range(ORDER):
        own, (names,) = _joined(asked.column("data"), k)
        order, edge, each = _distinct(names)
        levels.append(_spread(_probe_one(each, size, bits), order, edge))
        sizes.append(own)
    return _told(asked, levels, sizes)


def _segment_and_answer(per: int):
    """One part's rows of all batches to the levels of their names, by the segment that they make.

    What was inserted is found; probed is only whether the filter finds more.
    """

    def run(table: pa.Table) -> pa.Table:
        held, places, sizes = [], [], []
        words = total = 0
        for k in range(ORDER):
            own, (names, counts) = _joined(table.column("data"), k, np.uint32)
            order, edge, each = _distinct(names)
            many = np.add.reduceat(counts[order].astype(np.int64), edge) if len(each) else np.zeros(0, np.int64)
            if k == 0:
                words, total = len(each), int(many.sum())
            held.append((each, _levels(many).astype(np.uint8)))
            places.append((order.astype(np.uint32), edge))
            sizes.append(own)
            del names, counts, order, edge, many
        size, bits = _bits(held, per)
        levels = [_spread(_probe_one(*x[:1], size, bits, x[1]), *place) for x, place in zip(held, places, strict=True)]
        out = _told(table, levels, sizes)
        first = np.arange(table.num_rows) == 0
        return out.append_column("words", pa.array(first * words)).append_column("total", pa.array(first * total))

    return run


def _put_together(name: int, words: int, total: int):
    def run(gathered: pa.Table, answers: pa.Table) -> pa.Table:
        rows = sorted(zip(answers.column("part").to_pylist(), answers.column("levels").to_pylist(), strict=True), key=lambda r: r[0])
        out = []
        for ids, data in zip(gathered.column("ids"), gathered.column("texts"), strict=True):
            cuts, names, sizes, null = [], [[] for _ in range(ORDER)], [], []
            for a, b, texts in chunks(_texts(data.as_py()), AT_ONCE):
                own, size = ngrams(texts, name)
                cuts.append((a, b))
                sizes.append(size)
                null.append(texts.null)
                for k in range(ORDER):
                    names[k].append(own[k])
            levels = []
            for k in range(ORDER):
                order, edge, each = _distinct(np.concatenate(names[k]))
                names[k] = None
                known = np.zeros(len(each), np.uint8)
                known[each != 0] = np.frombuffer(b"".join(_unzip(x[k]) for _, x in rows if x[k]), np.uint8)
                levels.append(_spread(known, order, edge))
            low = 0
            for (a, b), size, none in zip(cuts, sizes, null, strict=True):
                high = low + int(size.sum())
                out.append(_results(ids.values.slice(a, b - a), none, size, [x[low:high] for x in levels], words, total))
                low = high
        return pa.Table.from_batches(out)

    return run


def _columns(base: DataFrame) -> tuple[str, str]:
    """The type of the ids, and the columns of the result."""
    kind = base.schema["id"].dataType.simpleString()
    return kind, f"id {kind}, " + ", ".join(f"{c} {t}" for c, t in RESULT.items())


def _gathered(base: DataFrame, parts: int) -> DataFrame:
    return scratch.materialize(base.mapInArrow(_gather(_gathering(parts)), f"batch string, ids array<{_columns(base)[0]}>, texts binary"), "batches")


#: The shards of the filter that was broadcast last.
_shared: list[Broadcast] = []


def _release(spark: SparkSession) -> None:
    """Executors need not hold an earlier filter beside the next; a lazy result that still reads it has it sent again."""
    while _shared:
        if (old := _shared.pop())._sc is spark.sparkContext:
            old.unpersist(blocking=True)


def score(model: Model, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, mean_log2_prob, perplexity) of every row; the probability is a word's, the mean over the text."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    columns = _columns(base)[1]
    if model.bytes <= BROADCAST_BYTES:
        _release(spark)
        shared = [spark.sparkContext.broadcast(x) for x in shards_of(model)]
        _shared.extend(shared)
        out = base.mapInArrow(_broadcast(shared, model.name, model.parts, model.words, model.total), columns)
    else:
        gathered = _gathered(base, model.parts)
        asked = gathered.select("batch", "texts").mapInArrow(_ask(model.name, model.parts, False), "batch string, part int, data array<binary>")
        answers = asked.groupBy("part").cogroup(model.segments.select("part", "size", "bits").groupBy("part")).applyInArrow(_answer, "batch string, part int, levels array<binary>")
        out = gathered.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_put_together(model.name, model.words, model.total), columns)
    return out.withColumnRenamed("id", id_col)


def together(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """What ``score`` gives of the documents by their own model, where each part answers as soon as it has its segment."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    name, parts = _sizes(_bytes(docs, text_col))
    gathered = _gathered(base, parts)
    counted = gathered.select("batch", "texts").mapInArrow(_ask(name, parts, True), "batch string, part int, data array<binary>")
    answers = counted.groupBy("part").applyInArrow(_segment_and_answer(bits), "batch string, part int, levels array<binary>, words bigint, total bigint")
    answers = scratch.materialize(answers, "answers")
    words, total = answers.agg(F.sum("words"), F.sum("total")).first()
    answers = answers.select("batch", "part", "levels")
    out = gathered.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_put_together(name, words or 0, total or 0), _columns(base)[1])
    return out.withColumnRenamed("id", id_col)


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the documents and score each of them."""
    if _bytes(docs, text_col) * FILTER_SHARE > BROADCAST_BYTES:
        return together(docs, id_col, text_col)
    return score(train(docs, text_col), docs, id_col, text_col)
