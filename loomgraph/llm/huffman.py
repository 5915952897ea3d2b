"""Token identifiers as canonical, length-limited Huffman codes.

Texts are tokenized once into a table of identifiers (two or four bytes each) in the shared folder.
Their global counts give code lengths of at most ``LIMIT`` bits, optimal under that limit, by
package-merge; codes are canonical, so lengths alone are the code book. Each row's identifiers are cut into
independent blocks of ``BLOCK``; a block starts on a byte of its own and keeps the bit offset of every
``EVERY``-th identifier, from which decoding can start. Decoding reads ``LIMIT`` bits at a
time and looks up identifier and length in one table, for all checkpoints side by side.

Counts, a number for each identifier, and the code book are as large as the vocabulary, whatever the corpus is.

Defined results: a null text has one row of null block content, an empty one a block of no identifiers;
ids may be null or repeated, each row is coded for itself; an empty table gives an empty one; other
columns are not read. A vocabulary of one used identifier gets a code of one bit.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.bpe import Coder
from loomgraph.llm.tokencount import load_ranks
from loomgraph.plans import scratch

LIMIT = 20
BLOCK = 1 << 16
EVERY = 1 << 10
#: Identifiers that are coded at once.
AT_ONCE = 1 << 20
RESULT = "block int, n_ids bigint, n_bits bigint, checkpoints array<bigint>, payload binary, round_trip boolean"


class _PlainCoder(Coder):
    """Encodes new pieces one by one; identifiers are those of the DuckDB coder, which its tests hold it to."""

    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        # Pieces are cut before; here each is one.
        self.encoding = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=self.ranks, special_tokens={})
        self.forget()

    def contract(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        each = [self.encoding.encode_ordinary(p.decode()) for p in pieces]
        sizes = np.array([len(ids) for ids in each], np.int64)
        return np.fromiter(itertools.chain.from_iterable(each), np.int32, int(sizes.sum())), sizes


@functools.cache
def _coder(path: str) -> _PlainCoder:
    return _PlainCoder(path)


def token_table(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """(id, ids) of every row, as little-endian numbers, and the size of the vocabulary."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind, size = base.schema["id"].dataType.simpleString(), max(load_ranks(vocabulary).values()) + 1
    width = _width(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = _coder(vocabulary).encode(batch.column(1))
            data, edge = lists.values.to_numpy(zero_copy_only=False).astype(width), lists.offsets.to_numpy()
            ids = [data[a:b].tobytes() if ok else None for a, b, ok in zip(edge[:-1], edge[1:], lists.is_valid().to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.binary())], names=["id", "ids"])

    path = scratch.scratch_path(docs.sparkSession, "ids")
    frame = base.mapInArrow(run, f"id {kind}, ids binary")
    frame.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(frame.schema).parquet(path), size


def _width(size: int) -> np.dtype:
    return np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")


def global_counts(tokens: DataFrame, size: int) -> np.ndarray:
    """How often each identifier occurs in all rows."""
    width = _width(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            data = b"".join(x for x in batch.column(0).to_pylist() if x is not None)
            total += np.bincount(np.frombuffer(data, width), minlength=size)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["token", "n"])

    # At most one row for each identifier of the vocabulary comes to the driver.
    rows = tokens.select("ids").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, np.int64)
    out[rows["token"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits (package-merge); 0 for what never occurs."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} identifiers do not fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    leaf = []  # of each level, which of its items in order are leaves
    packages = np.zeros(0, np.int64)
    for _ in range(limit):
        items = np.concatenate([leaves, packages])
        rank = np.argsort(items, kind="stable")
        leaf.append(rank < len(leaves))
        items = items[rank]
        packages = items[: len(items) // 2 * 2].reshape(-1, 2).sum(1)
    take = 2 * len(leaves) - 2
    for level in reversed(leaf):
        n = int(level[:take].sum())
        out[order[:n]] += 1
        take = 2 * (take - n)
    return out


@dataclass(frozen=True)
class Book:
    lengths: np.ndarray
    codes: np.ndarray

    @staticmethod
    def of(lengths: np.ndarray) -> Book:
        """The canonical code: by length, then by identifier."""
        codes = np.zeros(len(lengths), np.uint64)
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        size = lengths[order].astype(np.int64)
        # Each code covers 2 ** (LIMIT - length) of the numbers of LIMIT bits.
        span = np.left_shift(1, LIMIT - size)
        codes[order] = ((np.cumsum(span) - span) >> (LIMIT - size)).astype(np.uint64)
        return Book(lengths, codes)

    @functools.cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Identifier and length for each number of LIMIT bits."""
        order = np.lexsort((np.arange(len(self.lengths)), self.lengths))
        order = order[self.lengths[order] > 0]
        span = np.left_shift(1, LIMIT - self.lengths[order].astype(np.int64))
        symbol, length = np.zeros(1 << LIMIT, np.uint32), np.ones(1 << LIMIT, np.uint8)
        symbol[: span.sum()], length[: span.sum()] = np.repeat(order, span), np.repeat(self.lengths[order], span)
        return symbol, length

    def __reduce__(self):
        return Book.of, (self.lengths,)

    def encode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[list[bytes], list[np.ndarray], np.ndarray]:
        """Payload, checkpoints and bits of blocks of ``sizes`` identifiers."""
        n = self.lengths[ids].astype(np.int64)
        ends = np.r_[0, np.cumsum(n)]
        edge = np.r_[0, np.cumsum(sizes)]
        bits = ends[edge[1:]] - ends[edge[:-1]]
        words = (bits + 31) // 32
        base = (np.cumsum(words) - words) * 32
        at = ends[:-1] - np.repeat(ends[edge[:-1]], sizes)
        place = at + np.repeat(base, sizes)
        value = self.codes[ids] << (64 - (place & 31) - n).astype(np.uint64)
        word = place >> 5
        out = np.zeros(int(words.sum()) + 1, np.uint64)
        if len(ids):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            both = np.add.reduceat(value, first)  # no two codes share a bit
            high, low = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
            out[word[first]] += high
            out[word[first] + 1] += low
        data = out[:-1].astype(">u4").tobytes()
        payloads = [data[b // 8 : b // 8 + (k + 7) // 8] for b, k in zip(base.tolist(), bits.tolist(), strict=True)]
        return payloads, [at[a:b:EVERY] for a, b in zip(edge[:-1], edge[1:], strict=True)], bits

    def decode(self, payloads: list[bytes], checkpoints: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
        """The identifiers of all blocks, one after another."""
        symbol, length = self.table
        base = np.zeros(len(payloads) + 1, np.int64)
        np.cumsum([len(p) for p in payloads], out=base[1:])
        data = np.frombuffer(b"".join(payloads) + bytes(8), np.uint8)
        lanes = np.array([len(c) for c in checkpoints], np.int64)
        at = np.concatenate([*checkpoints, np.zeros(0, np.int64)]).astype(np.int64) + np.repeat(base[:-1] * 8, lanes)
        start = np.repeat(np.cumsum(sizes) - sizes, lanes) + (np.arange(len(at)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * EVERY
        left = np.minimum(EVERY, np.repeat(np.cumsum(sizes), lanes) - start)
        out = np.zeros(int(np.sum(sizes)), np.uint32)
        order = np.argsort(-left, kind="stable")
        at, start, left = at[order], start[order], left[order]
        for step in range(int(left[0]) if len(left) else 0):
            n = int(np.searchsorted(-left, -step))  # lanes that have more than ``step`` identifiers
            at, start, left = at[:n], start[:n], left[:n]
            byte = at >> 3
            window = (data[byte].astype(np.uint32) << 24) | (data[byte + 1].astype(np.uint32) << 16) | (data[byte + 2].astype(np.uint32) << 8) | data[byte + 3]
            code = (window << (at & 7).astype(np.uint32)) >> np.uint32(32 - LIMIT)
            out[start + step] = symbol[code]
            at = at + length[code]
        return out


def _blocks(book: Book, width: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).to_pylist()
            pieces = []
            for i, data in enumerate(rows):
                ids = np.frombuffer(data or b"", width)
                pieces += [(i, k, ids[k * BLOCK : (k + 1) * BLOCK]) for k in range(max(1, -(-len(ids) // BLOCK)))]
            total, at = np.cumsum([len(p[2]) for p in pieces]), 0
            while at < len(pieces):
                upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + AT_ONCE, side="right")))
                part = pieces[at:upto]
                sizes = np.array([len(p[2]) for p in part], np.int64)
                ids = np.concatenate([p[2] for p in part])
                payloads, checkpoints, bits = book.encode(ids, sizes)
                wrong = np.r_[0, np.cumsum(book.decode(payloads, checkpoints, sizes) != ids)]
                edge = np.r_[0, np.cumsum(sizes)]
                null = np.array([rows[i] is None for i, *_ in part], bool)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(c) for c in checkpoints])].astype(np.int32), mask=np.r_[null, False]), pa.array(np.concatenate(checkpoints)))
                yield pa.record_batch(
                    [
                        batch.column(0).take(pa.array([p[0] for p in part], pa.int64())),
                        pa.array([p[1] for p in part], pa.int32()),
                        pa.array(sizes, mask=null),
                        pa.array(bits, mask=null),
                        lists,
                        pa.array([None if x else p for x, p in zip(null, payloads, strict=True)], pa.binary()),
                        pa.array(wrong[edge[1:]] == wrong[edge[:-1]], mask=null),
                    ],
                    names=["id", "block", "n_ids", "n_bits", "checkpoints", "payload", "round_trip"],
                )
                at = upto

    return run


def compress(tokens: DataFrame, size: int, id_col: str = "doc_id") -> tuple[DataFrame, Book]:
    """(id, block, n_ids, n_bits, checkpoints, payload, round_trip) of every block, and the code book.

    ``round_trip`` tells whether the block, decoded again, gives its identifiers.
    """
    book = Book.of(code_lengths(global_counts(tokens, size)))
    kind = tokens.schema["id"].dataType.simpleString()
    return tokens.mapInArrow(_blocks(book, _width(size)), f"id {kind}, {RESULT}").withColumnRenamed("id", id_col), book


def decompress(blocks: DataFrame, book: Book, id_col: str = "doc_id") -> DataFrame:
    """(id, block, token_ids) of every block."""
    base = blocks.select(F.col(id_col).alias("id"), "block", "n_ids", "checkpoints", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([n or 0 for n in batch.column(2).to_pylist()], np.int64)
            ids = book.decode([p or b"" for p in batch.column(4).to_pylist()], [np.array(c or [], np.int64) for c in batch.column(3).to_pylist()], sizes)
            null = batch.column(4).is_null().to_numpy(zero_copy_only=False)
            edge = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32), mask=np.r_[null, False])
            yield pa.record_batch([batch.column(0), batch.column(1), pa.ListArray.from_arrays(edge, pa.array(ids.astype(np.int32)))], names=["id", "block", "token_ids"])

    return base.mapInArrow(run, f"id {base.schema['id'].dataType.simpleString()}, block int, token_ids array<int>").withColumnRenamed("id", id_col)


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The blocks of all documents."""
    tokens, size = token_table(docs, vocabulary, id_col, text_col)
    return compress(tokens, size, id_col)[0]
