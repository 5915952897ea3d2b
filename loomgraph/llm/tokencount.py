"""Token counts by heap-and-linked-list byte-pair merging, without identifiers.

A text is split into the pieces that byte-level BPE merges within. A piece starts as a doubly
linked list of byte symbols with a heap of its adjacent pairs by rank; the lowest rank, leftmost
among equals, is popped and merged until no pair of neighbours has a rank. Every merge removes
one symbol, so a piece has as many tokens as it had bytes, less the merges. Pieces are counted
once per worker and looked up by their hash in whole batches.

Defined results: a null text has null tokens; an empty one has 0; ids may be null or repeated,
each row is counted for itself; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.text import chunks

#: Pieces that a worker remembers; beyond it starts anew.
REMEMBERED = 2_000_000


@functools.cache
def load_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def count_piece(piece: bytes, ranks: dict[bytes, int]) -> int:
    """Tokens of one piece: bytes less merges."""
    n = len(piece)
    ends = list(range(1, n + 1))  # ends[i]: end of the symbol that starts at i; 0 once merged away
    before = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            heap.append((rank, i, i + 1, i + 2))
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, j, end = heapq.heappop(heap)
        if ends[i] != j or ends[j] != end:  # one of the two has changed since
            continue
        ends[i], ends[j] = end, 0
        merges += 1
        if end < n:
            before[end] = i
            rank = ranks.get(piece[i : ends[end]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end, ends[end]))
        k = before[i]
        if k >= 0:
            rank = ranks.get(piece[k:end])
            if rank is not None:
                heapq.heappush(heap, (rank, k, i, end))
    return n - merges


class _Known:
    """Counts of pieces by hash, as two sorted arrays; one per worker and vocabulary."""

    def __init__(self) -> None:
        self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.hashes, hashes)
        found = np.zeros(len(hashes), bool)
        inside = at < len(self.hashes)
        found[inside] = self.hashes[at[inside]] == hashes[inside]
        return at, found

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        if len(self.hashes) > REMEMBERED:
            self.__init__()
        every = np.concatenate([self.hashes, hashes])
        order = np.argsort(every, kind="stable")
        self.hashes, self.counts = every[order], np.concatenate([self.counts, counts])[order]


@functools.cache
def _known(path: str) -> _Known:
    return _Known()


def _count(batch: pa.RecordBatch, path: str) -> pa.Array:
    ranks, known = load_ranks(path), _known(path)
    parts = []
    for _, _, texts in chunks(batch.column(1)):
        starts, ends, hashes = texts.pretokens()
        each, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at, found = known.lookup(each)
        counts = np.zeros(len(each), np.int32)
        counts[found] = known.counts[at[found]]
        new = np.flatnonzero(~found)
        if len(new):
            text = texts.text
            counts[new] = [count_piece(text[a:b].encode(), ranks) for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
            known.add(each[new], counts[new])
        sums = np.zeros(len(hashes) + 1, np.int64)
        np.cumsum(counts[back], out=sums[1:])
        edges = np.searchsorted(starts, texts.offsets)
        parts.append(pa.array(np.diff(sums[edges]), mask=texts.null))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.int64())


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row; one pass, no shuffle."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = base.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            sizes = pc.cast(pc.binary_length(batch.column(1)), pa.int64())
            yield pa.record_batch([batch.column(0), sizes, _count(batch, vocabulary)], names=["id", "n_bytes", "n_tokens"])

    return base.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint").withColumnRenamed("id", id_col)
