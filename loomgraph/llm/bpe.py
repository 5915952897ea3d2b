"""Byte-level BPE encoding and decoding by DuckDB inside each partition.

Encoding. The pieces of a batch that this worker has not met become rows (piece, position,
token), one per byte. A recursive query joins neighbouring tokens with the merge table and contracts
every piece's leftmost pair of least rank; pieces without such a pair are left behind, and the
query ends when none remain. Texts are put together from their pieces by hash, in whole batches.

Decoding. Rows (text, position, token) join the vocabulary; an aggregate ordered by position
concatenates the bytes.

The merge table has every split of a token into two tokens, as ranks order merges. One contraction
a round is quadratic in a piece's length (0.2 s for 1,024 bytes, 0.7 s for 2,048), so pieces of more than ``LONG`` bytes,
as words have them only in texts without spaces, are merged by a heap, which gives the same tokens. No row moves between partitions.

Defined results: a null text has null tokens and decodes to null; an empty one has none and decodes to
an empty text; ids may be null or repeated, each row is encoded for itself; an empty table gives
an empty one; other columns are not read. Decoding null or unknown identifiers inside a list fails
the job, as nothing stands for them; bytes that are no UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.text import chunks
from loomgraph.llm.tokencount import load_ranks

LONG = 2048
#: Characters that are encoded at once.
AT_ONCE = 1 << 20
#: Tokens that are decoded at once.
DECODED = 1 << 18
#: Rows that one query makes at most, about: half the square of each piece's length.
ROWS = 1 << 20
#: Pieces that a worker remembers.
REMEMBERED = 1_000_000

#: A row has its neighbour's place and token; a round gives each piece's merged row p, the row q that it took in, and q's neighbour.
ENCODE = """
WITH RECURSIVE step(round, piece, pos, token, next_pos, next_token) AS (
    SELECT 0, piece, pos, token, next_pos, next_token FROM symbols
    UNION ALL
    SELECT s.round + 1, s.piece, s.pos, CASE WHEN s.pos = m.p THEN m.merged ELSE s.token END,
           CASE WHEN s.pos = m.p THEN m.next_pos ELSE s.next_pos END,
           CASE WHEN s.pos = m.p THEN m.next_token WHEN s.next_pos = m.p THEN m.merged ELSE s.next_token END
    FROM step s JOIN (
        SELECT piece, p, q, merged, r.next_pos, r.next_token
        FROM (SELECT piece, (best >> 32)::INT AS merged, (best >> 16) & 65535 AS p, best & 65535 AS q
              FROM (SELECT piece, min((rank << 32) | (pos << 16) | next_pos) AS best
                    FROM step JOIN merges ON token = a AND next_token = b GROUP BY piece)) best
        JOIN step r USING (piece)
        WHERE r.pos = q
    ) m USING (piece)
    WHERE s.pos <> m.q
)
SELECT piece, token FROM step JOIN (SELECT piece, max(round) AS round FROM step GROUP BY piece) USING (piece, round) ORDER BY piece, pos
"""
DECODE = "SELECT row, string_agg(hex, '' ORDER BY pos) AS hex, count(*) AS n FROM ids JOIN vocabulary USING (token) GROUP BY row ORDER BY row"


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """(a, b, rank) of every pair of tokens that joins into one; a token's identifier is its rank."""
    rows = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    a, b, rank = np.array(rows or np.zeros((0, 3)), np.int64).T
    return pa.table({"a": a.astype(np.int32), "b": b.astype(np.int32), "rank": rank})


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Tokens of one piece by a heap of pairs over a linked list."""
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, j, k = heapq.heappop(heap)
        if end[i] != j or j >= n or end[j] != k:
            continue
        end[i], end[j] = k, 0
        if k < n:
            before[k] = i
            if (r := ranks.get(piece[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, k, end[k]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:k])) is not None:
            heapq.heappush(heap, (r, h, i, k))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Coder:
    """A DuckDB connection with the merge table, and the pieces met so far; one per worker."""

    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.db.register("merge_rows", merge_table(self.ranks))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merge_rows")
        self.db.register("token_rows", pa.table({"token": pa.array(self.ranks.values(), pa.int32()), "hex": [t.hex() for t in self.ranks]}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM token_rows")
        self.forget()

    def forget(self) -> None:
        self.hashes, self.first, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def contract(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, how many each piece has)."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        short = np.flatnonzero(sizes <= LONG)
        rows = np.cumsum(sizes[short] ** 2 // 2 + 1)
        cuts = np.unique(np.r_[0, np.searchsorted(rows, np.arange(ROWS, rows[-1], ROWS)), len(short)]) if len(short) else np.zeros(1, np.int64)
        none = np.zeros(0, np.int64), np.zeros(0, np.int32)
        piece, token = (np.concatenate(x) for x in zip(none, *[self._contract_short(pieces, short[a:b], sizes[short[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], strict=True))
        if len(short) < len(pieces):
            long = {i: merge_long(pieces[i], self.ranks) for i in np.flatnonzero(sizes > LONG).tolist()}
            piece = np.concatenate([piece, np.repeat(list(long), [len(v) for v in long.values()])])
            token = np.concatenate([token, *[np.array(v, np.int32) for v in long.values()]])
            order = np.argsort(piece, kind="stable")
            piece, token = piece[order], token[order]
        return token, np.bincount(piece, minlength=len(pieces))

    def _contract_short(self, pieces: list[bytes], short: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, token) rows of the pieces numbered ``short``, of ``n`` bytes each."""
        data = np.frombuffer(b"".join([pieces[i] for i in short]), np.uint8)
        pos = np.arange(len(data)) - np.repeat(np.cumsum(n) - n, n)
        tokens = self.byte[data]
        after = np.r_[tokens[1:], -1].astype(np.int32)
        after[np.cumsum(n) - 1] = -1
        self.db.register("symbols", pa.table({"piece": np.repeat(short, n).astype(np.int32), "pos": pos, "token": tokens, "next_pos": pos + 1, "next_token": after}))
        rows = self.db.sql(ENCODE).to_arrow_table()
        self.db.unregister("symbols")
        return rows.column("piece").to_numpy(), rows.column("token").to_numpy()

    def encode(self, column: pa.Array) -> pa.Array:
        """Lists of tokens of a column of texts."""
        parts = []
        for _, _, texts in chunks(column, AT_ONCE):
            starts, ends, hashes = texts.pretokens()
            each, first, back = np.unique(hashes, return_index=True, return_inverse=True)
            if len(self.hashes) > REMEMBERED:
                self.forget()
            at = np.minimum(np.searchsorted(self.hashes, each), max(0, len(self.hashes) - 1))
            new = np.flatnonzero(self.hashes[at] != each) if len(self.hashes) else np.arange(len(each))
            if len(new):
                text = texts.text
                pieces = [text[a:b].encode("utf-8", "replace") for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
                tokens, sizes = self.contract(pieces)
                known = np.concatenate([self.hashes, each[new]])
                order = np.argsort(known, kind="stable")
                self.hashes = known[order]
                self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(sizes) - sizes])[order]
                self.size = np.concatenate([self.size, sizes])[order]
                self.ids = np.concatenate([self.ids, tokens])
                at = np.searchsorted(self.hashes, each)
            size, begin = self.size[at][back], self.first[at][back]
            total = np.cumsum(size)
            flat = self.ids[np.arange(total[-1] if len(total) else 0) + np.repeat(begin - (total - size), size)]
            edges = np.r_[0, total][np.searchsorted(starts, texts.offsets)]
            offsets = pa.array(edges.astype(np.int32), mask=np.r_[texts.null, False])
            parts.append(pa.ListArray.from_arrays(offsets, pa.array(flat)))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    def decode(self, column: pa.Array) -> pa.Array:
        """Texts of a column of lists of tokens."""
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
        out: list[str | None] = [None if not ok else "" for ok in column.is_valid().to_pylist()]
        sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
        total, at = np.cumsum(sizes), 0
        while at < len(column):
            upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + DECODED, side="right")))
            n = sizes[at:upto]
            lo, hi = column.offsets[at].as_py(), column.offsets[upto].as_py()
            pos = np.arange(hi - lo) - np.repeat(np.cumsum(n) - n, n)
            self.db.register("ids", pa.table({"row": np.repeat(np.arange(at, upto), n), "pos": pos, "token": column.values.slice(lo, hi - lo)}))
            rows = self.db.sql(DECODE).to_arrow_table()
            self.db.unregister("ids")
            if sum(rows.column("n").to_pylist()) != hi - lo:
                raise ValueError("a token is not of this vocabulary")
            for row, text in zip(rows.column("row").to_pylist(), rows.column("hex").to_pylist(), strict=True):
                out[row] = bytes.fromhex(text).decode("utf-8", "replace")
            at = upto
        return pa.array(out, pa.string())


@functools.cache
def coder(path: str) -> Coder:
    return Coder(path)


def _mapped(docs: DataFrame, vocabulary: str, id_col: str, value: str, result: str, work) -> DataFrame:
    base = docs.select(F.col(id_col).alias("id"), F.col(value).alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from work(coder(vocabulary), batch)

    return base.mapInArrow(run, f"id {base.schema['id'].dataType.simpleString()}, {result}").withColumnRenamed("id", id_col)


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, token_ids) of every row."""
    return _mapped(docs, vocabulary, id_col, text_col, "token_ids array<int>", lambda c, b: [pa.record_batch([b.column(0), c.encode(b.column(1))], names=["id", "token_ids"])])


def decode(tokens: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """(id, text) of every row."""
    return _mapped(tokens, vocabulary, id_col, ids_col, "text string", lambda c, b: [pa.record_batch([b.column(0), c.decode(b.column(1))], names=["id", "text"])])


def encode_and_check(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, token_ids, n_tokens, round_trip): ``round_trip`` tells whether the tokens decode to the text; null for a null text."""

    def work(c: Coder, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        # Some rows at a time, so that lists and texts of a batch are never all in memory.
        sizes = np.cumsum(np.array(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), np.int64))
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + 2 * AT_ONCE, side="right")))
            part = batch.slice(at, upto - at)
            ids = c.encode(part.column(1))
            same = pc.equal(c.decode(ids), part.column(1))
            yield pa.record_batch([part.column(0), ids, pc.cast(pc.list_value_length(ids), pa.int64()), same], names=["id", "token_ids", "n_tokens", "round_trip"])
            at = upto

    return _mapped(docs, vocabulary, id_col, text_col, "token_ids array<int>, n_tokens bigint, round_trip boolean", work)
