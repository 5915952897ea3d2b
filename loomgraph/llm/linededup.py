"""Line dedup by overlapping windows of three consecutive lines.

Every window of three consecutive lines (split at ``\\n``) with a non-blank line in it is
hashed to 128 bits. Of the windows with one hash, in all documents together, the first stays:
documents come in the order of id, then of the hash of their text, then of line number. A line
goes if any window over it is a later occurrence; lines that overlapping windows cover merge.

Defined results:

* null text: stays null, no lines, nothing removed; empty text: one empty line, stays;
* texts of fewer than three lines have no window and stay whole;
* null ids are ids that sort first; rows alike in id and text are one document and share a fate;
* a run of one line within a document shrinks, as its windows repeat each other;
* a document all of whose lines go keeps its row, with an empty text;
* an empty table gives an empty table; columns other than id and text are not looked at.

``apply_to``, the pipeline's stage, also cuts passages that do not lie on three whole lines. Lines are cut
further into pieces: after sentence ends, and where more than ``LONG`` characters have none, after words
whose checksum says so, the same in whatever line they stand. From each piece a window takes three pieces or as many more as
``LEAST_CHARS`` characters need, with equal pieces and any line breaks between; of equal windows the first stays,
as above. Cut is what lines or pieces cover, the rest with its separators stays. A passage without a whole window stays.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.text import fresh, quoted

WIDTH = 3
#: Characters of a window of pieces, at least.
LEAST_CHARS = 100
#: Characters of a piece beyond which it is cut at words.
LONG = 400
_ENDS = re.compile(r"(?<=[.!?…])(?=\s)|(?<=[。！？])(?=.)")
_WORDS = re.compile(r"\s*\S+\s*$|\s*\S+")


def _hash(lines: Column, at: Column, salt: str) -> Column:
    return F.xxhash64(F.lit(salt), *[F.get(lines, at + i) for i in range(WIDTH)])


def _windows(docs: DataFrame) -> DataFrame:
    """(id, th, at, h1, h2) of each window; ``at`` counts lines from 0."""
    lines = F.col("lines")
    content = lambda at: F.greatest(*[F.length(F.trim(F.get(lines, at + i))) for i in range(WIDTH)]) > 0
    starts = F.when(F.size(lines) >= WIDTH, F.sequence(F.lit(0), F.size(lines) - WIDTH))
    return (
        docs.select("id", "th", F.split("text", "\n").alias("lines"))
        .select("id", "th", F.explode(F.transform(starts, lambda at: F.struct(at.alias("at"), _hash(lines, at, "a").alias("h1"), _hash(lines, at, "b").alias("h2"), content(at).alias("full")))).alias("w"))
        .where("w.full")
        .select("id", "th", "w.at", "w.h1", "w.h2")
    )


@F.pandas_udf(T.StringType())
def _without(texts: pd.Series, starts: pd.Series) -> pd.Series:
    out = []
    for text, at in zip(texts, starts, strict=True):
        if text is None or at is None:
            out.append(None)
            continue
        gone = {a + i for a in at for i in range(WIDTH)}
        out.append("\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone))
    return pd.Series(out, dtype=object)


def _covered(starts: Column) -> Column:
    """How many lines the windows from ``starts`` on cover."""
    return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda at: F.array(*[at + i for i in range(WIDTH)])))))


def _pieces(line: str) -> list[str]:
    """The pieces of a line; together they are the line."""
    out = []
    for piece in _ENDS.split(line):
        if len(piece) <= LONG:
            out.append(piece)
            continue
        start = 0
        for word in _WORDS.finditer(piece):
            if zlib.crc32(word[0].strip().encode("utf-8", "surrogatepass")) % 8 == 0:
                out.append(piece[start : word.end()])
                start = word.end()
        if start < len(piece):
            out.append(piece[start:])
    return out


def _spans(pieces: list[str]) -> Iterator[tuple[int, int]]:
    """First piece and number of pieces of each window; blank pieces are none of its three."""
    solid = [i for i, x in enumerate(pieces) if x]
    ends = [0]
    for i in solid:
        ends.append(ends[-1] + len(pieces[i]))
    for i in range(len(solid) - WIDTH + 1):
        upto = max(i + WIDTH, bisect_left(ends, ends[i] + LEAST_CHARS))
        if upto > len(solid):
            break
        yield solid[i], solid[upto - 1] - solid[i] + 1


def _passage_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, th, text) to (id, th, at, n, h1, h2) of each window of n pieces from piece ``at`` on."""
    names = ["id", "th", "at", "n", "h1", "h2"]
    for batch in batches:
        rows, at, n, digests = [], [], [], []

        def out(batch=batch) -> pa.RecordBatch:
            own = batch.select([0, 1]).take(pa.array(rows, pa.int64()))
            halves = memoryview(b"".join(digests)).cast("q")
            return pa.record_batch([own.column(0), own.column(1), pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(halves[::2].tolist(), pa.int64()), pa.array(halves[1::2].tolist(), pa.int64())], names=names)

        for row, text in enumerate(batch.column(2).to_pylist()):
            if text is None:
                continue
            pieces = [x.strip() for line in text.split("\n") for x in _pieces(line)]
            for first, count in _spans(pieces):
                whole = "\n".join(x for x in pieces[first : first + count] if x)
                rows.append(row)
                at.append(first)
                n.append(count)
                digests.append(hashlib.blake2b(whole.encode("utf-8", "surrogatepass"), digest_size=16).digest())
            if len(rows) >= 1 << 16:
                yield out()
                rows, at, n, digests = [], [], [], []
        if rows:
            yield out()


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, spans): the later windows of pieces, for each document that has any."""
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    windows = base.mapInArrow(_passage_windows, f"id {kind}, th bigint, at int, n int, h1 bigint, h2 bigint")
    return _later(windows).groupBy("id", "th").agg(F.collect_set(F.struct("at", "n")).alias("spans"))


@F.pandas_udf(T.StringType())
def _without_any(texts: pd.Series, starts: pd.Series, firsts: pd.Series, counts: pd.Series) -> pd.Series:
    """Texts without the lines of windows from ``starts`` on and without the pieces of spans."""
    out = []
    for text, at, first, count in zip(texts, starts, firsts, counts, strict=True):
        if text is None or at is None and first is None:
            out.append(None)
            continue
        lines = set() if at is None else {a + i for a in at for i in range(WIDTH)}
        gone = set() if first is None else {a + i for a, n in zip(first, count, strict=True) for i in range(n)}
        kept, k = [], 0
        for i, line in enumerate(text.split("\n")):
            pieces = _pieces(line)
            stay = [x for j, x in enumerate(pieces, k) if j not in gone]
            k += len(pieces)
            if i not in lines and stay:
                kept.append(line if len(stay) == len(pieces) else "".join(stay).lstrip())
        out.append("\n".join(kept))
    return pd.Series(out, dtype=object)


def _later(windows: DataFrame) -> DataFrame:
    """The windows that are not the first of their hash."""
    place = F.struct("id", "th", "at")
    # Only the hashes that occur twice and their first place are joined back.
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(~F.col("first").eqNullSafe(F.col("last"))).drop("last")
    return windows.join(first, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, starts): the later windows' first lines, for each document that has any.

    ``th`` is the 64-bit hash of the text, by which rows of one id are told apart.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    return _later(_windows(base)).groupBy("id", "th").agg(F.collect_set("at").alias("starts"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_lines, n_removed) of every row, the text without its repeated lines."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    gone = removals(docs, id_col, text_col).select(F.col("id").alias("gid"), F.col("th").alias("gth"), "starts", _covered(F.col("starts")).alias("n_gone"))
    joined = base.join(gone, F.col("id").eqNullSafe(F.col("gid")) & (F.col("th") == F.col("gth")), "left")
    cut = _without(F.when(F.col("starts").isNotNull(), F.col("text")), F.col("starts"))
    return joined.select(
        F.col("id").alias(id_col),
        F.coalesce(cut, "text").alias(text_col),
        F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n_lines"),
        F.coalesce("n_gone", F.lit(0)).alias("n_removed"),
    )


def apply_to(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents in their own columns with repeated lines and passages cut; those left with nothing go.

    A document that was null or blank before stays as it is.
    """
    gid, gth, starts, spans, th, cut = fresh(docs.columns, 6)
    # One row a document, so that texts move once.
    lines = removals(docs, id_col, text_col).select("id", "th", "starts", F.lit(None).cast("array<struct<at:int,n:int>>").alias("spans"))
    pieces = passages(docs, id_col, text_col).select("id", "th", F.lit(None).cast("array<int>").alias("starts"), "spans")
    gone = lines.unionAll(pieces).groupBy("id", "th").agg(F.first("starts", True).alias(starts), F.first("spans", True).alias(spans)).withColumnsRenamed({"id": gid, "th": gth})
    joined = docs.withColumn(th, F.xxhash64(text_col)).join(gone, F.col(id_col).eqNullSafe(F.col(gid)) & (F.col(th) == F.col(gth)), "left")
    hit = F.col(gth).isNotNull()
    joined = joined.withColumn(cut, _without_any(F.when(hit, F.col(text_col)), F.col(starts), F.col(spans)["at"], F.col(spans)["n"]))
    kept = joined.where(~hit | (F.trim(F.col(cut)) != ""))
    return kept.select(*[F.coalesce(cut, text_col).alias(c) if c == text_col else quoted(c) for c in docs.columns])
