"""Vectorised segmentation of text batches.

Two segmentations are offered, both over a whole Arrow batch at once so that no Python
statement runs per character or per word:

* ``words``: maximal runs of alphanumeric characters, lower-cased character by character;
* ``pretokens``: the split that byte-level BPE vocabularies apply before merging
  (contractions, an optional leading space, letters, digits, other symbols, white space).

A word is named by a 64-bit hash: the sum of one mixed value for each pair of a code point and its place
in the word, read off prefix sums. The values are not linear in the places, so words of a regular build do not
collide as they do under a polynomial; of a million words two collide with a chance of 1 in 10 ** 7. Null
texts have no words, like empty ones; callers tell them apart by ``Batch.null``.
"""

from __future__ import annotations

import ctypes
import functools
import itertools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_MULTIPLIERS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Bits of a code point.
_CODE = np.uint64(21)
_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Characters that are segmented at once; one longer text is a batch of its own.
BATCH_CHARS = 1 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
DEFAULT_BATCH, BATCH_BYTES = "67108864b", "8m"
#: Characters that are hashed at once.
WINDOW_CHARS = 1 << 17


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kinds = np.full(0x110000, _OTHER, np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    alnum = np.zeros(0x110000, bool)
    for code in range(0x110000):
        char = chr(code)
        first = unicodedata.category(char)[0]
        if first == "L":
            kinds[code] = _LETTER
            lower[code] = ord(char.lower()[0])
        elif first == "N":
            kinds[code] = _NUMBER
        alnum[code] = char.isalnum()
    kinds[_WHITE] = _SPACE
    return kinds, lower, alnum


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Batch:
    """Some texts as one array of code points; ``offsets[i]:offsets[i + 1]`` is text i."""

    def __init__(self, texts: list[str | None]):
        self.null = np.array([t is None for t in texts], bool)
        known = [t or "" for t in texts]
        self.text = "".join(known)
        self.codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.offsets = np.zeros(len(known) + 1, np.int64)
        np.cumsum([len(t) for t in known], out=self.offsets[1:])

    def _first(self) -> np.ndarray:
        mask = np.zeros(len(self.codes) + 1, bool)
        mask[self.offsets] = True
        return mask

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of the lower-cased words, in order."""
        _, lower, alnum = _tables()
        n = len(self.codes)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        inside, first = alnum[self.codes], self._first()
        start = inside.copy()
        start[1:] &= ~inside[:-1] | first[1:n]
        end = inside.copy()
        end[:-1] &= ~inside[1:] | first[1:n]
        starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        return starts, ends, self.hashes(starts, ends, lower[self.codes])

    def pretokens(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of the pieces that BPE merges within; they cover all text."""
        kinds = _tables()[0]
        codes, n = self.codes, len(self.codes)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        kind, first = kinds[codes], self._first()
        cut = first.copy()
        cut[1:n] |= kind[1:] != kind[:-1]
        space = kind == _SPACE
        # The last of a run of white space that something follows: a plain space joins what follows.
        last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:n])
        cut[last] = True
        cut[last[codes[last] == 32] + 1] = False
        # A contraction: an apostrophe that starts a piece, and the letters after it.
        mark = np.flatnonzero((codes[:-1] == 39) & cut[: n - 1] & ~first[1:n])
        if len(mark):
            after = codes[mark + 1]
            single = mark[np.isin(after, [ord(c) for c in "stmd"])]
            inner = mark[(mark + 2 < n)]
            inner = inner[~first[inner + 2]]
            a, b = codes[inner + 1], codes[inner + 2]
            double = inner[((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))]
            cut[single + 1] = False
            cut[single + 2] = True
            cut[double + 1] = False
            cut[double + 3] = True
        cut[n] = True
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        return starts, ends, self.hashes(starts, ends, codes)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Hashes of the ordered pieces, some of them at a time, so that sums stay in the cache."""
        out = np.empty(len(starts), np.uint64)
        i = 0
        while i < len(starts):
            base = int(starts[i])
            j = max(i + 1, int(np.searchsorted(ends, base + WINDOW_CHARS, side="right")))
            local = codes[base : ends[j - 1]]
            first, last = starts[i:j] - base, ends[i:j] - base
            begin = np.zeros(len(local), np.int64)
            begin[first] = first
            place = np.arange(len(local)) - np.maximum.accumulate(begin)
            x = ((place.astype(np.uint64) << _CODE) | local.astype(np.uint64)) + np.uint64(1)
            x *= _MULTIPLIERS[0]
            x ^= x >> np.uint64(32)
            x *= _MULTIPLIERS[1]
            x ^= x >> np.uint64(29)
            sums = np.zeros(len(local) + 1, np.uint64)
            np.cumsum(x, out=sums[1:])
            out[i:j] = mix(sums[last] - sums[first] + (last - first).astype(np.uint64))
            i = j
        return out

    def counts(self, starts: np.ndarray) -> np.ndarray:
        """How many of the ordered starts each text has."""
        return np.diff(np.searchsorted(starts, self.offsets))


def fresh(columns: list[str], count: int) -> list[str]:
    """New column names that none of the columns has, in whatever case."""
    taken = {c.lower() for c in columns}
    free = (name for i in itertools.count() if (name := f"_lg{i}") not in taken)
    return list(itertools.islice(free, count))


def quoted(column: str) -> Column:
    """The column of just this name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of a batch that goes to Python and back, unless the session sets its own bound.

    Batches of 10,000 long texts take, with their copies in either process, a good part of an executor's memory.
    """
    if spark.conf.get(BATCH_SETTING, DEFAULT_BATCH) == DEFAULT_BATCH:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def tidy() -> None:
    """Give memory that this worker no longer uses back to the system; the next stage runs beside it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def spans(column: pa.Array | pa.ChunkedArray, limit: int) -> Iterator[tuple[int, int, int]]:
    """(from, to, characters) of slices of a column of texts of about ``limit`` characters, none of them empty."""
    sizes = pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False) if len(column) else np.zeros(0, np.int64)
    total, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < len(sizes):
        before = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield start, end, int(total[end - 1] - before)
        start = end


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = BATCH_CHARS) -> Iterator[tuple[int, int, Batch]]:
    """Cut a column of texts into batches of about ``limit`` characters, none of them empty."""
    for start, end, _ in spans(column, limit):
        yield start, end, Batch(column.slice(start, end - start).to_pylist())
    tidy()
