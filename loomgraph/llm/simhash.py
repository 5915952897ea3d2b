"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint has 128 bits: bit i is the sign of the sum, over its distinct lower-cased
words, of bit i of their hashes. A text without words has its characters for words.
The fingerprint is cut into ``SEGMENTS`` segments, each of which is a key of a hash table. A
fingerprint stands under its own segment and under all keys within one bit of it (the small Hamming
ball), so that segments within two bits of each other meet under a key; what meets is verified by the
complete distance. Segments that differ in one bit meet where the one that has the bit set flips it, and
those that differ in two where the one that has the higher bit set flips that and the other the lower one:
every such pair is met once a segment. Rows alike in fingerprint are one node from the start.

With six segments that meet within two bits all pairs within 17 bits are found, as one segment then has at
most two differing bits, and so all within ``RADIUS`` bits (16). Classes are the connected components of verified pairs. A pair
that meets in several segments counts as a link in the first of them alone, so links are summed without pairs being sent.

Large tables: fingerprints alone move, 16 bytes in each of about 130 rows a document, never texts. A bucket of more
than ``BUCKET`` fingerprints is cut into salts, and each two salts of it meet in a task of their own, so all its pairs are
compared, but in no one task. Of the pairs only as many are returned as connect a bucket, with each fingerprint's
number of links: fewer than two rows for each fingerprint of a bucket.

Defined results: a null or empty text has no fingerprint and is a class of its own, without links; a null id
counts as greater than any other; rows alike in id and text are alike, and where one of them stays it is that of the least
hash of all columns; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.components import components
from loomgraph.llm.text import chunks, fresh, mix, quoted
from loomgraph.plans import scratch

SEGMENTS = 6
RADIUS = 16
#: (word of the fingerprint, first bit, bits): segments do not cross the two 64-bit words.
CUTS = [(0, 0, 22), (0, 22, 21), (0, 43, 21), (1, 0, 22), (1, 22, 21), (1, 43, 21)]
#: Pairs that are compared at once.
BLOCK = 1 << 20
#: Fingerprints of a bucket, or of two salts of one, that a task compares.
BUCKET = 1 << 16
KEYED = "key bigint, f0 bigint, f1 bigint, flip tinyint"


def _signs(features: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """(n, 2) fingerprints of n texts; ``owner`` is ascending."""
    out = np.zeros((n, 2), np.uint64)
    if not len(features):
        return out
    edges = np.searchsorted(owner, np.arange(n + 1))
    has = np.flatnonzero(np.diff(edges))
    half = np.diff(edges)[has]
    for word, salt in enumerate((0x51ED2701, 0xA24BAED4)):
        bits = mix(features + np.uint64(salt))
        for i in range(64):
            ones = np.add.reduceat(((bits >> np.uint64(i)) & np.uint64(1)).astype(np.int32), edges[has])
            out[has, word] |= (2 * ones > half).astype(np.uint64) << np.uint64(i)
    return out


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """(n, 2) fingerprints of texts; both words are 0 for those without any characters."""
    parts = []
    for a, b, batch in chunks(pa.array(texts, pa.string())):
        starts, _, hashes = batch.words()
        owner = np.searchsorted(batch.offsets, starts, side="right") - 1
        bare = np.flatnonzero((batch.counts(starts) == 0) & (np.diff(batch.offsets) > 0))
        if len(bare):
            each = [np.arange(batch.offsets[i], batch.offsets[i + 1]) for i in bare]
            owner = np.concatenate([owner, np.repeat(bare, [len(x) for x in each])])
            hashes = np.concatenate([hashes, mix(batch.codes[np.concatenate(each)].astype(np.uint64) + np.uint64(1 << 40))])
        order = np.lexsort((hashes, owner))
        owner, hashes = owner[order], hashes[order]
        first = np.ones(len(owner), bool)
        first[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
        parts.append(_signs(hashes[first], owner[first], b - a))
    return np.concatenate(parts) if parts else np.zeros((0, 2), np.uint64)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        empty = np.array([not t for t in texts.to_pylist()], bool)
        prints = fingerprints(texts.to_pylist()).view(np.int64)
        yield pa.record_batch([batch.column(0), pa.array(prints[:, 0], mask=empty), pa.array(prints[:, 1], mask=empty), *[batch.column(i) for i in range(2, batch.num_columns)]], names=["id", "f0", "f1", *batch.schema.names[2:]])


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, f0, f1, h1, h2): h1 and h2 are hashes of id and text together, never null."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    base = base.select("id", "text", *row_hashes("id", "text"))
    kind = base.schema["id"].dataType.simpleString()
    return base.mapInArrow(_fingerprint_batches, f"id {kind}, f0 bigint, f1 bigint, h1 bigint, h2 bigint")


def row_hashes(id_col: str, text_col: str) -> tuple:
    """Two hashes that name a row by its id and text; a null is not an empty text."""
    flag = F.when(F.col(text_col).isNull(), 1).otherwise(0) + F.when(F.col(id_col).isNull(), 2).otherwise(0)
    return F.xxhash64(F.lit(1), flag, id_col, text_col).alias("h1"), F.xxhash64(F.lit(2), text_col, flag, id_col).alias("h2")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints under the keys of their balls: (key, f0, f1, flip), flip the bit that differs or -1."""
    names = ["key", "f0", "f1", "flip"]
    for batch in batches:
        for at in range(0, batch.num_rows, 8192):
            part = batch.slice(at, 8192)
            words = [part.column(i).to_numpy().view(np.uint64) for i in range(2)]
            rows = np.arange(len(words[0]))
            keys, whose, flips = [], [], []
            for s, (word, low, bits) in enumerate(CUTS):
                value = (words[word] >> np.uint64(low)) & np.uint64((1 << bits) - 1)
                tag = np.uint64(s << 32)
                keys.append(value | tag)
                whose.append(rows)
                flips.append(np.full(len(rows), -1, np.int8))
                for bit in range(bits):
                    # An unset bit is flipped only to be met by a higher one.
                    own = rows if bit < bits - 1 else np.flatnonzero((value >> np.uint64(bit)) & np.uint64(1))
                    keys.append((value[own] ^ np.uint64(1 << bit)) | tag)
                    whose.append(own)
                    flips.append(np.full(len(own), bit, np.int8))
            key, who, flip = np.concatenate(keys), np.concatenate(whose), np.concatenate(flips)
            for i in range(0, len(key), 1 << 17):
                cut = slice(i, i + (1 << 17))
                yield pa.record_batch([pa.array(key[cut].view(np.int64)), pa.array(words[0][who[cut]].view(np.int64)), pa.array(words[1][who[cut]].view(np.int64)), pa.array(flip[cut])], names=names)


def _distance(f0: np.ndarray, f1: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((f0[a] ^ f0[b]).view(np.uint64)) + np.bitwise_count((f1[a] ^ f1[b]).view(np.uint64))


def _forest(a: np.ndarray, b: np.ndarray, root: dict[int, int]) -> np.ndarray:
    """Which of the pairs connect something that those before them did not; ``root`` remembers."""

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    keep = np.zeros(len(a), bool)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            keep[i] = True
    return keep


def _met_before(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which pairs meet in a segment before that of the key; x: (n, 2) differing bits."""
    out = np.zeros(len(x), bool)
    segment = key >> 32
    for s, (word, low, bits) in enumerate(CUTS[:-1]):
        part = (x[:, word] >> np.uint64(low)) & np.uint64((1 << bits) - 1)
        out |= (segment > s) & (np.bitwise_count(part) <= 2)
    return out


def _verify(key: np.ndarray, f0: np.ndarray, f1: np.ndarray, flip: np.ndarray, radius: int, cell: np.ndarray | None = None, upper: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows within the radius, of one key and cell each, that are a spanning forest of a bucket, and the links of each row.

    Of a pair that meets in several segments only the first has it. ``upper``: the salt of a row of a cell of two; only rows
    of different salts are compared there.
    """
    cell = np.zeros(len(key), np.int64) if cell is None else cell
    upper = np.full(len(key), -1, np.int8) if upper is None else upper
    order = np.lexsort((flip, cell, key))
    key, cell, flip, upper = key[order], cell[order], flip[order].astype(np.int64), upper[order]
    start = np.r_[True, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])]
    first = np.flatnonzero(start)
    ends = np.r_[first[1:], len(key)]
    rows = np.arange(len(key))
    new = start | np.r_[True, flip[1:] != flip[:-1]]
    same = np.maximum.accumulate(np.where(new, rows, 0))
    bucket = np.repeat(np.arange(len(first)), ends - first)
    # Row i meets, if it had its flipped bit set, the rows of its bucket with lower flips; of the unflipped those before it.
    on = ((key >> np.maximum(flip, 0)) & 1) == 0
    start = first[bucket]
    count = np.where(flip < 0, rows, np.where(on, same, start)) - start
    busy = np.flatnonzero(count)
    count, start = count[busy], start[busy]
    total = np.cumsum(count)
    links = np.zeros(len(key), np.int64)
    out_a, out_b, roots = [], [], {}
    done = 0
    while done < len(busy):
        base = total[done - 1] if done else 0
        upto = max(done + 1, int(np.searchsorted(total, base + BLOCK, side="right")))
        n, s = count[done:upto], start[done:upto]
        a = np.repeat(busy[done:upto], n)
        b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(s, n)
        near = (_distance(f0, f1, order[a], order[b]) <= radius) & ((upper[a] < 0) | (upper[a] != upper[b]))
        a, b = a[near], b[near]
        if len(a):
            x = np.stack([f0[order[a]] ^ f0[order[b]], f1[order[a]] ^ f1[order[b]]], axis=1).view(np.uint64)
            new = ~_met_before(x, key[a])
            a, b = a[new], b[new]
            links += np.bincount(order[a], minlength=len(key)) + np.bincount(order[b], minlength=len(key))
            keep = _forest(a, b, roots)
            out_a.append(order[a[keep]])
            out_b.append(order[b[keep]])
        done = upto
    none = np.zeros(0, np.int64)
    return (np.concatenate(out_a), np.concatenate(out_b), links) if out_a else (none, none, links)


def _match(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come sorted by key and cell; a bucket is verified once all of it is there."""
        names = ["a0", "a1", "b0", "b1", "links"]

        def found(held: list[list[np.ndarray]]) -> pa.RecordBatch:
            key, f0, f1, flip, cell, upper = (np.concatenate(x) for x in zip(*held, strict=True))
            a, b, links = _verify(key, f0, f1, flip, radius, cell, upper)
            own = np.flatnonzero(links)
            none = np.r_[np.zeros(len(a), bool), np.ones(len(own), bool)]
            cols = [np.r_[f0[a], f0[own]], np.r_[f1[a], f1[own]], np.r_[f0[b], links[own]], np.r_[f1[b], links[own]], np.r_[np.zeros(len(a), np.int64), links[own]]]
            return pa.record_batch([pa.array(x, mask=none if 1 < i < 4 else None) for i, x in enumerate(cols)], names=names)

        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            held.append(cols)
            size += batch.num_rows
            last = (cols[0] == cols[0][-1]) & (cols[4] == cols[4][-1])
            if size >= 1 << 18 and not last[0]:
                cut = int(np.argmax(last))
                held[-1] = [c[:cut] for c in cols]
                yield found(held)
                held, size = [[c[cut:] for c in cols]], batch.num_rows - cut
        if held:
            yield found(held)

    return run


def _ball(key: Column) -> Column:
    """The key and those of its segment that differ from it in one bit."""
    bits = F.get(F.array(*[F.lit(bits) for _, _, bits in CUTS]), F.shiftright(key, 32).cast("int"))
    one = F.lit(1).cast("bigint")
    return F.concat(F.array(key), F.transform(F.sequence(F.lit(0), bits - 1), lambda i: key.bitwiseXOR(F.call_function("shiftleft", one, i))))


def _hot(prints: DataFrame) -> DataFrame | None:
    """(key, salts) of all keys under which more than ``BUCKET`` fingerprints may stand; None without any.

    Under a key stand no more fingerprints than have its segment or one of its ball.
    """
    own = [F.shiftrightunsigned(f"f{word}", low).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")).bitwiseOR(F.lit(s << 32).cast("bigint")) for s, (word, low, bits) in enumerate(CUTS)]
    # No more rows than segments have values, 2 ** 24 in all.
    counts = scratch.materialize(prints.select(F.explode(F.array(*own)).alias("key")).groupBy("key").count(), "segments")
    large = counts.where(F.col("count") > BUCKET // (1 + max(bits for _, _, bits in CUTS)))
    if large.isEmpty():
        return None
    seeds = large.select(F.explode(_ball(F.col("key"))).alias("key")).distinct()
    sums = seeds.select("key", F.explode(_ball(F.col("key"))).alias("near")).join(counts.withColumnRenamed("key", "near"), "near").groupBy("key").agg(F.sum("count").alias("n"))
    return sums.where(F.col("n") > BUCKET).select("key", F.ceil(F.col("n") * 2 / BUCKET).cast("int").alias("salts"))


def pairs(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Of distinct fingerprints (f0, f1): verified pairs (a0, a1, b0, b1) that connect what is near, and rows (a0, a1, links) with b0 null."""
    keyed = prints.mapInArrow(_keys, KEYED)
    hot = _hot(prints)
    if hot is None:
        cells = keyed.withColumns({"cell": F.lit(0).cast("bigint"), "upper": F.lit(-1).cast("tinyint")})
    else:
        many = F.coalesce("salts", F.lit(1))
        salted = keyed.join(hot, "key", "left").withColumn("salt", F.pmod(F.xxhash64("f0", "f1"), many))
        salted = salted.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), many.cast("bigint") - 1)).alias("other"))
        cell = F.least("salt", "other") * many + F.greatest("salt", "other")
        upper = F.when(F.col("salt") == F.col("other"), -1).otherwise((F.col("salt") > F.col("other")).cast("int")).cast("tinyint")
        cells = salted.select("key", "f0", "f1", "flip", cell.alias("cell"), upper.alias("upper"))
    sorted_ = cells.repartition("key", "cell").sortWithinPartitions("key", "cell")
    return sorted_.mapInArrow(_match(radius), "a0 bigint, a1 bigint, b0 bigint, b1 bigint, links bigint")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, f0, f1, h1, h2, r0, r1, links): each row with the fingerprint that its class is named by, written to the shared folder."""
    with scratch.within(docs.sparkSession) as kept:
        prints = scratch.materialize(with_fingerprints(docs, id_col, text_col), "prints")
        distinct = prints.where("f0 IS NOT NULL").select("f0", "f1").distinct()
        found = scratch.materialize(pairs(distinct, radius), "found")
        edges = found.where("b0 IS NOT NULL").select(F.struct(F.col("a0").alias("f0"), F.col("a1").alias("f1")).alias("a"), F.struct(F.col("b0").alias("f0"), F.col("b1").alias("f1")).alias("b"))
        roots = components(edges).select(F.col("node.f0").alias("f0"), F.col("node.f1").alias("f1"), F.col("root.f0").alias("r0"), F.col("root.f1").alias("r1"))
        links = found.where("b0 IS NULL").groupBy(F.col("a0").alias("f0"), F.col("a1").alias("f1")).agg(F.sum("links").alias("links"))
        known = roots.join(links, ["f0", "f1"])
        grouped = prints.join(known, ["f0", "f1"], "left").select("id", "f0", "f1", "h1", "h2", F.coalesce("r0", "f0").alias("r0"), F.coalesce("r1", "f1").alias("r1"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
        kept.append(scratch.materialize(grouped, "groups"))
    return kept[0]


def _leaders(grouped: DataFrame) -> DataFrame:
    """(r0, r1, h1, h2, leader, size): the row that stays of each class that has a fingerprint."""
    place = F.struct(F.col("id").isNull().alias("none"), "id", "h1", "h2")
    return grouped.where("r0 IS NOT NULL").groupBy("r0", "r1").agg(F.min(place).alias("p"), F.count("*").alias("size")).select("r0", "r1", F.col("p.id").alias("leader"), F.col("p.h1").alias("h1"), F.col("p.h2").alias("h2"), "size")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, class_id, class_size, n_links) of every row.

    class_id is the least id of its class, class_size its rows, n_links the other fingerprints within the radius of its own.
    """
    grouped = groups(docs, id_col, text_col, radius)
    led = grouped.join(_leaders(grouped).select("r0", "r1", "leader", "size"), ["r0", "r1"], "left")
    return led.select(F.col("id").alias(id_col), F.when(F.col("r0").isNull(), F.col("id")).otherwise(F.col("leader")).alias("class_id"), F.coalesce("size", F.lit(1)).cast("bigint").alias("class_size"), F.col("links").alias("n_links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The documents in their own columns, one of each class: that of the least id, and of rows alike in id and text one."""
    columns = [quoted(c) for c in docs.columns]
    stay = _leaders(groups(docs, id_col, text_col, radius)).select("h1", "h2")
    h1, h2, s1, s2, turn = fresh(docs.columns, 5)
    text, hashes = F.col(text_col), row_hashes(id_col, text_col)
    bare = text.isNull() | (text == "")
    named = docs.where(~bare).select("*", hashes[0].alias(h1), hashes[1].alias(h2))
    joined = named.join(stay.toDF(s1, s2), (F.col(h1) == F.col(s1)) & (F.col(h2) == F.col(s2)))
    # Rows alike in id and text: each task keeps one of its own before they meet.
    least = F.xxhash64(*[quoted(c) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
    numbered = joined.withColumn(turn, F.row_number().over(Window.partitionBy(h1, h2).orderBy(least)))
    return numbered.where(F.col(turn) == 1).select(*columns).unionAll(docs.where(bare).select(*columns))
