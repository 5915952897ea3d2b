"""Toxic passages by maximum-scoring segments, calibrated by extreme values.

Model. Labelled documents give each lower-cased word its number of toxic and of clean documents.
Its score is the difference of log odds under informative Dirichlet priors in proportion to the
word's share of both kinds together. Words whose score is at least ``LEAST_SCORE`` and whose
likelihood ratio against no difference would be met by chance in less than ``BY_CHANCE`` of all words of
toxic documents make the model; all other words share one negative score, that
of their total probability, which makes clean text drift downwards.

Search. Over a text's scores all maximal scoring segments are found in one linear scan; only
words of the model can begin or end one, so the scan runs over these.

Calibration. In clean text the number of segments of score S or more in n words is Poisson with
mean K n exp(-lambda S). lambda is the positive root of the moment equation of the clean scores
(1 for exact log odds), K comes from the segments of the clean labelled documents over a
threshold. A segment is significant, and a document toxic, at a chance below ``ALPHA``; that of a document
is the chance of its best segment.

Bound of the fit: ``MOST_LABELLED`` labelled documents, the first by hash of their id; scoring
covers every document. With no toxic or no clean label nothing is toxic. The model goes to every worker if it has at most
``MOST_WORDS`` words; that of very long labelled documents may have more and is then joined to the words of each text instead.

Defined results: null and empty texts have no words, no segments and p-value 1; null ids are
scored, and never labelled; a null label is no label; of several labels of one id, toxic wins;
rows alike are scored alike; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.text import chunks, fresh, quoted
from loomgraph.plans import scratch

MOST_LABELLED = 200_000
#: Prior words for each labelled word.
PRIOR = 0.02
LEAST_SCORE = math.log(4)
BY_CHANCE = 10.0
ALPHA = 1e-4
#: Words that a model may have, as it goes to every worker: 12 bytes each.
MOST_WORDS = 8_000_000
RESULT = "p_value double, is_toxic boolean, n_words bigint, segments array<struct<first:int,last:int,score:double,p_value:double>>"


@dataclass(frozen=True)
class Model:
    """``hashes`` are sorted; ``drift`` is the score of other words; chance of S in n words: 1 - exp(-k n exp(-rate S))."""

    hashes: np.ndarray
    scores: np.ndarray
    drift: float
    rate: float
    k: float
    #: (word, score) of a model that is too large to be sent, which ``hashes`` and ``scores`` leave out.
    words: DataFrame | None = None


def segments(scores: list[float], places: list[int], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) where ``places`` score ``scores`` and all between ``drift``."""
    stack: list[tuple[float, float, int, int]] = []  # sums before and up to the end of a candidate, its first and last place
    links: list[int] = []  # the nearest candidate to the left with a lower left sum
    total, before = 0.0, -1
    for score, at in zip(scores, places, strict=True):
        total += drift * (at - before - 1)
        left, right, first = total, total + score, at
        total, before = right, at
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= left:
                j = links[j]
            if j < 0 or stack[j][1] >= right:
                stack.append((left, right, first, at))
                links.append(j)
                break
            left, first = stack[j][0], stack[j][2]
            del stack[j:], links[j:]
    return [(first, last, right - left) for left, right, first, last in stack]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) to (word, t, c): toxic and clean documents of a batch with the word, and their sums as word null."""
    names = ["word", "t", "c"]
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for a, b, texts in chunks(batch.column(0), 1 << 21):
            starts, _, hashes = texts.words()
            owner = np.searchsorted(texts.offsets, starts, side="right") - 1
            order = np.lexsort((owner, hashes))
            h, o = hashes[order], owner[order]
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
            h, bad = h[first], toxic[a:b][o[first]]
            if not len(h):
                continue
            edge = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            t = np.add.reduceat(bad.astype(np.int64), edge)
            n = np.diff(np.r_[edge, len(h)])
            yield pa.record_batch([pa.array(h[edge].view(np.int64)), pa.array(t), pa.array(n - t)], names=names)


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """(text, toxic) of at most ``most`` labelled documents."""
    known = labels.select(F.col(id_col).alias("lid"), F.col("toxic").cast("int").alias("toxic")).dropna()
    known = known.groupBy("lid").agg((F.max("toxic") > 0).alias("toxic")).orderBy(F.xxhash64("lid"), "lid").limit(most)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    # At most ``most`` ids, whatever the size of the tables.
    return base.join(F.broadcast(known), F.col("id") == F.col("lid")).select("text", "toxic")


def _rate(values: np.ndarray, chances: np.ndarray) -> float:
    """The positive root of sum(chances * exp(rate * values)) = 1."""
    low, high = 1e-3, 1.0
    value = lambda r: float((chances * np.exp(np.minimum(r * values, 600))).sum()) - 1
    while value(high) < 0 and high < 100:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return (low + high) / 2


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_LABELLED) -> Model | None:
    """The model of the labelled documents; None if they are not of both kinds."""
    with scratch.within(docs.sparkSession) as kept:
        return _fit(docs, labels, id_col, text_col, most, kept)


def _fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int, kept: list[DataFrame]) -> Model | None:
    known = labelled(docs, labels, id_col, text_col, most)
    counts = known.mapInArrow(_counts, "word bigint, t bigint, c bigint").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    counts = scratch.materialize(counts, "words")
    n_t, n_c = (x or 0 for x in counts.agg(F.sum("t"), F.sum("c")).first())
    if not n_t or not n_c:
        return None
    n, prior = n_t + n_c, PRIOR * (n_t + n_c)
    share = (F.col("t") + F.col("c")) / F.lit(float(n)) * prior
    t, c = F.col("t") + share, F.col("c") + share
    score = F.log(t / (n_t + prior - t)) - F.log(c / (n_c + prior - c))
    # Twice the log-likelihood ratio of different and equal shares of the two kinds.
    whole, log = F.col("t") + F.col("c"), lambda x, mean: F.when(x > 0, 2 * x * F.log(x / mean)).otherwise(0)
    ratio = log(F.col("t"), whole * (n_t / n)) + log(F.col("c"), whole * (n_c / n))
    # The chance of a ratio of x or more is below exp(-x / 2).
    least = 2 * math.log(max(1, counts.where("t > 0").count()) / BY_CHANCE)
    chosen = counts.where("t > 0").withColumn("score", score).where((F.col("score") >= LEAST_SCORE) & (ratio >= least))
    chosen = scratch.materialize(chosen.select("word", "score", "t", "c"), "model")
    # What the drift and the rate rest on; a word's clean chance is smoothed.
    clean = (F.col("c") + PRIOR * (F.col("t") + F.col("c"))) / (n_c + prior)
    size, toxic, clean_sum = chosen.agg(F.count("*"), F.sum("t"), F.sum(clean)).first()
    share_t = (float(toxic or 0) + 1) / (n_t + 2)
    share_c = min(0.5, (clean_sum or 0.0) + 1 / (n_c + 2))
    drift = min(-1e-3, math.log1p(-min(share_t, 0.99)) - math.log1p(-share_c))
    # Words of like counts have like scores: the rate is solved over these, of which there are few.
    levels = chosen.groupBy("t", "c").agg(F.first("score").alias("score"), F.sum(clean).alias("clean")).toPandas()
    rate = _rate(np.r_[drift, levels["score"].to_numpy(float)], np.r_[max(0.0, 1 - (clean_sum or 0.0)), levels["clean"].to_numpy(float)]) if size else 1.0
    hashes, scores = np.zeros(0, np.uint64), np.zeros(0)
    if size <= MOST_WORDS:
        rows = chosen.select("word", "score").toPandas()
        hashes, scores = rows["word"].to_numpy(np.int64).view(np.uint64), rows["score"].to_numpy(float)
        order = np.argsort(hashes)
        hashes, scores = hashes[order], scores[order]
    held = None
    if size > MOST_WORDS:
        held = chosen.select("word", "score")
        kept.append(chosen)
    draft = Model(hashes, scores, drift, rate, 1.0, held)
    least = 2 / rate
    tail = _scored(known.where("NOT toxic").select(F.lit(0).alias("id"), "text"), draft, False)
    above, words = tail.agg(F.sum(F.size(F.filter("segments", lambda s: s["score"] >= least))), F.sum("n_words")).first()
    k = ((above or 0) + 1) / max(1, words or 0) * math.exp(rate * least)
    return Model(hashes, scores, drift, rate, k, held)


def _lookup(model: Model, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the words are in the model, and their scores."""
    if not len(model.hashes):
        return np.zeros(0, np.int64), np.zeros(0)
    at = np.minimum(np.searchsorted(model.hashes, hashes), len(model.hashes) - 1)
    hit = np.flatnonzero(model.hashes[at] == hashes)
    return hit, model.scores[at[hit]]


def _lookup_own(words: pa.Array, scores: pa.Array, hashes: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same where each text brings those of its words that are in the model."""
    hits, found = [], []
    for i, (own, score) in enumerate(zip(words.to_pylist(), scores.to_pylist(), strict=True)):
        if own:
            named = np.array(own, np.int64).view(np.uint64)
            order = np.argsort(named)
            part = Model(named[order], np.array(score)[order], 0, 0, 0)
            hit, each = _lookup(part, hashes[edges[i] : edges[i + 1]])
            hits.append(hit + edges[i])
            found.append(each)
    return (np.concatenate(hits), np.concatenate(found)) if hits else (np.zeros(0, np.int64), np.zeros(0))


def _scorer(model: Model | None, significant: bool = True):
    """(id, text) batches to (id, *RESULT); ``significant``: only such segments are returned.

    Further columns (words, scores) hold, for each text, its words of a model that was not sent.
    """
    model = model and dataclasses.replace(model, words=None)

    def chance(score: float, n: int) -> float:
        return -math.expm1(-model.k * max(1, n) * math.exp(-model.rate * score))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("p_value", pa.float64())]))
        for batch in batches:
            best, found, sizes = [], [], []
            for a, b, texts in chunks(batch.column(1)):
                starts, _, hashes = texts.words()
                edges = np.searchsorted(starts, texts.offsets)
                sizes.append(np.diff(edges))
                if batch.num_columns > 2:
                    hit, scores = _lookup_own(batch.column(2).slice(a, b - a), batch.column(3).slice(a, b - a), hashes, edges)
                else:
                    hit, scores = _lookup(model, hashes) if model else (np.zeros(0, np.int64), np.zeros(0))
                cut = np.searchsorted(hit, edges)
                for i in range(b - a):
                    lo, hi = cut[i], cut[i + 1]
                    n = int(edges[i + 1] - edges[i])
                    if lo == hi:
                        best.append(1.0)
                        found.append([])
                        continue
                    each = [(f, e, s, chance(s, n)) for f, e, s in segments(scores[lo:hi].tolist(), (hit[lo:hi] - edges[i]).tolist(), model.drift)]
                    best.append(min(p for *_, p in each))
                    found.append([dict(first=f, last=e, score=s, p_value=p) for f, e, s, p in each if not significant or p < ALPHA])
            p = np.array(best)
            yield pa.record_batch([batch.column(0), pa.array(p, pa.float64()), pa.array(p < ALPHA), pa.array(np.concatenate(sizes) if sizes else [], pa.int64()), pa.array(found, kind)], names=["id", "p_value", "is_toxic", "n_words", "segments"])

    return run


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, text) to (place, word), each word of a text once."""
    for batch in batches:
        for a, _, texts in chunks(batch.column(1)):
            starts, _, hashes = texts.words()
            owner = np.searchsorted(texts.offsets, starts, side="right") - 1 + a
            pairs = np.unique(np.stack([owner.astype(np.uint64), hashes]), axis=1) if len(starts) else np.zeros((2, 0), np.uint64)
            for cut in range(0, pairs.shape[1], 1 << 16):
                part = pairs[:, cut : cut + (1 << 16)]
                yield pa.record_batch([batch.column(0).take(pa.array(part[0].astype(np.int64))), pa.array(part[1].view(np.int64))], names=["place", "word"])


def _scored(base: DataFrame, model: Model | None, significant: bool = True) -> DataFrame:
    """(id, text) to (id, *RESULT)."""
    columns = f"id {base.schema['id'].dataType.simpleString()}, {RESULT}"
    if model is None or model.words is None:
        return base.mapInArrow(_scorer(model, significant), columns)
    placed = scratch.materialize(base.withColumn("place", F.monotonically_increasing_id()), "texts")
    met = placed.select("place", "text").mapInArrow(_distinct_words, "place bigint, word bigint").join(model.words, "word")
    own = met.groupBy("place").agg(F.collect_list("word").alias("words"), F.collect_list("score").alias("scores"))
    return placed.join(own, "place", "left").select("id", "text", "words", "scores").mapInArrow(_scorer(model, significant), columns)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_LABELLED) -> DataFrame:
    """(id, p_value, is_toxic, n_words, segments) of every row; segments are in words from 0, both ends within."""
    model = fit(docs, labels, id_col, text_col, most)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return _scored(base, model).withColumnRenamed("id", id_col)


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_LABELLED) -> DataFrame:
    """The documents that are not toxic, in their own columns."""
    model = fit(docs, labels, id_col, text_col, most)
    if model is not None and model.words is not None:
        (place,) = fresh(docs.columns, 1)
        placed = scratch.materialize(docs.withColumn(place, F.monotonically_increasing_id()), "documents")
        bad = _scored(placed.select(F.col(place).alias("id"), F.col(text_col).alias("text")), model, False).where("is_toxic").select(F.col("id").alias(place))
        return placed.join(bad, place, "left_anti").select(*[quoted(c) for c in docs.columns])
    scorer = _scorer(model, False)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index(text_col)
            pair = pa.record_batch([pa.nulls(batch.num_rows, pa.int32()), batch.column(at)], names=["id", "text"])
            toxic = next(scorer(iter([pair]))).column(2)
            yield batch.filter(pc.invert(toxic))

    return docs.mapInArrow(keep, docs.schema)
