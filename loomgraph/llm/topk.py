"""Exact top-k neighbours by a pivot-distance index.

Index. About sqrt(n) vectors, the first by hash, are pivots; each vector is keyed by its nearest pivot and
its distance from it. The index, in the shared folder, is sorted by that key and cut into groups of about ``GROUP_BYTES``,
so that a cell, the vectors of one pivot, may lie in several groups, however many of them are alike. Within a group a cell is
cut into annuli of at most ``ANNULUS`` vectors by distance.

Search. By the triangle inequality a point x of pivot p is at least \\|d(q, p) - d(x, p)\\| from a query q. The nearest
pivots give a first bound of its k-th distance, its own group a better one; then it goes only to the groups that
this bound reaches. Inside a group each query expands from its own nearest annulus outwards, in waves of 1, 1, 2, 4 and so
on, its bound shrinks with what it finds, and it stops where the next annulus lies beyond. A task joins the points
of one group and at most ``BLOCK`` queries; points are sent once for each such block, and not at all where no query comes.

Distances are Euclidean, in double precision, by differences; dot products, with a bound of their rounding, only choose what
is computed so. Differences are scaled by powers of two, so large and small numbers neither overflow nor vanish.

Defined results: vectors that are null, hold null, NaN or infinite numbers, or have another length than most (of
two lengths as frequent the greater) are neither queries nor results; a row is no neighbour of itself, but of a row
alike at distance 0; equal distances rank by id, a null id last; with fewer than k others all are returned; null
ids are reported as null; an empty table gives an empty result; other columns are not read. A distance above the
largest double is infinite.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.plans import scratch

K = 10
ANNULUS = 256
GROUP_BYTES = 64 << 20
#: Queries that one task searches a group for.
BLOCK = 8192
#: Distances of a block of rows from all pivots that are held at once.
AT_ONCE = 1 << 22
#: Pairs whose exact distances wait to be computed.
WAITING = 1 << 20
POINT = "row bigint, id bigint, vec array<double>, asks boolean, pivot int, dist double"
QUERY = "row bigint, id bigint, vec array<double>, bound double, grp int"
FOUND = "row bigint, id bigint, other bigint, neighbor bigint, distance double"


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64) if len(column) else np.zeros((0, dim))


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows of a from the same rows of b."""
    gap = a - b
    power = np.frexp(np.abs(gap).max(1))[1]
    return np.ldexp(np.sqrt((np.ldexp(gap, -power[:, None]) ** 2).sum(1)), power)


class _Scaled:
    """Vectors times a power of two, so that no number is over 1, with their squared norms."""

    def __init__(self, vec: np.ndarray, unit: float):
        self.vec = vec * unit
        self.norm = (self.vec * self.vec).sum(1)

    def __getitem__(self, rows) -> _Scaled:
        out = object.__new__(_Scaled)
        out.vec, out.norm = self.vec[rows], self.norm[rows]
        return out


def _squares(a: _Scaled, b: _Scaled) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of all rows of a from all rows of b by dot products, and how far they may be off."""
    norms = a.norm[:, None] + b.norm[None, :]
    off = norms * (4 * (a.vec.shape[1] + 8) * np.finfo(float).eps)
    return np.maximum(norms - 2 * (a.vec @ b.vec.T), 0), off


def _usable(vectors: DataFrame, id_col: str, vector_col: str, asks: Column | None) -> tuple[DataFrame, int, int, float]:
    """(row, id, vec, asks) of comparable rows, their dimension and number, and the power of two that no number exceeds."""
    flag = F.lit(True) if asks is None else F.coalesce(asks, F.lit(False))
    base = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vec"), flag.alias("asks"))
    base = base.where("vec IS NOT NULL AND size(vec) > 0 AND NOT exists(vec, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf'))")
    largest = F.max(F.greatest(F.array_max("vec"), -F.array_min("vec")))
    sizes = base.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n"), largest.alias("most")).orderBy(F.desc("n"), F.desc("dim")).first()
    if not sizes:
        return base, 0, 0, 1.0
    numbered = base.where(F.size("vec") == sizes.dim).select(F.monotonically_increasing_id().alias("row"), "id", "vec", "asks")
    return numbered, sizes.dim, sizes.n, math.frexp(sizes.most)[1]


def _unit(power: int) -> float:
    return math.ldexp(1.0, max(-1000, min(1000, -power)))


def _step(pivots: np.ndarray) -> int:
    return max(16, AT_ONCE // len(pivots))


def _key(pivots: np.ndarray, unit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = _Scaled(pivots, unit)
        for batch in batches:
            for at in range(0, batch.num_rows, _step(pivots)):
                part = batch.slice(at, _step(pivots))
                vec = _matrix(part.column(2), pivots.shape[1])
                near = _squares(_Scaled(vec, unit), centres)[0].argmin(1)
                yield pa.record_batch([*part.columns, pa.array(near.astype(np.int32)), pa.array(_exact(vec, pivots[near]))], names=["row", "id", "vec", "asks", "pivot", "dist"])

    return run


def _pivot_bounds(pivots: np.ndarray, unit: float, k: int):
    """(row, id, vec, grp) to queries with a bound of the k-th distance: the nearest pivots are rows, one of them perhaps its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = _Scaled(pivots, unit)
        for batch in batches:
            for at in range(0, batch.num_rows, _step(pivots)):
                part = batch.slice(at, _step(pivots))
                bound = np.full(part.num_rows, np.inf)
                if len(pivots) > k:
                    squares, off = _squares(_Scaled(_matrix(part.column(2), pivots.shape[1]), unit), centres)
                    bound = np.sqrt(np.partition(squares + off, k, axis=1)[:, k]) / unit
                yield pa.record_batch([part.column(0), part.column(1), part.column(2), pa.array(bound), part.column(3)], names=["row", "id", "vec", "bound", "grp"])

    return run


def _gaps(queries: _Scaled, pivots: _Scaled, which: np.ndarray, low: np.ndarray, high: np.ndarray, unit: float) -> np.ndarray:
    """Of each query the least distance from stretches of cells: of pivot ``which``, at ``low`` to ``high`` from it."""
    squares, off = _squares(queries, pivots)
    far, off = np.sqrt(squares) / unit, np.sqrt(off) / unit
    # The root of a square that is off by x is off by sqrt(x) at most.
    # Where both sides are infinite, nothing is known.
    with np.errstate(invalid="ignore"):
        return np.nan_to_num(np.maximum(np.maximum(low - (far + off)[:, which], (far - off)[:, which] - high), 0), nan=0.0, posinf=np.inf)


def _route(pivots: np.ndarray, unit: float, stretches: dict[str, np.ndarray], groups: int):
    """Queries to a copy for each group, other than their own, that their bound reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = _Scaled(pivots, unit)
        for batch in batches:
            for at in range(0, batch.num_rows, _step(stretches["pivot"])):
                part = batch.slice(at, _step(stretches["pivot"]))
                gap = _gaps(_Scaled(_matrix(part.column(2), pivots.shape[1]), unit), centres, stretches["pivot"], stretches["low"], stretches["high"], unit)
                reach = np.zeros((part.num_rows, groups), bool)
                q, s = np.nonzero(gap <= part.column(3).to_numpy()[:, None])
                reach[q, stretches["grp"][s]] = True
                reach[np.arange(part.num_rows), part.column(4).to_numpy()] = False
                q, g = np.nonzero(reach)
                for cut in range(0, len(q), 8192):
                    own = part.take(pa.array(q[cut : cut + 8192]))
                    yield pa.record_batch([*own.columns[:4], pa.array(g[cut : cut + 8192].astype(np.int32))], names=["row", "id", "vec", "bound", "grp"])

    return run


def search_group(points: dict[str, np.ndarray], queries: dict[str, np.ndarray], pivots: np.ndarray, k: int, unit: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, distance), in order: the k nearest points of the group to each query, within its bound."""
    tie = np.empty(len(points["row"]), np.int64)
    tie[np.lexsort((points["row"], points["id"], points["null"]))] = np.arange(len(tie))
    order = np.lexsort((tie, points["dist"], points["pivot"]))
    vec, cell, dist, row, tie = (x[order] for x in (points["vec"], points["pivot"], points["dist"], points["row"], tie))
    edge = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    cuts = np.concatenate([np.arange(a, b, ANNULUS) for a, b in zip(edge, np.r_[edge[1:], len(cell)], strict=True)])
    ends = np.r_[cuts[1:], len(cell)]
    asked, held = _Scaled(queries["vec"], unit), _Scaled(vec, unit)
    used, which = np.unique(cell[cuts], return_inverse=True)
    gap = _gaps(asked, _Scaled(pivots[used], unit), which, dist[cuts], dist[ends - 1], unit)
    outwards = np.argsort(gap, axis=1, kind="stable")
    bound = queries["bound"].copy()
    #: The last place among equals of the k best so far; where the bound is 0 only earlier ones are better.
    last = np.full(len(bound), np.iinfo(np.int64).max)
    first = np.minimum.reduceat(tie, cuts)
    best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def settle() -> None:
        """Compute what waits, keep the k best of each query, and shrink its bound to the k-th."""
        nonlocal best
        q, p = (np.concatenate(x) for x in zip(*waiting, strict=True))
        waiting.clear()
        far = np.concatenate([_exact(queries["vec"][q[i : i + 65536]], vec[p[i : i + 65536]]) for i in range(0, max(1, len(q)), 65536)])
        near = far <= bound[q]
        q, p, far = (np.concatenate([x, y[near]]) for x, y in zip(best, (q, p, far), strict=True))
        order = np.lexsort((tie[p], far, q))
        q, p, far = q[order], p[order], far[order]
        start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
        turn = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
        full = np.flatnonzero(turn == k - 1)
        bound[q[full]], last[q[full]] = np.minimum(bound[q[full]], far[full]), tie[p[full]]
        best = q[turn < k], p[turn < k], far[turn < k]

    at, width = 0, 1
    while at < len(cuts):
        mine = outwards[:, at : at + width]
        reached = np.take_along_axis(gap, mine, 1) <= bound[:, None]
        if not reached.any():
            break
        reached &= (bound[:, None] > 0) | (first[mine] < last[:, None])
        who, turn = np.nonzero(reached)
        annulus = mine[who, turn]
        by = np.argsort(annulus, kind="stable")
        who, annulus = who[by], annulus[by]
        some = 0
        for own in np.split(np.arange(len(who)), np.flatnonzero(np.diff(annulus)) + 1) if len(who) else ():
            a, ask = annulus[own[0]], who[own]
            here = slice(cuts[a], ends[a])
            squares, off = _squares(asked[ask], held[here])
            near = squares <= ((bound[ask] * unit) ** 2)[:, None] + off
            near &= (bound[ask] > 0)[:, None] | (tie[None, here] < last[ask][:, None])
            q, p = np.nonzero(near)
            q, p = ask[q], p + cuts[a]
            other = queries["row"][q] != row[p]
            waiting.append((q[other], p[other]))
            some += int(other.sum())
            if some >= WAITING:
                settle()
                some = 0
        if waiting:
            settle()
        at, width = at + width, max(1, at + width)
    q, p, far = best
    return q, order[p], far


def _search(pivots: np.ndarray, k: int, unit: float):
    def side(table: pa.Table, more: tuple[str, ...]) -> dict[str, np.ndarray]:
        null = table.column("id").is_null().to_numpy()
        return {c: table.column(c).to_numpy() for c in ("row", *more)} | {"vec": _matrix(table.column("vec"), pivots.shape[1]), "id": np.where(null, 0, table.column("id").fill_null(0).to_numpy()), "null": null}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        points, queries = side(left, ("pivot", "dist")), side(right, ("bound",))
        if len(points["row"]) and len(queries["row"]):
            q, p, far = search_group(points, queries, pivots, k, unit)
        else:
            q = p = np.zeros(0, np.int64)
            far = np.zeros(0)
        return pa.table({"row": queries["row"][q], "id": pa.array(queries["id"][q], pa.int64(), mask=queries["null"][q]), "other": points["row"][p], "neighbor": pa.array(points["id"][p], pa.int64(), mask=points["null"][p]), "distance": far})

    return run


def _join(index: DataFrame, queries: DataFrame, pivots: np.ndarray, k: int, unit: float) -> DataFrame:
    """What the queries (row, id, vec, bound, grp) find, each in its group."""
    spark = index.sparkSession
    # One row a group.
    blocks = [(r.grp, math.ceil(r.n / BLOCK)) for r in queries.groupBy("grp").agg(F.count("*").alias("n")).collect()]
    sizes = spark.createDataFrame(blocks, "grp int, blocks int")
    points = index.join(sizes, "grp").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = queries.join(sizes, "grp").withColumn("block", F.pmod(F.xxhash64("row"), "blocks").cast("int"))
    keys = ["grp", "block"]
    return points.select(*keys, "row", "id", "vec", "pivot", "dist").groupBy(*keys).cogroup(asked.select(*keys, "row", "id", "vec", "bound").groupBy(*keys)).applyInArrow(_search(pivots, k, unit), FOUND)


def top_k(vectors: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", asks: Column | None = None) -> DataFrame:
    """(id, rank, neighbor_id, distance) of the k nearest others of every vector, or of those that ``asks`` is true of; ranks count from 1."""
    spark = vectors.sparkSession
    result = f"{id_col} bigint, rank int, neighbor_id bigint, distance double"
    base, dim, n, power = _usable(vectors, id_col, vector_col, asks)
    if n < 2:
        return spark.createDataFrame([], result)
    unit = _unit(power)
    # sqrt(n) pivots: 31,000, or 16 MB of 64 numbers each, for 10 ** 9 vectors.
    rows = base.orderBy(F.xxhash64("vec"), "row").limit(math.ceil(math.sqrt(n))).select("vec").collect()
    pivots = np.unique(np.array([r.vec for r in rows]), axis=0)
    keyed = scratch.materialize(base.mapInArrow(_key(pivots, unit), POINT), "keyed")
    groups = max(math.ceil(n * dim * 8 / GROUP_BYTES), min(spark.sparkContext.defaultParallelism, math.ceil(n / 4096)))
    ordered = keyed.repartitionByRange(groups, "pivot", "dist", "row").sortWithinPartitions("pivot", "dist", "row")
    index = scratch.materialize(ordered.withColumn("grp", F.spark_partition_id()), "index")
    scratch.drop(keyed)
    # A row for each pivot and group at most.
    cells = index.groupBy("grp", "pivot").agg(F.min("dist").alias("low"), F.max("dist").alias("high")).toPandas()
    stretches = {c: cells[c].to_numpy() for c in ("grp", "pivot", "low", "high")}
    home = index.where("asks").select("row", "id", "vec", "grp").mapInArrow(_pivot_bounds(pivots, unit, k), QUERY)
    home = scratch.materialize(home, "queries")
    near = scratch.materialize(_join(index, home, pivots, k, unit), "near")
    reached = near.groupBy("row").agg(F.max("distance").alias("kth"), F.count("*").alias("n")).where(F.col("n") >= k).select("row", "kth")
    bounded = home.join(reached, "row", "left").select("row", "id", "vec", F.least("bound", "kth").alias("bound"), "grp")
    routed = bounded.mapInArrow(_route(pivots, unit, stretches, groups), QUERY)
    far = _join(index, routed, pivots, k, unit)
    best = Window.partitionBy("row").orderBy("distance", F.col("neighbor").isNull(), "neighbor", "other")
    ranked = near.unionAll(far).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    out = scratch.materialize(ranked.select(F.col("id").alias(id_col), "rank", F.col("neighbor").alias("neighbor_id"), "distance"), "neighbours")
    scratch.drop(index, home, near)
    return out
