"""Operator 7: approximate nearest neighbours by inner product.

Vectors get one more component that gives all the same length, so that the largest inner product is the smallest
distance. A few Gaussian (2-stable) projections of each are indexed by a kd-tree in two parts: its upper levels, fitted
on the projections of at most SAMPLE rows, deal all rows into cells; below, each cell is cut further into leaves with
bounding boxes. A query searches its own cell first, then walks the upper levels and opens the other cells that can
still hold a better point. Within a cell, leaves are opened by their boxes and the points in them by their own
projected distance, and what is opened is verified exactly. All of this is decided by one chi-square test: the squared
projected distance of a point, divided by its squared true distance, has a chi-square distribution, so a point whose
squared projected distance is over `far` times the squared distance of the k-th best so far (far: that distribution's
quantile at SURE) is better with probability 1 - SURE at most. What the test can't rule out is searched exhaustively.

Of equal vectors only the k + 1 with the smallest ids are indexed: no other can be among the k best. Cells with more
rows than BLOCK are cut by hash, and so are the queries of a cell, so no group grows with the data.

Vectors that are null, zero, or hold a null or non-finite component take no part, nor do rows without an id. Shorter
vectors are filled with zeros. Rows that repeat an id count once (the smallest vector). Ties go to smaller ids. With fewer
candidates than k, all are returned; an empty table gives an empty result. Other columns are not looked at. Vectors are
scaled by a power of two before they are compared, so results don't depend on their unit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.shared import saved

DIMS, LEAF, BLOCK, QUERIES, SURE, SEED, SAMPLE = 10, 128, 16_384, 1024, 0.9, 7, 1 << 16


def chi_square(x: float, dims: int = DIMS) -> float:
    """Distribution function for an even number of dimensions."""
    term = total = 1.0
    for k in range(1, dims // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def quantile(p: float, dims: int = DIMS) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, dims) < p else (low, mid)
    return high


def projection(size: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((size, DIMS))


@dataclass(frozen=True)
class Space:
    """What all tasks know of the vectors: components, the power of two that scales them, largest squared length after scaling."""

    size: int
    scale: float
    longest: float

    def scaled(self, raw: np.ndarray) -> np.ndarray:
        return raw * self.scale

    def points(self, v: np.ndarray, query: bool = False) -> np.ndarray:
        """Projections of scaled vectors; a query's added component is 0."""
        more = np.zeros(len(v)) if query else np.sqrt(np.maximum(0, self.longest - (v * v).sum(axis=1)))
        return np.hstack([v, more[:, None]]) @ projection(self.size + 1)


@dataclass(frozen=True)
class Tree:
    """Upper levels: node i has the children 2 i + 1 and 2 i + 2; the last level's are the cells."""

    depth: int
    axis: np.ndarray
    cut: np.ndarray

    @staticmethod
    def fit(points: np.ndarray, depth: int) -> Tree:
        axis, cut = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
        rows = {0: np.arange(len(points))}
        for node in range(len(axis)):
            at = rows.pop(node)
            if len(at):
                axis[node] = np.argmax(np.ptp(points[at], axis=0))
                cut[node] = np.median(points[at, axis[node]])
            right = points[at, axis[node]] >= cut[node]
            rows[2 * node + 1], rows[2 * node + 2] = at[~right], at[right]
        return Tree(depth, axis, cut)

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] >= self.cut[node])
        return node - len(self.axis)

    def walk(self, points: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all cells whose region lies within a squared distance of a point. Subtrees beyond it are not entered."""
        row, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        away = np.zeros((len(points), DIMS))  # by dimension, of a node's region
        for _ in range(self.depth):
            axis = self.axis[node]
            gap = points[row, axis] - self.cut[node]
            every = np.arange(len(row))
            parts = []
            for side in (0, 1):
                d = away.copy()
                d[every, axis] = np.maximum(d[every, axis], np.maximum(0, gap if side == 0 else -gap))
                near = (d * d).sum(axis=1) <= within[row]
                parts.append((row[near], (2 * node + 1 + side)[near], d[near]))
            row, node, away = (np.concatenate(x) for x in zip(*parts, strict=True))
        return row, node - len(self.axis)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (vec_id, v array<double>)."""
    v = F.col(vector_col).cast("array<double>")
    good = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    return good.groupBy("vec_id").agg(F.min("v").alias("v"))


def leaves_of(points: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Cuts points at the median of their widest dimension until a leaf has at most `leaf` of them."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            out.append(np.sort(rows))
            continue
        values = points[rows]
        values = values[:, np.argmax(np.ptp(values, axis=0))]
        order = np.argpartition(values, len(rows) // 2)
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return out


def build_block(rows: pd.DataFrame, space: Space) -> pd.DataFrame:
    """Rows (low, high, ids, points, vectors), one for each leaf, of rows (vec_id, v)."""
    rows = rows.sort_values("vec_id")
    v, ids = np.stack(rows["v"].to_numpy()), rows["vec_id"].to_numpy()
    points = space.points(space.scaled(v))
    cut = leaves_of(points)
    return pd.DataFrame({
        "low": [points[r].min(axis=0) for r in cut], "high": [points[r].max(axis=0) for r in cut], "ids": [ids[r] for r in cut],
        "points": [points[r].tobytes() for r in cut], "vectors": [v[r].tobytes() for r in cut],
    })


def search_block(raw: np.ndarray, own: np.ndarray, bound: np.ndarray, leaves: pd.DataFrame, k: int, space: Space) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[float, float]]:
    """(row of the query, id, score) of each query's best of a block, k at most, and the shares of leaves opened and of vectors verified.

    bound: the k-th best score so far, of scaled vectors (-inf: none).
    """
    n, q, far = len(raw), space.scaled(raw), quantile(SURE)
    low, high = np.stack(leaves["low"].to_numpy()), np.stack(leaves["high"].to_numpy())
    ids = [np.asarray(x) for x in leaves["ids"]]
    stored = [np.frombuffer(x).reshape(-1, space.size) for x in leaves["vectors"]]
    vectors, points = [space.scaled(x) for x in stored], [np.frombuffer(x).reshape(-1, DIMS) for x in leaves["points"]]
    place = space.points(q, query=True)
    away = np.zeros((n, len(ids)))
    for d in range(DIMS):
        x = place[:, d, None]
        away += np.maximum(0, np.maximum(low[None, :, d] - x, x - high[None, :, d])) ** 2
    best, score = np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -np.inf)
    where = np.zeros((n, k, 2), np.int32)
    squared = (q * q).sum(axis=1)
    length, slack = squared + space.longest, 1e-13 * space.size * np.sqrt(squared * space.longest)
    opened = verified = 0

    def verify(rows: np.ndarray, leaf: int) -> None:
        nonlocal opened, verified
        kth = np.maximum(bound[rows], score[rows, -1])
        reach = far * np.maximum(0, length[rows] - 2 * kth)
        go = away[rows, leaf] <= reach
        rows, kth, reach = rows[go], kth[go], reach[go]
        if not len(rows):
            return
        p = points[leaf]
        apart = (place[rows] ** 2).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2 * place[rows] @ p.T
        near = (apart <= reach[:, None] * (1 + 1e-9)) & (ids[leaf][None, :] != own[rows][:, None])
        opened, verified = opened + len(rows), verified + int(near.sum())
        hit = near & (q[rows] @ vectors[leaf].T >= (kth - slack[rows])[:, None])
        r, c = np.nonzero(hit)
        if not len(r):
            return
        # A pair's sum is taken in the same order wherever it stands, so equal vectors tie.
        value = np.full(hit.shape, -np.inf)
        value[r, c] = (q[rows[r]] * vectors[leaf][c]).sum(axis=1)
        some = np.unique(r)
        who = rows[some]
        v, i = np.hstack([score[who], value[some]]), np.hstack([best[who], np.broadcast_to(ids[leaf], (len(some), len(p)))])
        spot = np.concatenate([where[who], np.broadcast_to(np.stack([np.full(len(p), leaf), np.arange(len(p))], axis=1), (len(some), len(p), 2))], axis=1)
        top = np.lexsort((i, -v), axis=1)[:, :k]
        score[who], best[who] = np.take_along_axis(v, top, axis=1), np.take_along_axis(i, top, axis=1)
        where[who] = np.take_along_axis(spot, top[:, :, None], axis=1)

    first = away.argmin(axis=1)
    for leaf in np.unique(first).tolist():
        verify(np.flatnonzero(first == leaf), leaf)
    for leaf in range(len(ids)):
        verify(np.flatnonzero(first != leaf), leaf)
    row, column = np.nonzero(score > -np.inf)
    found = where[row, column]
    exact = np.array([stored[a][b] for a, b in found.tolist()]).reshape(len(row), space.size)
    total = max(1, sum(map(len, ids)) * n)
    return row, best[row, column], (raw[row] * exact).sum(axis=1), (opened / max(1, n * len(ids)), verified / total)


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) for the queries, the rows whose id is divisible by `every`."""
    spark = vectors.sparkSession
    good = saved(usable(vectors, id_col, vector_col), "vectors")
    size, n, biggest = good.agg(F.max(F.size("v")), F.count("*"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()
    size, scale = size or 1, 2.0 ** -max(-1000, min(1000, math.frexp(biggest or 1.0)[1]))
    longest = good.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * scale * x * scale))).first()[0]
    space = Space(size, scale, longest or 1.0)
    depth = max(0, math.ceil(math.log2(max(1, n / block))))
    filled = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(size) - F.size("v")))
    same = Window.partitionBy("v").orderBy("vec_id")
    kept = good.select("vec_id", filled.alias("v")).withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1).select("vec_id", "v")

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = space.points(space.scaled(_matrix(batch.column(0), size)))
            yield pa.RecordBatch.from_arrays([pa.array(list(p), pa.list_(pa.float64()))], names=["p"])

    sample = good.select("vec_id", filled.alias("v")).orderBy(F.xxhash64("vec_id", F.lit(SEED))).limit(SAMPLE if depth else 0)
    some = sample.select("v").mapInArrow(project, "p array<double>").toArrow()  # DIMS numbers for each of SAMPLE rows at most
    tree = Tree.fit(_matrix(some["p"].combine_chunks(), DIMS) if depth else np.zeros((0, DIMS)), depth)
    shared = spark.sparkContext.broadcast(tree)

    def placing(query: bool):
        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = shared.value.cell(space.points(space.scaled(_matrix(batch.column(1), size)), query))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=["vec_id", "v", "cell"])

        return place

    placed = saved(kept.mapInArrow(placing(False), "vec_id long, v array<double>, cell int"), "placed")
    # One row for each cell, that is for each `block` vectors or so; a cell with more is cut.
    cells = saved(placed.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("subs")), "cells")
    blocked = placed.join(cells, "cell").select("cell", F.pmod(F.xxhash64("vec_id"), F.col("subs")).cast("int").alias("sub"), "vec_id", "v")

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return build_block(rows, space).assign(cell=key[0], sub=key[1])

    index = saved(blocked.groupBy("cell", "sub").applyInPandas(build, "cell int, sub int, low array<double>, high array<double>, ids array<long>, points binary, vectors binary"), "index")
    asked = good.select("vec_id", filled.alias("v")).where(F.pmod("vec_id", F.lit(every)) == 0)
    asked = saved(asked.mapInArrow(placing(True), "vec_id long, v array<double>, cell int"), "queries")

    def search(key: tuple, leaves: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(leaves) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        raw, own = np.stack(queries["v"].to_numpy()), queries["vec_id"].to_numpy()
        row, found, score, _ = search_block(raw, own, queries["kth"].to_numpy(), leaves, k, space)
        return pd.DataFrame({"query_id": own[row], "vec_id": found, "score": score})

    def opened(queries: DataFrame) -> DataFrame:
        """queries: (vec_id, v, kth, cell), a row for each cell to be opened."""
        there = queries.join(cells, "cell").withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
        parts = there.groupBy("cell", "sub").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
        right = there.join(parts, ["cell", "sub"]).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit("part")), F.col("parts")).cast("int"))
        left = index.join(parts, ["cell", "sub"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        right = right.select("cell", "sub", "part", "vec_id", "v", "kth")
        return left.drop("parts").groupBy("cell", "sub", "part").cogroup(right.groupBy("cell", "sub", "part")).applyInPandas(search, "query_id long, vec_id long, score double")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)
    out = ranked(opened(asked.withColumn("kth", F.lit(-math.inf))))
    if depth:
        out = saved(out, "own-cell")
        kth = out.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), (F.col("score") * scale * scale).alias("kth"))
        known = asked.join(kth, "vec_id", "left").select("vec_id", "v", F.coalesce("kth", F.lit(-math.inf)).alias("kth"), "cell")

        def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            far = quantile(SURE)
            for batch in batches:
                for at in range(0, batch.num_rows, QUERIES):
                    part = batch.slice(at, QUERIES)
                    q = space.scaled(_matrix(part.column(1), size))
                    kth, home = part.column(2).to_numpy(), part.column(3).to_numpy()
                    within = far * np.maximum(0, (q * q).sum(axis=1) + space.longest - 2 * kth)
                    row, cell = shared.value.walk(space.points(q, query=True), within)
                    more = cell != home[row]
                    row, cell = pa.array(row[more]), pa.array(cell[more].astype(np.int32))
                    yield pa.RecordBatch.from_arrays([*[part.column(i).take(row) for i in range(3)], cell], names=["vec_id", "v", "kth", "cell"])

        second = opened(known.mapInArrow(others, "vec_id long, v array<double>, kth double, cell int"))
        out = ranked(out.drop("rank").unionByName(second))
    return out.select("query_id", "rank", "vec_id", "score")


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
