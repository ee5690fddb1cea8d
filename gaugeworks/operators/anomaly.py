"""Isolation forest: trees grow apart from small hashed samples of normal rows; every row is scored against all of them.

What is broadcast has a fixed bound: `trees` trees of at most 2 * `sample` nodes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.ranking import column_quantiles

EULER = 0.5772156649015329


def expected_depth(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a random tree of n rows."""
    n = np.asarray(n, float)
    m = np.maximum(n - 1, 1)
    return np.where(n > 2, 2 * (np.log(m) + EULER) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def samples(df: DataFrame, id_col: str, trees: int, sample: int, seed: int) -> DataFrame:
    """Adds tree: each tree takes the `sample` rows that a hash of (seed, tree, id) puts first. Rows are thinned before
    they are ordered, to one and a half times what is needed, so no tree sees the whole table."""
    n = df.count()
    share = min(1.0, (1.5 * sample + 40) / max(n, 1))
    place = lambda t: F.xxhash64(F.lit(seed), t, F.col(id_col))
    edge = int(-(1 << 63) + share * ((1 << 64) - 1)) if share < 1 else (1 << 63) - 1
    chosen = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: place(t) <= F.lit(edge))
    drawn = df.withColumn("tree", F.explode(chosen))
    w = Window.partitionBy("tree").orderBy(place(F.col("tree")), id_col)
    return drawn.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= sample).drop("_i")


def grow(drawn: DataFrame, features: list[str], id_col: str, sample: int, seed: int) -> DataFrame:
    """Rows (tree, node, feature, edge, left, right, size): inner nodes split at a random value of a random feature that varies; size is a leaf's."""
    limit = math.ceil(math.log2(max(sample, 2)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col, kind="stable")
        x, tree = pdf[features].to_numpy(float), int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        nodes, todo = [], [(np.arange(len(x)), 0, -1, "")]
        while todo:
            rows, depth, parent, side = todo.pop()
            at = len(nodes)
            if parent >= 0:
                nodes[parent][side] = at
            node = {"tree": tree, "node": at, "feature": -1, "edge": 0.0, "left": -1, "right": -1, "size": len(rows)}
            nodes.append(node)
            part = x[rows]
            varying = np.flatnonzero(part.max(0) > part.min(0)) if len(rows) > 1 and depth < limit else []
            if len(varying):
                f = int(rng.choice(varying))
                edge = float(rng.uniform(part[:, f].min(), part[:, f].max()))
                below = part[:, f] <= edge
                if below.all():  # the draw met the largest value
                    edge, below = float(part[:, f].min()), part[:, f] <= part[:, f].min()
                node |= {"feature": f, "edge": edge}
                todo += [(rows[~below], depth + 1, at, "right"), (rows[below], depth + 1, at, "left")]
        return pd.DataFrame(nodes)

    schema = "tree int, node int, feature int, edge double, left int, right int, size int"
    return drawn.select(id_col, "tree", *[F.col(c).cast("double") for c in features]).groupBy("tree").applyInPandas(one, schema)


def isolation_forest(train: DataFrame, df: DataFrame, features: list[str], id_col: str, trees: int = 200, sample: int = 256, seed: int = 20260822) -> DataFrame:
    """Adds score (0 to 1, higher: more isolated) to df. train holds normal rows only; missing values take train's medians.
    An empty train table gives an error, an empty df an empty result."""
    stats = column_quantiles(train.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in features]), features)
    if any(stats[c] is None for c in features):
        raise ValueError("a feature without a value in the training rows")
    filled = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(float(stats[c])))
    clean = lambda d: d.select("*", *[filled(c).alias(f"_x{i}") for i, c in enumerate(features)])
    names = [f"_x{i}" for i in range(len(features))]
    # Splits are drawn within a feature's own range, so scaling would change nothing but the numbers in the trees.
    forest = grow(samples(clean(train).select(id_col, *names), id_col, trees, sample, seed), names, id_col, sample, seed).toPandas()
    forest = forest.sort_values(["tree", "node"])
    grown = [{c: g[c].to_numpy() for c in ("feature", "edge", "left", "right", "size")} for _, g in forest.groupby("tree")]
    usual = float(expected_depth(np.array([g["size"][0] for g in grown])).mean()) or 1.0
    shared = df.sparkSession.sparkContext.broadcast(grown)

    @F.pandas_udf("double")
    def isolation(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for part in parts:
            x = part.to_numpy(float)
            depth = np.zeros(len(x))
            for g in shared.value:
                at, steps = np.zeros(len(x), int), np.zeros(len(x))
                while len(go := np.flatnonzero(g["feature"][at] >= 0)):
                    here = at[go]
                    below = x[go, g["feature"][here]] <= g["edge"][here]
                    at[go] = np.where(below, g["left"][here], g["right"][here])
                    steps[go] += 1
                depth += steps + expected_depth(g["size"][at])
            yield pd.Series(np.power(2.0, -depth / len(shared.value) / usual))

    return clean(df).withColumn("score", isolation(F.struct(*names))).drop(*names)
