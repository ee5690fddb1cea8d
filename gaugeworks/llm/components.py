"""Connected components of a link table by rounds of random contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.shared import join_hot, saved

#: Links that one task may hold.
SMALL = 1 << 16


def _united(links: DataFrame) -> DataFrame:
    """Rows (node, root) of at most SMALL links, by one task."""

    def unite(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"a": [], "b": []}, dtype=object), *frames])
        code, nodes = pd.factorize(np.concatenate([rows["a"].to_numpy(object), rows["b"].to_numpy(object)]), sort=True)
        root = list(range(len(nodes)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for a, b in code.reshape(2, -1).T.tolist():
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        yield pd.DataFrame({"node": nodes, "root": nodes[[find(i) for i in range(len(nodes))]] if len(nodes) else nodes})

    kind = links.schema["a"].dataType.simpleString()
    return links.coalesce(1).mapInPandas(unite, f"node {kind}, root {kind}")


def components(links: DataFrame, small: int = SMALL) -> DataFrame:
    """links: (a, b) of any ordered type. Rows (node, root) for each node with a link; root is one node of the component, the same for all of it.

    In each round every node moves to the neighbour with the smallest random number of the round, or stays if its own is
    smaller; links move along and those within a node go. Whatever the graph, a fixed share of the nodes goes in a round
    on average (half of them on a path, whatever its order), so the rounds are about the logarithm of the nodes. When at
    most `small` links are left, one task ends the work. The moves are then followed from the last round to the first.
    Only row counts reach the driver.
    """

    def oriented(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    left, moves = saved(oriented(links), "links"), []
    while left.count() > small:
        draw = lambda c: F.struct(F.xxhash64(c, F.lit(len(moves))).alias("draw"), F.col(c).alias("node"))
        ends = left.select("a", "b").union(left.select("b", "a"))
        near = ends.groupBy("a").agg(F.min(draw("b")).alias("best"))
        to = saved(near.select(F.col("a").alias("node"), F.least("best", draw("a"))["node"].alias("to")), "moves")
        moves.append(to)
        for side in ("a", "b"):
            left = join_hot(left, to.withColumnRenamed("node", side), side).drop(side).withColumnRenamed("to", side).select("a", "b")
            left = saved(oriented(left) if side == "b" else left, "links")
    labels = saved(_united(left), "labels")
    for to in reversed(moves):
        labels = join_hot(to, labels.withColumnRenamed("node", "to"), "to", "left").select("node", F.coalesce("root", "to").alias("root"))
        labels = saved(labels, "labels")
    return labels
