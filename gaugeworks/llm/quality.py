"""Operator 5: quality classifier.

Logistic regression over hashed word n-grams (words and runs of punctuation, alone and in pairs), trained with
follow-the-regularised-leader updates on several shards whose weights are averaged, and scored as sparse dot
products: a text's value of a feature is its share of the text's n-grams.

Training uses at most `max_rows` labelled rows (those with the smallest hash of their id); every text is scored whole.
Nulls and empty texts get the score of the bias alone. Labels that are null are left out; an id labelled more than
once counts as labelled 1 if at least half of its labels are 1. Without any label the score is 0.5. Repeated rows
give repeated rows, an empty table an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.features import batches_of, ngrams, sums

BITS, MAX_ROWS, SHARDS, SCALE = 18, 8192, 4, 16.0


def fold(id_col: Column) -> Column:
    """0 to 4; 0 is held out."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5


def sample(labels: DataFrame, label: str, max_rows: int, id_col: str = "doc_id") -> DataFrame:
    """Rows (label_id, label) of at most max_rows labelled ids that are not held out."""
    return (
        labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & (fold(F.col(id_col)) != 0))
        .groupBy(F.col(id_col).alias("label_id")).agg((F.avg(label) >= 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("label_id"), "label_id").limit(max_rows)
    )


class Leader:
    """Follow the (proximally) regularised leader, by coordinate."""

    def __init__(self, size: int, rate: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> None:
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.rate, self.beta, self.l1, self.l2 = rate, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.rate + self.l2))

    def update(self, at: np.ndarray, w: np.ndarray, g: np.ndarray) -> None:
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.rate * w
        self.n[at] = n + g * g


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, epochs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Weights by feature; the last is the bias. Their number is fixed, so they may pass through the driver."""
    chosen = sample(labels, label, max_rows, id_col)
    texts = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), F.col(id_col) == F.col("label_id"))
    texts = texts.select(F.pmod(F.xxhash64("label_id", F.lit("shard")), F.lit(SHARDS)).cast("int").alias("shard"), F.xxhash64("label_id", "text").alias("place"), "label", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches_of(batches):
            found, off = ngrams(part.column("text"), BITS)
            pairs = [np.unique(found[a:b], return_counts=True) for a, b in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:3], pa.array([p[0].astype(np.int32) for p in pairs], pa.list_(pa.int32())), pa.array([(p[1] / max(1, p[1].sum())).astype(np.float32) for p in pairs], pa.list_(pa.float32()))],
                names=["shard", "place", "label", "at", "share"],
            )

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place", kind="stable")
        model = Leader((1 << BITS) + 1)
        for _ in range(epochs):
            for at, share, y in zip(rows["at"], rows["share"], rows["label"], strict=True):
                at, x = np.append(at, 1 << BITS), np.append(share.astype(float) * SCALE, 1.0)
                w = model.weights(at)
                p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
                model.update(at, w, (p - y) * x)
        w = model.weights()
        at = np.flatnonzero(w)
        return pd.DataFrame({"at": at.astype(np.int32), "w": w[at], "rows": len(rows)})

    rows = texts.mapInArrow(hashed, "shard int, place long, label int, at array<int>, share array<float>")
    fitted = rows.groupBy("shard").applyInPandas(fit, "at int, w double, rows long")
    mean = fitted.groupBy("at").agg((F.sum(F.col("w")) / SHARDS).alias("w")).toArrow()
    weights = np.zeros((1 << BITS) + 1)
    weights[mean["at"].to_numpy()] = mean["w"].to_numpy()
    return weights


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, name: str = "score") -> DataFrame:
    """Rows (id, score), or with keep all columns of docs and the score under `name`; a column of that name goes."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(weights)
    out = docs.drop(name) if keep else docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    names = out.columns
    where = names.index(text_col if keep else "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for part in batches_of(batches, names[where]):
            found, off = ngrams(part.column(where), BITS)
            s = sums(w[found], off) / np.maximum(1, np.diff(off)) * SCALE + w[-1]
            p = pa.array(1 / (1 + np.exp(-np.clip(s, -35, 35))))
            yield pa.RecordBatch.from_arrays([*part.columns, p] if keep else [part.column(0), p], names=[*names, name] if keep else [id_col, name])

    schema = out.schema if keep else out.select(id_col).schema
    return out.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields) + f", `{name}` double")
