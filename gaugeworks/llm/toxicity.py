"""Operator 8: toxicity by cumulative-link ordinal regression.

P(grade >= k) = sigmoid(w . x - t_k) with one weight vector for all of the ordered thresholds t_1 < t_2 < ...; x holds
the distinct hashed words of a text and the first bytes of its longer words, each by its inverse document frequency in
the training rows, scaled to one length for all texts. Weights of either sign are learnt for every feature. The result
is the expected severity, the sum of P(grade >= k).

The labels only say toxic or not. A first fit has one threshold. Its scores part the toxic training texts at their
median into grades 1 and 2, and the second fit learns both thresholds from these grades.

Training uses at most `max_rows` labelled rows (smallest hash of the id) that are not held out; each text is scored
whole. Nulls and empty texts have the severity of the thresholds alone. Null labels are left out; repeated rows give
repeated rows; an empty table gives an empty result; without toxic labels all severities are near 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.features import batches_of, sums, token_spans
from gaugeworks.llm.quality import Leader, sample
from gaugeworks.llm.shared import lower_ascii, mix, span_hashes, text_bytes

BITS, MAX_ROWS, LENGTH = 20, 8192, 4.0
#: A text has the highest grade k with P(grade >= k) of this at least.
CUT = 0.2


def marks(column: pa.Array, head: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Words and, for longer ones, their first bytes as features, by text; texts may repeat some. And each text's offset."""
    data, off = text_bytes(column)
    data = lower_ascii(data)
    start, end, row = token_spans(data, off)
    long = end - start > head
    found = np.concatenate([span_hashes(data, start, end), mix(span_hashes(data, start[long], start[long] + head))])
    rows = np.concatenate([row, row[long]])
    order = np.argsort(rows, kind="stable")
    return (found[order] >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(column)))])


def _distinct(found: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of each text, and their offsets."""
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    key = np.unique(row << BITS | found)
    return key & (1 << BITS) - 1, np.concatenate([[0], np.cumsum(np.bincount(key >> BITS, minlength=len(off) - 1))])


def values(idf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Each feature's idf, scaled so that the values of a text have the length LENGTH."""
    return idf * np.repeat(LENGTH / np.sqrt(np.maximum(sums(idf * idf, off), 1e-12)), np.diff(off))


def fit_grades(features: list[np.ndarray], x: list[np.ndarray], grade: np.ndarray, epochs: int, rate: float = 1.0, l1: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights by feature and one threshold for each grade above 0."""
    top = max(1, int(grade.max(initial=0)))
    model = Leader(1 << BITS, rate=rate, l1=l1, l2=0.0)
    t, seen = 2.0 + 1.5 * np.arange(top), np.ones(top)
    for _ in range(epochs):
        for at, v, k in zip(features, x, grade, strict=True):
            w = model.weights(at)
            reach = np.concatenate([[1.0], 1 / (1 + np.exp(-np.clip(v @ w - t, -35, 35))), [0.0]])  # P(grade >= 0 ..)
            p = max(reach[k] - reach[k + 1], 1e-6)
            model.update(at, w, v * (reach[k] + reach[k + 1] - 1))
            slope = reach[1:-1] * (1 - reach[1:-1])
            g = np.zeros(top)  # of the loss, by threshold
            if k > 0:
                g[k - 1] += slope[k - 1] / p
            if k < top:
                g[k] -= slope[k] / p
            seen += g * g
            t = np.sort(t - 0.3 * g / np.sqrt(seen))
            t = np.maximum(t, t[0] + 1e-3 * np.arange(top))
    return model.weights(), t


def fit(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights and document counts by feature, and the thresholds, of rows (at, label)."""
    features, y = [np.asarray(a) for a in rows["at"]], rows["label"].to_numpy()
    seen = np.zeros(1 << BITS, np.int64)
    for at in features:
        seen[at] += 1
    idf = np.log((1 + len(y)) / (1 + seen))
    x = [values(idf[at], np.array([0, len(at)])) for at in features]
    w, _ = fit_grades(features, x, (y > 0).astype(int), 6)
    score = np.array([v @ w[at] for at, v in zip(features, x, strict=True)])
    middle = np.median(score[y > 0]) if (y > 0).any() else 0.0
    w, t = fit_grades(features, x, np.where(y > 0, np.where(score > middle, 2, 1), 0), 8)
    return w, seen, t if len(t) == 2 else np.array([t[0], max(35.0, t[0] + 1)])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, thresholds and inverse document frequencies."""
    chosen = sample(labels, label, max_rows, id_col)
    texts = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), F.col(id_col) == F.col("label_id"))
    texts = texts.select(F.xxhash64("label_id", "text").alias("place"), "label", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches_of(batches):
            found, off = marks(part.column("text"))
            at, to = _distinct(found, off)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:2], pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.array(at.astype(np.int32)))],
                names=["place", "label", "at"],
            )

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        w, seen, t = fit(rows.sort_values("place", kind="stable"))
        at = np.flatnonzero(seen)
        return pd.DataFrame({"at": np.concatenate([at, [-1, -2, -3]]).astype(np.int32), "w": np.concatenate([w[at], t, [float(len(rows))]]), "seen": np.concatenate([seen[at], [0, 0, 0]])})

    rows = texts.mapInArrow(hashed, "place long, label int, at array<int>")
    found = rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(fitted, "at int, w double, seen long").toArrow()  # a bounded sample in, at most 2^BITS features out
    at, w, seen = (found[c].to_numpy() for c in ("at", "w", "seen"))
    extra = {int(k): v for k, v in zip(at[at < 0], w[at < 0], strict=True)}
    weights, counts = np.zeros(1 << BITS), np.zeros(1 << BITS)
    weights[at[at >= 0]], counts[at[at >= 0]] = w[at >= 0], seen[at >= 0]
    return weights, np.array([extra.get(-1, 35.0), extra.get(-2, 36.0)]), np.log((1 + extra.get(-3, 0.0)) / (1 + counts))


def severity(docs: DataFrame, weights: np.ndarray, thresholds: np.ndarray, idf: np.ndarray, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, expected_severity, grade): grade is the highest k with P(grade >= k) of `cut` at least."""
    shared = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), thresholds, idf.astype(np.float32)))
    docs = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, t, rarity = shared.value
        for part in batches_of(batches):
            at, to = _distinct(*marks(part.column(1)))
            s = sums(w[at] * values(rarity[at].astype(float), to), to)
            reach = 1 / (1 + np.exp(-np.clip(s[:, None] - t[None, :], -35, 35)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(reach.sum(axis=1)), pa.array((reach >= cut).sum(axis=1).astype(np.int32))], names=[id_col, "expected_severity", "grade"])

    return docs.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, expected_severity double, grade int")
