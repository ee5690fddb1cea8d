"""Hashed word n-grams of whole texts, for the trained operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from gaugeworks.llm.shared import SPACES, lower_ascii, mix, slices, span_hashes, text_bytes

_KIND = np.full(256, 2, np.uint8)  # 0: white space, 1: letters, digits and all of other scripts, 2: punctuation
_KIND[list(SPACES)] = 0
_KIND[128:] = 1
for _from, _to in ((48, 58), (65, 91), (97, 123)):
    _KIND[_from:_to] = 1


def token_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and runs of punctuation."""
    kind = _KIND[data]
    new = np.ones(len(data) + 1, bool)
    if len(data):
        new[1:-1] = kind[1:] != kind[:-1]
    new[off] = True
    at = np.flatnonzero(new)
    start, end = at[:-1], at[1:]
    keep = kind[start] > 0
    start, end = start[keep], end[keep]
    return start, end, np.searchsorted(off, start, "right") - 1


def ngrams(column: pa.Array, bits: int, longest: int = 2, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers below 2^bits of all n-grams of 1 .. longest tokens, by text, and the offset of each text."""
    data, off = text_bytes(column)
    start, end, row = token_spans(data, off)
    h = span_hashes(lower_ascii(data) if lower else data, start, end)
    rows, found = [row], [h]
    for n in range(2, longest + 1):
        if len(h) < n:
            break
        same = row[n - 1 :] == row[: 1 - n]
        joined = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            joined = mix(joined * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
        rows.append(row[: 1 - n][same])
        found.append(joined[same])
    rows, found = np.concatenate(rows), np.concatenate(found)
    order = np.argsort(rows, kind="stable")
    counts = np.bincount(rows, minlength=len(column))
    return (found[order] >> np.uint64(64 - bits)).astype(np.int64), np.concatenate([[0], np.cumsum(counts)])


def sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of values[off[i]:off[i + 1]] for each i."""
    run = np.concatenate([[0.0], np.cumsum(values)])
    return run[off[1:]] - run[off[:-1]]


def batches_of(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, column, 1 << 20)
