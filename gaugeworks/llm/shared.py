"""Helpers shared by the training-data operators: scratch tables, bounded bitmaps and hashing of words in Arrow batches."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that part words: space and 0x09-0x0D. None of them occurs inside a longer UTF-8 character.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


#: A key is hot from so many rows on, and from this part of all rows on.
HOT, PARTS = 4096, 1024


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Unset, it is a temporary one for a session of one process and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-gaugeworks-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: this cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/gaugeworks/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_hot(rows: DataFrame, values: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined to values (one row for each key), where one key may hold a large part of the rows. how: inner or left.

    Keys with more rows than HOT and than a 1 / PARTS of all rows are fewer than PARTS: these pass through the driver,
    their values are broadcast and their rows stay where they are. All other rows are joined by a shuffle.
    """
    n = rows.count()
    if n > HOT:
        each = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_hot")).agg(F.count("*").alias("_n"))
        each = each.where(F.col("_n") > max(HOT, n // PARTS)).select("_hot")
        if found := each.collect():
            hot = F.broadcast(rows.sparkSession.createDataFrame(found, each.schema))
            same = F.col(key) == F.col("_hot")
            known = F.broadcast(values.join(hot, same, "left_semi"))
            usual = rows.join(hot, same, "left_anti").join(values, key, how)
            return rows.join(hot, same, "left_semi").join(known, key, how).unionByName(usual)
    return rows.join(values, key, how)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bitmap(keys: DataFrame, column: str, most: int = 1 << 28) -> np.ndarray:
    """A set of 64-bit keys as bits: about 16 for each key, a power of two and at most `most`, which bounds its size.

    A key that was put in is always found; others are found by chance more often as the map fills, so an exact
    join follows wherever it is used.
    """
    bits = min(most, 1 << max(16, (16 * keys.count()).bit_length()))
    at = keys.select(F.col(column).bitwiseAND(F.lit(bits - 1)).alias("at"))
    words = at.groupBy(F.expr("shiftright(at, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 AS int)))").alias("bit"))
    found = words.toArrow()  # at most bits / 64 rows
    out = np.zeros(bits // 64, np.uint64)
    out[found["word"].to_numpy()] = found["bit"].to_numpy().view(np.uint64)
    return out


def in_bitmap(found: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """keys: uint64."""
    at = keys & np.uint64(len(found) * 64 - 1)
    return (found[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch between rows so that the texts of a part have about `limit` bytes; a longer text is a part by itself."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, "right"))
        to = max(to, at + 1)
        yield batch.slice(at, to - at)
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offset of each text (null: empty)."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


_BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    back = np.uint64(pow(_BASE, -1, 1 << 64))
    one = np.ones(1, np.uint64)
    return np.concatenate([one, np.cumprod(np.full(n, _BASE, np.uint64))]), np.concatenate([one, np.cumprod(np.full(n, back, np.uint64))])


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span, from one running polynomial over all bytes."""
    power, back = _powers(1 << max(20, int(len(data)).bit_length()))
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=run[1:])
    return mix((run[end] - run[start]) * back[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the row of its text."""
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before = np.concatenate([[False], word[:-1]]) & ~edge[:-1] if len(data) else word
    after = np.concatenate([word[1:], [False]]) & ~edge[1:] if len(data) else word
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]
