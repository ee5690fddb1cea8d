"""Operator 12: fill-in-middle transformation.

A text's UTF-8 bytes are cut into blocks of fixed length. A Fenwick tree over the blocks stores how many units (code
points, words or lines) begin and how many code points begin in each. A binary-lifting descent through the tree finds
the block in which a unit begins and what lies before that block; the boundary itself is then looked for within this
one block. Two boundaries part a text into prefix, middle and suffix, which are put in another order behind marks.

The cuts and the form are drawn from the sha256 of the seed and the document's id: reruns agree, whatever the
partitions. Texts that are empty or hold a mark stay plain, so every output can be turned back.

Null texts are empty. A null id is hashed as an empty string. Repeated rows give repeated rows, an empty table an
empty result; other columns are not looked at. A text is one value of one row, so a task holds whole texts, in parts
of about 4 MB (a longer text is a part by itself).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.shared import SPACES, slices

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
BLOCK = 1024
#: Of 100 draws, those from PLAIN on leave a text plain; of 100 further draws, those below SPM put the suffix first.
PLAIN, SPM = 90, 20
UNITS = ("char", "word", "line")

_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True


def unit_starts(raw: np.ndarray, unit: str) -> np.ndarray:
    """Which bytes begin a unit. White space before the first word belongs to the first unit, all other to the word before it."""
    if unit == "char":
        return (raw & 0xC0) != 0x80
    if unit == "line":
        return np.concatenate([[True], raw[:-1] == 0x0A])[: len(raw)]
    space = _SPACE[raw]
    return ~space & np.concatenate([[True], space[:-1]])[: len(raw)]


class BlockTree:
    """Counts of unit starts and code points by block, as a Fenwick tree. Row p of the tree holds the sums of the blocks
    that node p answers for; node 0 is empty."""

    def __init__(self, raw: bytes, unit: str = "char", block: int = BLOCK) -> None:
        data = np.frombuffer(raw, np.uint8)
        self.block, self.length = block, len(data)
        self.starts, self.chars = unit_starts(data, unit), unit_starts(data, "char")
        cuts = np.arange(0, len(data), block)
        self.n = len(cuts)
        self.tree = np.zeros((self.n + 1, 2), np.int64)
        if self.n:
            self.tree[1:, 0] = np.add.reduceat(self.starts, cuts, dtype=np.int64)
            self.tree[1:, 1] = np.add.reduceat(self.chars, cuts, dtype=np.int64)
        step = 1
        while 2 * step <= self.n:  # nodes whose lowest bit is step are whole: each goes to its parent
            parents = self.tree[2 * step :: 2 * step]
            parents += self.tree[step :: 2 * step][: len(parents)]
            step *= 2

    def before(self, p: int) -> tuple[int, int]:
        """Units and code points of the first p blocks."""
        units = chars = 0
        while p:
            units, chars = units + int(self.tree[p, 0]), chars + int(self.tree[p, 1])
            p &= p - 1
        return units, chars

    def boundary(self, k: int) -> tuple[int, int]:
        """Bytes and code points before unit k (from 0); all of them from the number of units on."""
        if k <= 0:
            return 0, 0
        at, units, chars = 0, 0, 0
        step = 1 << self.n.bit_length()
        while step := step >> 1:
            if at + step <= self.n and units + self.tree[at + step, 0] <= k:
                at += step
                units, chars = units + int(self.tree[at, 0]), chars + int(self.tree[at, 1])
        if at == self.n:
            return self.length, chars
        low = at * self.block
        here = int(np.flatnonzero(self.starts[low : low + self.block])[k - units])
        return low + here, chars + int(np.count_nonzero(self.chars[low : low + here]))


def transform(raw: bytes, h: tuple[int, int, int, int], unit: str = "char", plain: int = PLAIN, spm: int = SPM, block: int = BLOCK) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of the prefix, code points of the middle, output) of one text."""
    tree = BlockTree(raw, unit, block)
    n, _ = tree.before(tree.n)
    if not raw or h[2] % 100 >= plain or any(m.encode() in raw for m in MARKS):
        return n, "plain", None, None, raw
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    (a, before_a), (b, before_b) = tree.boundary(low), tree.boundary(high)
    p, s, m = (x.encode() for x in MARKS)
    if h[3] % 100 < spm:
        return n, "spm", before_a, before_b - before_a, b"".join((s, raw[b:], p, raw[:a], m, raw[a:b]))
    return n, "psm", before_a, before_b - before_a, b"".join((p, raw[:a], s, raw[b:], m, raw[a:b]))


def _draws(key: Column, seed: str) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, unit: str = "char", seed: str = "1", plain: int = PLAIN, spm: int = SPM, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n, form, prefix_chars, middle_chars, output), one for each row of docs."""
    if unit not in UNITS:
        raise ValueError(f"unit is one of {UNITS}")
    id_type = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *[h.alias(f"h{i}") for i, h in enumerate(_draws(F.col(id_col), seed))])
    kinds = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                texts = part.column(1).cast(pa.large_binary()).to_pylist()
                draws = zip(*(part.column(2 + i).to_pylist() for i in range(4)), strict=True)
                rows = [transform(t or b"", h, unit, plain, spm, block) for t, h in zip(texts, draws, strict=True)]
                columns = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)]
                columns[-1] = columns[-1].cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["id", *[k for k, _ in kinds]])

    out = docs.mapInArrow(run, f"id {id_type}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", id_col)


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made of. No part holds a mark, and no end of a part makes one with a mark beside it,
    so each mark stands once."""

    def around(second: str) -> tuple[Column, Column]:
        head = F.substring(F.substring_index(output, second, 1), F.lit(len(PREFIX) + 1), F.length(output))
        return head, F.substring_index(F.substring_index(output, second, -1), MIDDLE, 1)

    middle, (p, s), (s2, p2) = F.substring_index(output, MIDDLE, -1), around(SUFFIX), around(PREFIX)
    return F.when(form == "psm", F.concat(p, middle, s)).when(form == "spm", F.concat(p2, middle, s2)).otherwise(output)


def restore(made: DataFrame) -> DataFrame:
    """Adds the text, `restored`, from form and output alone."""
    return made.withColumn("restored", restored(F.col("form"), F.col("output")))


def summary(made: DataFrame, id_col: str = "doc_id") -> DataFrame:
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return restore(made).select(id_col, "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


def sql() -> str:
    return r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
e AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS y,
         ('0x' || substr(h, 17, 8))::BIGINT % 100 AS keep, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS turn FROM d),
f AS (
  SELECT *, least(x, y) AS a, greatest(x, y) AS b,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR keep >= 90 THEN 'plain' WHEN turn < 20 THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (SELECT *, substring(text, 1, a) AS p, substring(text, a + 1, b - a) AS m, substring(text, b + 1, n) AS s FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM g"""
