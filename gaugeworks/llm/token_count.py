"""Operator 3: token counts of a byte-level BPE vocabulary without materialising ids.

The pieces of a distinct pre-token are counted once, by the library. The most frequent pre-tokens (a fixed number,
so the table that is sent to the executors has a bound) are joined to a text's pre-token frequencies where the text
is split; all others are joined by a shuffle on the pre-token. The products are summed per text.

Nulls and empty texts have 0 tokens and 0 bytes. Repeated rows give repeated rows, an empty table an empty result;
other columns are not looked at. The string of a special token inside a text is one token, the library's default.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.shared import saved, slices

#: The split of byte-level BPE, once in general and once for texts whose characters all are below
#: U+0250, with the same classes spelled out (letters, numbers, white space).
GENERAL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\\t-\\r \u0085 "
LATIN = f"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: How many of the most frequent pre-tokens are sent to every executor.
HEAD = 1 << 17


class Splitter:
    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        pre = model["pre_tokenizer"]
        if model["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("not a plain byte-level vocabulary")
        special = sorted((t["content"] for t in model["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.latin, self.general, self.beyond = re.compile(LATIN).findall, regex.compile(GENERAL).findall, re.compile("[^\\x00-ɏ]").search

    def split(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and the number of special tokens."""
        n, parts = 0, [text]
        if self.special and self.special.search(text):
            n, parts = len(self.special.findall(text)), self.special.split(text)
        find = self.latin if text.isascii() or not self.beyond(text) else self.general
        return [x for p in parts for x in find(p)] if n else find(text), n


def distinct_pretokens(docs: DataFrame, path: str) -> DataFrame:
    """Rows (pretoken, freq) over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Splitter(path)
        seen: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pretoken", "freq"])

        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                for text in part.column(1).to_pylist():
                    if text:
                        seen.update(s.split(text)[0])
                if len(seen) > 400_000:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return docs.mapInArrow(run, "pretoken string, freq long").groupBy("pretoken").agg(F.sum("freq").alias("freq"))


def count_pieces(distinct: DataFrame, path: str) -> DataFrame:
    """Adds the number of pieces, n, to each distinct pre-token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        for batch in batches:
            for part in slices(batch, "pretoken", 1 << 16):
                n = [len(e.ids) for e in t.encode_batch(part.column(0).to_pylist(), add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64())], names=["pretoken", "freq", "n"])

    return distinct.mapInArrow(run, "pretoken string, freq long, n long")


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """Rows (id, n_bytes, n_tokens, over_limit), one for each row of docs."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = docs.schema["id"].dataType.simpleString()
    pieces = saved(count_pieces(distinct_pretokens(docs, path), path), "pretokens")
    top = pieces.orderBy(F.desc("freq"), "pretoken").limit(head).select("pretoken", "n").toArrow()  # head rows at most
    shared = spark.sparkContext.broadcast(dict(zip(top["pretoken"].to_pylist(), top["n"].to_pylist(), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, known = Splitter(path), shared.value
        get = known.get
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                ids, rows, keys, freq, size, direct = [], [], [], [], [], []
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    row += 1
                    split, n = s.split(text or "")
                    counts = Counter(split)
                    rest = []
                    for p, k in counts.items():
                        if (c := get(p)) is not None:
                            n += c * k
                        else:
                            rest.append((p, k))
                    # The text's own row has a key that no pre-token equals: it holds a digit after a control character.
                    ids += [i, *[None] * len(rest)]
                    rows += [row] * (len(rest) + 1)
                    keys += [f"\x01{row}", *[p for p, _ in rest]]
                    freq += [None, *[k for _, k in rest]]
                    size += [len((text or "").encode()), *[None] * len(rest)]
                    direct += [n, *[None] * len(rest)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, part.column(0).type), pa.array(rows, pa.int64()), pa.array(keys, pa.string()), pa.array(freq, pa.int64()), pa.array(size, pa.int64()), pa.array(direct, pa.int64())],
                    names=["id", "row", "pretoken", "k", "size", "direct"],
                )

    freqs = docs.mapInArrow(run, f"id {id_type}, row long, pretoken string, k long, size long, direct long")
    return (
        freqs.join(pieces.select("pretoken", "n"), "pretoken", "left")
        .groupBy("row")
        .agg(F.max("id").alias(id_col), F.max("size").alias("n_bytes"), (F.sum(F.coalesce("direct", F.lit(0))) + F.sum(F.coalesce(F.col("k") * F.col("n"), F.lit(0)))).alias("n_tokens"))
        .select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
