"""Operator 11: token ids as binary shards with keyed access.

Documents are put in ascending order of their key, dealt into ranges, and encoded. Each range becomes one file:

    ids        unsigned little-endian integers of 2 bytes (vocabularies of at most 65,536 ids) or 4 bytes, nothing else
    index      offsets of the documents, bits and ranks of the hash function, then fingerprint, first document and
               number of documents of each slot
    trailer    64 bytes: mark, version, width and the counts that give each section's place

The index is a minimal perfect hash function over the shard's distinct keys, built by levels of bit maps: a key whose
bit no other key of its level shares is placed there, all others go to the next level; its slot is the number of bits
set before its own. A look-up computes a few positions, compares the stored fingerprint, which an unknown key passes by
chance once in 2^32 times, and reads the ids at the stored offset: its time does not depend on the number of documents.

A small table (one row for each shard: file, counts, first and last key) is written last, and names the files that
belong together; a task that runs twice leaves a file that nobody refers to. Files are written and read by the paths
of spark.checkpoint.dir, or another shared folder, through pyarrow's file systems. The number of shards is that of the
shuffle's partitions, so the driver and the executors hold that table whole.

The encoding is the library's: text is cut at ASCII white space, which no token of the vocabulary spans and which
keeps the normalisation of what stands beside it, and a worker gets the ids of a word from the library once. Words of
plain letters are first split into pieces as the vocabulary's pattern does, all others are encoded by the library whole.

Null texts are empty and have the end id alone. Null keys come first and are one key. A key may have several
documents; their order is that of the hash of their texts, and a key with a large part of all rows spans several
shards, each with its own part of it. Repeated rows give repeated rows. An empty table gives a store without
documents. Other columns are not looked at. Keys that are not integers are kept as strings.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import sys
import uuid
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.shared import mix, saved, scratch, slices

MARK, VERSION = b"IDSHARD\0", 1
#: mark, version, bytes of an id, documents, ids, keys, levels, bits, (unused)
TRAILER = struct.Struct("<8sHHIQQQQ16x")
INTEGERS = ("tinyint", "smallint", "int", "bigint")
#: Bits of a level for each key that is still without a slot; levels at most, far beyond what distinct keys need.
GAMMA, LEVELS = 2.0, 64
#: A worker remembers so many bytes of words and their ids, and as many of pieces.
REMEMBERED = 96 << 20
#: Bytes of ids that are read at once.
READ = 8 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)


def open_folder(path: str):
    """The file system of a path and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


# ---- encoding ----

#: Words of ASCII and Latin letters, which the vocabulary's normalisation changes to lower case and nothing else, and
#: how its pattern splits them: ends of English words, letters, digits one by one, runs of other characters.
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+").fullmatch
SPLIT = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-z\u00c0-\u017f]+|[0-9]|[^a-z0-9\u00c0-\u017f]+").findall


def _byte_characters() -> dict[int, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, all others from 256 on in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in plain)
    return {b: 256 + i for i, b in enumerate(rest)}


_BYTES = _byte_characters()


class Remembered(dict):
    """Raw ids by word or piece; what is missing is computed, and all is forgotten beyond a bound."""

    def __init__(self, compute) -> None:
        super().__init__()
        self.compute, self.held = compute, 0

    def __missing__(self, key):
        if self.held > REMEMBERED:
            self.clear()
            self.held = 0
        ids = self[key] = self.compute(key)
        self.held += len(key) + len(ids) + 200
        return ids


class Encoder:
    """The library's ids of whole texts, from its ids of each distinct word, and those from its ids of the word's pieces."""

    def __init__(self, path: str, end: int | None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.end = b"" if end is None else self._raw([end])
        self.by_word = drops_space(model)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in model["added_tokens"]) or "(?!)").search
        self.tokenize = self.library.model.tokenize
        self.words, self.pieces = Remembered(self._word), Remembered(self._piece)

    def _raw(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if PLAIN(text) and not self.special(text):
            return b"".join([self.pieces[p] for p in SPLIT(text.lower())])
        return self._raw(self.library.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        return self._raw([t.id for t in self.tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTES))])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Raw ids of each text with the end id."""
        if not self.by_word:
            return [self._raw(e.ids) + self.end for e in self.library.encode_batch([t.decode() for t in texts], add_special_tokens=False)]
        return [b"".join(map(self.words.__getitem__, t.split())) + self.end for t in texts]


@functools.lru_cache(maxsize=1)
def encoder_of(path: str, end: int | None) -> Encoder:
    """A worker's tasks share what it remembers."""
    return Encoder(path, end)


def drops_space(model: dict) -> bool:
    """Whether a vocabulary file's tokens never hold white space, so that words can be encoded apart: its split keeps only
    runs without white space, and no special token holds any or takes in what is beside it."""
    pre = model.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    own = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    plain = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not any(c.isspace() for c in t["content"]) for t in model["added_tokens"])
    return first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and pattern == own and plain and not model.get("post_processor")


# ---- minimal perfect hash ----


def key_hashes(keys: list) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each key (None, int or str), which together tell keys apart."""
    import xxhash

    null = np.array([k is None for k in keys], bool)
    if any(isinstance(k, str) for k in keys):
        raw = [b"" if k is None else k.encode() for k in keys]
        low, high = (np.array([xxhash.xxh3_64_intdigest(k, seed) for k in raw], np.uint64) for seed in (1, 2))
    else:
        whole = np.array([0 if k is None else k for k in keys], np.int64).view(np.uint64)
        low, high = mix(whole + _ODD), mix(whole ^ np.uint64(0x5851F42D4C957F2D))
    return np.where(null, np.uint64(11), low), np.where(null, np.uint64(13), high)


def _place(low: np.ndarray, high: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (mix(low + (high | np.uint64(1)) * np.uint64(level + 1)) % np.uint64(bits)).astype(np.int64)


def fingerprints(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return (mix(high ^ (low >> np.uint64(7))) >> np.uint64(32)).astype(np.uint32)


@dataclass
class PerfectHash:
    sizes: np.ndarray  # bits of each level, multiples of 64
    words: np.ndarray  # all levels' bits
    ranks: np.ndarray  # bits set before each word

    @classmethod
    def build(cls, low: np.ndarray, high: np.ndarray) -> PerfectHash:
        left = np.arange(len(low))
        sizes, maps = [], []
        while len(left):
            if len(sizes) == LEVELS:
                raise ValueError("two keys have the same hashes")
            bits = 64 * max(1, -(-int(GAMMA * len(left)) // 64))
            at = _place(low[left], high[left], len(sizes), bits)
            alone = np.bincount(at, minlength=bits) == 1
            sizes.append(bits)
            maps.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        words = np.concatenate(maps) if maps else np.zeros(0, "<u8")
        return cls(np.array(sizes, "<u8"), words, cls._ranks(words))

    @staticmethod
    def _ranks(words: np.ndarray) -> np.ndarray:
        ones = np.bitwise_count(words).astype(np.uint64)
        return np.cumsum(ones) - ones

    def slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where no level has its bit. Keys that were not put in get some slot or -1."""
        out = np.full(len(low), -1, np.int64)
        left, base = np.arange(len(low)), 0
        for level, bits in enumerate(self.sizes.tolist()):
            at = _place(low[left], high[left], level, bits) + base
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (self.ranks[at >> 6] + below)[hit].astype(np.int64)
            left, base = left[~hit], base + bits
        return out


# ---- shards ----


def write_index(out, width: int, offsets: np.ndarray, keys: list, first: np.ndarray, count: np.ndarray) -> None:
    """keys: the distinct keys in order, with their first document and number of documents."""
    low, high = key_hashes(keys)
    found = PerfectHash.build(low, high)
    by_slot = np.argsort(found.slots(low, high))  # slots are 0 .. keys - 1
    firsts, counts, prints = first[by_slot].astype("<u8"), count[by_slot].astype("<u8"), fingerprints(low, high)[by_slot].astype("<u4")
    for part in (offsets.astype("<u8"), found.sizes, found.words, found.ranks.astype("<u8"), firsts, counts, prints):
        out.write(np.ascontiguousarray(part).tobytes())
    out.write(TRAILER.pack(MARK, VERSION, width, len(found.sizes), len(offsets) - 1, int(offsets[-1]), len(keys), 64 * len(found.words)))


class Shard:
    """An open file; its index is in memory, its ids are read where they are asked for."""

    def __init__(self, path: str) -> None:
        files, at = open_folder(path)
        self.file = files.open_input_file(at)
        size = self.file.size()
        mark, version, self.width, levels, self.docs, self.ids, n, bits = TRAILER.unpack(self.file.read_at(TRAILER.size, size - TRAILER.size))
        if (mark, version) != (MARK, VERSION):
            raise ValueError(f"not a shard of ids: {path}")
        parts = [(self.docs + 1, "<u8"), (levels, "<u8"), (bits // 64, "<u8"), (bits // 64, "<u8"), (n, "<u8"), (n, "<u8"), (n, "<u4")]
        start = self.ids * self.width
        total = sum(k * int(kind[-1]) for k, kind in parts)
        if start + total + TRAILER.size != size:
            raise ValueError(f"a shard of ids is damaged: {path}")
        raw, at, read = self.file.read_at(total, start), 0, []
        for k, kind in parts:
            read.append(np.frombuffer(raw, kind, k, at))
            at += k * int(kind[-1])
        self.offsets, sizes, words, ranks, self.first, self.count, self.prints = read
        self.hash = PerfectHash(sizes, words, ranks)

    def find(self, keys: list) -> tuple[np.ndarray, np.ndarray]:
        """First document and number of documents (0: not here) of each key."""
        low, high = key_hashes(keys)
        slot = self.hash.slots(low, high)
        if not len(self.prints):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        here = (slot >= 0) & (self.prints[slot] == fingerprints(low, high))
        return np.where(here, self.first[slot], 0).astype(np.int64), np.where(here, self.count[slot], 0).astype(np.int64)

    def read(self, doc: int, n: int = 1) -> np.ndarray:
        """Ids of n documents that follow each other."""
        a, b = int(self.offsets[doc]), int(self.offsets[doc + n])
        return np.frombuffer(self.file.read_at((b - a) * self.width, a * self.width), f"<u{self.width}")

    def get(self, key) -> list[np.ndarray]:
        """The ids of each document of one key."""
        first, count = (int(x[0]) for x in self.find([key]))
        return [self.read(first + i) for i in range(count)]

    def close(self) -> None:
        self.file.close()


class _Writer:
    """Puts documents into one file, in the order in which they come."""

    def __init__(self, folder: str, shard: int, width: int) -> None:
        self.path = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.ids"
        files, at = open_folder(self.path)
        files.create_dir(at.rsplit("/", 1)[0], recursive=True)
        self.out, self.width = files.open_output_stream(at), width
        self.offsets, self.first, self.keys, self.ids = array("Q", [0]), array("Q"), [], 0

    def add(self, key, ids: bytes) -> None:
        if not self.keys or key != self.keys[-1]:
            self.keys.append(key)
            self.first.append(len(self.offsets) - 1)
        self.out.write(ids)
        self.ids += len(ids) // self.width
        self.offsets.append(self.ids)

    def close(self) -> None:
        first = np.frombuffer(self.first, np.uint64)
        count = np.diff(np.append(first, np.uint64(len(self.offsets) - 1)))
        write_index(self.out, self.width, np.frombuffer(self.offsets, np.uint64), self.keys, first, count)
        self.out.close()


@dataclass
class Store:
    shards: DataFrame  # shard, file, docs, ids, keys, first, last; one row for each file
    key_type: str

    def rows(self) -> list[tuple]:
        """(shard, file, ids before it, first key, last key) in order: a row for each partition of the shuffle."""
        out, before = [], 0
        for r in sorted(self.shards.collect(), key=lambda r: r["shard"]):
            out.append((r["shard"], r["file"], before, r["first"], r["last"]))
            before += r["ids"]
        return out


def write_store(docs: DataFrame, path: str, end: int | None = None, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> Store:
    """Encodes docs with the vocabulary at `path` and writes them, in ascending order of their keys, to files in a shared folder."""
    spark = docs.sparkSession
    folder = folder or f"{scratch(spark)}/gaugeworks/ids-{uuid.uuid4().hex}"
    key_type = docs.schema[id_col].dataType.simpleString()
    kind = "bigint" if key_type in INTEGERS else "string"
    # Rows that are equal in key and text are told apart by where they stand, so that even they can be dealt out.
    order = [F.asc_nulls_first("key"), F.asc("tie"), F.asc("row")]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.select(F.col(id_col).cast(kind).alias("key"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("row"), text.alias("text"))
    docs = docs.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, out = encoder_of(path, end), TaskContext.get().partitionId(), None
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                out = out or _Writer(folder, shard, encoder.width)
                for key, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).cast(pa.large_binary()).to_pylist()), strict=True):
                    out.add(key, ids)
        if out:
            out.close()
            row = {"shard": shard, "file": out.path, "docs": len(out.offsets) - 1, "ids": out.ids, "keys": len(out.keys), "first": out.keys[0], "last": out.keys[-1]}
            of = pa.int64() if kind == "bigint" else pa.string()
            schema = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("keys", pa.int64()), ("first", of), ("last", of)])
            yield pa.RecordBatch.from_pylist([row], schema)

    shards = docs.mapInArrow(run, f"shard int, file string, docs long, ids long, keys long, first {kind}, last {kind}")
    return Store(saved(shards, "shards"), key_type)


def open_store(spark: SparkSession, shards: str, key_type: str = "bigint") -> Store:
    """A store whose table of shards was written to a folder by the caller."""
    return Store(spark.read.parquet(shards), key_type)


def look_up(store: Store, keys: DataFrame, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Rows (id, start, n_tokens, ids_crc32 and, if asked for, ids binary), one for each document of each distinct key;
    unknown keys have none. start: ids of all documents before it. ids: unsigned little-endian integers of 4 bytes."""
    table = store.rows()
    placed = lambda k: (0, 0) if k is None else (1, k)  # noqa: E731  null keys come first
    firsts, lasts = [placed(r[3]) for r in table], [placed(r[4]) for r in table]
    kind = "bigint" if store.key_type in INTEGERS else "string"
    names = ["key", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            found = [(i, k) for i, key in enumerate(map(placed, keys)) for k in range(bisect_left(lasts, key), bisect_right(firsts, key))]
            yield pa.RecordBatch.from_arrays([pa.array([k for _, k in found], pa.int32()), batch.column(0).take(pa.array([i for i, _ in found], pa.int64()))], names=["at", "key"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard = -1, None
        for batch in batches:
            ats = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(ats)) + 1).tolist(), len(ats)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if ats[a] != now:
                    if shard:
                        shard.close()
                    now = int(ats[a])
                    shard = Shard(table[now][1])
                for part in _documents(shard, table[now][2], batch.column(1).slice(a, b - a)):
                    yield part.select(names)
        if shard:
            shard.close()

    found = keys.select(F.col(id_col).cast(kind).alias("key")).distinct().mapInArrow(locate, f"at int, key {kind}")
    found = found.repartition("at").sortWithinPartitions("at", "key").mapInArrow(read, f"key {kind}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    return found.select(F.col("key").cast(store.key_type).alias(id_col), *names[1:])


def _documents(shard: Shard, before: int, keys: pa.Array) -> Iterator[pa.RecordBatch]:
    """All documents of the keys, read in runs that follow each other and have about READ bytes."""
    first, count = shard.find(keys.to_pylist())
    at = np.repeat(np.arange(len(keys)), count)
    docs = first[at] + np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    order = np.argsort(docs, kind="stable")
    at, docs = at[order], docs[order]
    size = (shard.offsets[docs + 1] - shard.offsets[docs]).astype(np.int64)
    i = 0
    while i < len(docs):
        j, held = i + 1, int(size[i])
        while j < len(docs) and docs[j] == docs[j - 1] + 1 and (held := held + int(size[j])) * shard.width <= READ:
            j += 1
        ids = shard.read(int(docs[i]), j - i).astype("<u4")
        low = shard.offsets[docs[i:j]].astype(np.int64)
        raw = [ids[a : a + n].tobytes() for a, n in zip((low - low[0]).tolist(), size[i:j].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [keys.take(pa.array(at[i:j])), pa.array(low + before), pa.array(size[i:j]), pa.array([zlib.crc32(r) for r in raw], pa.int64()), pa.array(raw, pa.binary())],
            names=["key", "start", "n_tokens", "ids_crc32", "ids"],
        )
        i = j
