"""The store of token ids: the library's ids, byte layout, perfect hash, keyed access, odd keys and texts."""

import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import id_store
from gaugeworks.llm.queries import END, tokenizer
from gaugeworks.llm.shared import scratch

PATH = tokenizer("word_bpe_49k.json")
ODD = [None, "", " ", "\t\n\x0b\x0c\r", "Hello  World", "a\x0bb\x0cc\x1cd\x1ee!\x1c!\x85x\xa0y z　.", "é ́x ̈", "ΟΔΟΣ Σ ΣΑΣ. İstanbul ǅ", "it's they'll I'D 'S", "<|endoftext|>x<|startoftext|> <|endoftext|", "日本語 ½²Ⅻ٣ 🙂🙂", "x" * 300_000, "word " * 30_000, "ａｂｃ ﬁ Å", "\x00 ​ ﻿", "-- ... !!?? 12345"]


def texts():
    r = random.Random(11)
    words = ["".join(r.choice("abcXYZé'-.1日́Σ") for _ in range(r.randint(1, 9))) for _ in range(200)]
    return ODD + [r.choice([" ", "  ", "\n", "\x0b", " "]).join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(120)]


def library(values):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(PATH)
    return [lib.encode(t or "", add_special_tokens=False).ids + [END] for t in values]


def by_key(df, key="doc_id"):
    out = defaultdict(list)
    for x in df.collect():
        out[x[key]].append(x)
    return out


@pytest.mark.parametrize("shards", [1, 7])
def test_rows_equal_the_library(spark, shards, monkeypatch):
    values = texts()
    r = random.Random(1)
    ids = r.sample(range(-10_000, 10_000), len(values) - 2) + [-(2**63), 2**63 - 1]
    docs = spark.createDataFrame(list(zip(ids, values, strict=True)), "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("key", "row", "tie", "shard", "ids", "start")}).repartition(5)
    monkeypatch.setattr(id_store, "READ", 1000)
    spark.conf.set("spark.sql.shuffle.partitions", shards)
    try:
        store = id_store.write_store(docs, PATH, END)
        got = by_key(id_store.look_up(store, docs))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    start = 0
    for i, want in sorted(zip(ids, library(values), strict=True)):
        raw = struct.pack(f"<{len(want)}I", *want)
        (x,) = got.pop(i)
        assert (x["start"], x["n_tokens"], x["ids_crc32"], bytes(x["ids"])) == (start, len(want), zlib.crc32(raw), raw)
        start += len(want)
    assert not got
    # the files hold the ids of all documents in order, 2 bytes each, from their first byte on
    payload = b""
    for r in store.shards.orderBy("shard").collect():
        with id_store.open_folder(r["file"])[0].open_input_file(id_store.open_folder(r["file"])[1]) as f:
            payload += f.read(2 * r["ids"])
    assert payload == b"".join(np.array(want, "<u2").tobytes() for _, want in sorted(zip(ids, library(values), strict=True)))


def test_repeated_null_and_unknown_keys(spark):
    rows = [(None, "null key"), (None, "another"), (None, "another"), (5, None), (7, "x")] + [(6, f"hot {i % 3}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store = id_store.write_store(docs, PATH, END)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert store.shards.where("first = 6 OR last = 6").count() > 1  # a hot key spans shards
    asked = spark.createDataFrame([(None,), (5,), (6,), (7,), (7,), (8,), (-1,)], "doc_id int")
    got = id_store.look_up(store, asked)
    assert got.schema["doc_id"].dataType.simpleString() == "int"
    found = by_key(got)
    assert {k: len(v) for k, v in found.items()} == {None: 3, 5: 1, 6: 300, 7: 1}
    ordered = sorted((x for v in found.values() for x in v), key=lambda x: x["start"])
    assert [x["doc_id"] for x in ordered] == [None] * 3 + [5] + [6] * 300 + [7]
    at = 0
    for x in ordered:
        assert x["start"] == at
        at += x["n_tokens"]
    want = sorted(struct.pack(f"<{len(w)}I", *w) for w in library([t for _, t in rows]))
    assert sorted(bytes(x["ids"]) for x in ordered) == want
    none = id_store.write_store(docs.limit(0), PATH, END)
    assert id_store.look_up(none, docs).count() == 0 and none.shards.count() == 0


def test_keys_of_strings_and_single_access(spark, tmp_path):
    rows = [(k, f"text of {k}") for k in ("b", "", "é", "日", "a", "🙂", "zz")] + [(None, "none")]
    docs = spark.createDataFrame(rows, "name string, body string")
    store = id_store.write_store(docs, PATH, END, folder=f"file://{tmp_path}/ids", id_col="name", text_col="body")
    got = by_key(id_store.look_up(store, docs, "name"), "name")
    want = dict(zip([k for k, _ in rows], library([t for _, t in rows]), strict=True))
    assert {k: np.frombuffer(v[0]["ids"], "<u4").tolist() for k, v in got.items()} == want
    for _, path, _, _, _ in store.rows():
        shard = id_store.Shard(path)
        for k, ids in want.items():
            found = shard.get(k)
            assert [x.tolist() for x in found] in ([ids], [])
        assert shard.get("unknown") == []
        shard.close()
    assert id_store.look_up(id_store.Store(store.shards, "string"), docs, "name", with_ids=False).columns == ["name", "start", "n_tokens", "ids_crc32"]
    store.shards.write.parquet(f"{tmp_path}/shards")
    assert id_store.look_up(id_store.open_store(spark, f"{tmp_path}/shards", "string"), docs, "name").count() == len(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 1000, 200_000])
def test_the_hash_is_minimal_and_perfect(n):
    keys = np.random.default_rng(n).choice(1 << 40, n, replace=False).tolist()
    low, high = id_store.key_hashes(keys)
    found = id_store.PerfectHash.build(low, high)
    assert sorted(found.slots(low, high).tolist()) == list(range(n))
    assert n < 1000 or 64 * (len(found.words) + len(found.ranks)) < 9 * n
    if n == 200_000:
        other = (np.arange(100_000) + (1 << 41)).tolist()  # none of them is in
        a, b = id_store.key_hashes(other)
        slot = found.slots(a, b)
        prints = np.zeros(n, np.uint32)
        prints[found.slots(low, high)] = id_store.fingerprints(low, high)
        assert ((slot >= 0) & (prints[slot] == id_store.fingerprints(a, b))).sum() <= 1
    with pytest.raises(ValueError, match="same hashes"):
        id_store.PerfectHash.build(np.zeros(2, np.uint64), np.zeros(2, np.uint64))


def test_damage_is_told(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    store = id_store.write_store(docs, PATH, END, folder=f"file://{tmp_path}")
    path = store.rows()[0][1].removeprefix("file://")
    raw = open(path, "rb").read()
    for bad in (raw[2:], raw[:-1], raw[:-64] + b"x" * 64):
        with open(f"{tmp_path}/bad", "wb") as f:
            f.write(bad)
        with pytest.raises((ValueError, struct.error)):
            id_store.Shard(f"{tmp_path}/bad")
    assert isinstance(id_store.open_folder(f"{scratch(spark)}/x")[0], pyarrow.fs.LocalFileSystem)


def test_words_apart_equal_the_library_for_all_characters(monkeypatch):
    """Every character beside letters, marks and digits of either kind, and words made of the ends that are split off."""
    monkeypatch.setattr(id_store, "REMEMBERED", 100_000)
    chars = [chr(c) for c in [*range(0x600), *range(0x1E00, 0x2100), *range(0x3000, 0x3100), 0x212B, 0xFB01, 0x1F642, 0xFF21, 0xFEFF, 0x0E01, 0x0905, 0x093F]]
    values = [f"a{c}b {c} {c}1 É{c}! x{c}{c} '{c}s" for c in chars]
    r = random.Random(4)
    parts = ["'s", "'S", "'re", "'", "l", "ll", "'ll", "D", "9", "42", "!", "--", "é", "ß", "İ", "ſ", "Ǆ", "ª", "×", "÷", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "k", "µ", "\x7f", "\x1c"]
    values += ["".join(r.choice(parts) for _ in range(r.randint(1, 12))) for _ in range(3000)]
    coder = id_store.Encoder(PATH, END)
    for at in range(0, len(values), 500):
        got = coder.encode([t.encode() for t in values[at : at + 500]])
        assert [np.frombuffer(x, "<u2").tolist() for x in got] == library(values[at : at + 500])


def test_a_vocabulary_whose_tokens_hold_spaces_is_encoded_whole(spark):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    assert id_store.Encoder(PATH, END).by_word and not id_store.Encoder(path, None).by_word
    lib = Tokenizer.from_file(path)
    values = [t or "" for t in ODD if len(t or "") < 1000]
    got = id_store.Encoder(path, None).encode([t.encode() for t in values])
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [lib.encode(t, add_special_tokens=False).ids for t in values]
