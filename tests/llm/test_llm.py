"""Each operator against brute force, with nulls, empty texts, repeated rows, clashing columns and empty tables."""

import hashlib
import random
import re
import string
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gaugeworks.llm import jaccard_join, license_scan, mixing, nearest, quality, secret_scan, sentencepiece_codec, token_count, toxicity, transport_stream
from gaugeworks.llm.queries import tokenizer

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts():
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgé") for _ in range(r.randint(1, 7))) for _ in range(400)]
    base = [" ".join(r.choice(words) for _ in range(r.randint(1, 120))) for _ in range(40)]
    near = [b.replace(" ", "  ", 1) + " end" for b in base[:10]] + [" ".join(base[11].split()[:-1] + [w]) for w in words[:12]]
    odd = [None, "", " ", "\n\t ", "x", "a b c d", "Hello  World's 123 <|endoftext|> 日本語 🙂 ▁x", 'token = "a9ce335683f9772ddc0011223344556677889900"', "AKIA" + "A1" * 8, "word " * 3000]
    return base + base[:5] + near + odd


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", [None, "a", "b", "c"][i % 4], len(t or "")) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).withColumn("ids", F.lit("clash")).withColumn("score", F.lit("clash")).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_sentencepiece_equals_the_library(docs, empty):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in sentencepiece_codec.encode_texts(docs, tokenizer("piece_bpe_32k.model")).collect()}
    for i, t in enumerate(texts()):
        ids = lib.encode(t or "")
        assert got[i]["ids"] == ids and got[i]["decoded"] == lib.decode(ids)
    assert sentencepiece_codec.encode_texts(empty, tokenizer("piece_bpe_32k.model")).count() == 0


def test_token_counts_equal_the_library(docs, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in token_count.token_counts(docs, tokenizer("byte_bpe_50k.json"), head=50).collect()}
    for i, t in enumerate(texts()):
        assert (got[i]["n_bytes"], got[i]["n_tokens"]) == (len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids))
    assert token_count.token_counts(empty, tokenizer("byte_bpe_50k.json")).count() == 0


def test_license_scan(spark):
    mit = license_scan.KNOWN["MIT"].upper().replace("COPYRIGHT (C)", "Copyright 2020 Somebody").replace("LICENSE", "LICENCE")
    df = spark.createDataFrame([(1, mit), (2, "x\nReleased under the MIT license\ny"), (3, None), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.license_scan(df, license_scan.known_licenses(spark)).collect()}
    assert got[1]["license_id"] == "MIT" and got[2]["notice_ids"] == "MIT-notice" and got[3]["license_id"] is None and len(got) == 4


def test_license_scan_knows_whole_texts_and_all_lines(spark):
    names = {k for k, _ in license_scan.listed()}
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "CC-BY-SA-4.0", "Unlicense"} <= names
    rows = [(k, t.replace("licence", "license")) for k, t in license_scan.LISTED["texts"]]
    lines = ["x\nLicensed under CC BY-NC 4.0.\ny", "// SPDX-License-Identifier: Apache-2.0\nx", "x\nThis work is in the public domain.", "x\nDistributed under CC0\nReleased under the MIT License.", "the licence of Apache"]
    df = spark.createDataFrame([*rows, *((str(i), x) for i, x in enumerate(lines)), ("0", lines[0]), ("0", "x"), (None, lines[0])], "doc_id string, text string")
    got = license_scan.license_scan(df, license_scan.known_licenses(spark)).collect()
    found = sorted((r["doc_id"] or "", r["notice_ids"]) for r in got if r["license_id"] is None)
    assert len(got) == df.count() and sorted(r["doc_id"] for r in got if r["license_id"]) == sorted(k for k, _ in rows) and all(r["license_id"] in (None, r["doc_id"]) for r in got)
    nc = "CC-BY-NC-4.0-notice"
    assert found == [("", nc), ("0", ""), ("0", nc), ("0", nc), ("1", "Apache-2.0-notice"), ("2", "public-domain-notice"), ("3", "CC0-1.0-notice,MIT-notice"), ("4", "")]
    many = license_scan.known_licenses(spark, {f"n{i}": f"licence number {i}" for i in range(10_050)})
    assert license_scan.license_scan(spark.createDataFrame([(1, "a\nLicence number 10049")], "doc_id long, text string"), many).first()["notice_ids"] == "n10049"


def test_license_digests_do_not_depend_on_wrapping(spark):
    rows = []
    for name in ("MIT", "ISC"):
        title, _, *body = license_scan.KNOWN[name].split("\n")
        for width in range(30, 100):
            rows.append((name, "\n\n".join([title, "Copyright (c) 2020 Some Body <a@b.c>", *("\n".join(textwrap.wrap(x, width)) for x in body)])))
    assert sum(bool(re.search("(?im)^copyright (notice|holders)", t)) for _, t in rows) > 5
    got = license_scan.license_scan(spark.createDataFrame(rows, "doc_id string, text string"), license_scan.known_licenses(spark)).collect()
    assert len(got) == len(rows) and all(r["license_id"] == r["doc_id"] for r in got)
    statements = ["Copyright 2020 A", "copyright (c) 2020", "// Copyright: Jane Doe", "© Jane", "(C) 2019-2020 Jane", "Copyright [yyyy] [name]", "Copyright The Authors", "COPYRIGHT 2001", " * Copyright (c) <year> <owner>"]
    others = ["copyright notice and this", "COPYRIGHT HOLDERS BE LIABLE", "Copyright License. Subject to", "(c) You must retain", "copyright law", "COPYRIGHT OWNER OR CONTRIBUTORS"]
    df = spark.createDataFrame([(x,) for x in statements + others], "x string").select("x", (license_scan.canonical(F.col("x")) == "").alias("gone"))
    assert {r["x"] for r in df.collect() if r["gone"]} == set(statements)


def test_mixing(docs, empty):
    rows = mixing.taken(mixing.mix(docs)).join(docs.select("doc_id", "source"), "doc_id").collect()
    size, target, got = {}, {}, {}
    for r in rows:
        assert r["taken"] <= 3 * r["size"]
        size[r["source"]] = size.get(r["source"], 0) + r["size"]
        got[r["source"]] = got.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    assert len(rows) == docs.count() and all(abs(got[s] - target[s]) <= 1 for s in got)
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6
    count = F.size(F.regexp_extract_all("text", F.lit(mixing.WORD), F.lit(0)))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert {r[0]: r[1] for r in mixed.groupBy("source").agg(F.sum(count)).collect()} == {s: n for s, n in got.items() if n}
    assert mixing.taken(mixing.mix(empty)).count() == 0 and mixing.mixed_documents(empty).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_permutations(spark, n):
    df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), [F.lit(1)]).alias("p"), "id")
    rows = df.select("p", "id", mixing.unpermuted(F.col("p"), F.lit(n), [F.lit(1)]).alias("back")).collect()
    assert sorted(r["p"] for r in rows) == list(range(n)) and all(r["back"] == r["id"] for r in rows)


def test_quality_and_toxicity(spark, empty):
    r = random.Random(1)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows = []
    for i in range(600):
        ws = [r.choice(words) for _ in range(40)]
        junk, toxic = i % 5 == 1, i % 7 == 2
        ws = [w + "###" for w in ws] if junk else ws
        rows.append((i, " ".join(ws + ["idiot", "moron"] * toxic), int(not junk), int(toxic)))
    df = spark.createDataFrame([(a, b) for a, b, _, _ in rows] + [(1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(a, c, d) for a, _, c, d in rows] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in quality.score(df, quality.train(df, labels)).collect()}
    held = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 5 == 0]
    assert sum((got[a] >= 0.3) == bool(q) for a, _, q, _ in held) > 0.9 * len(held) and 0 <= got[1000] <= 1 and got[1000] == got[1001]
    sev = {r["doc_id"]: r["expected_severity"] for r in toxicity.severity(df, *toxicity.train(df, labels)).collect()}
    assert sum((sev[a] >= 0.2) == bool(t) for a, _, _, t in held) > 0.9 * len(held)
    assert quality.score(empty, quality.train(empty, labels), keep=True).count() == 0
    assert toxicity.severity(empty, *toxicity.train(empty, labels)).count() == 0


def test_jaccard_components(docs, empty):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for t in texts():
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(sets)))
    for _ in root:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if i < j and a and b and root[i] != root[j] and 100 * len(a & b) >= 80 * len(a | b):
                    root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    got = {r["doc_id"]: r for r in jaccard_join.jaccard_components(docs).collect()}
    assert all((got[i]["n_shingles"], got[i]["component_id"]) == (len(s), root[i]) for i, s in enumerate(sets))
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == set(root)
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_nearest(spark):
    x = np.random.default_rng(2).standard_normal((1500, 16)).astype(np.float32)
    x[10:30] = x[10]
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(x)] + [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] + [1.0] * 15), (None, [1.0] * 16)]
    got = {}
    for r in nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    v = x.astype(float)
    hit = 0
    for q in range(0, 1500, 20):
        s = np.round(v @ v[q], 11)
        s[q] = -np.inf
        best = np.lexsort((np.arange(1500), -s))[:20].tolist()
        mine = [i for _, i, _ in sorted(got[q])]
        hit += len(set(best) & set(mine))
        assert [r for r, _, _ in sorted(got[q])] == list(range(1, 21))
    assert len(got) == 75 and hit >= 0.9 * 20 * 75
    assert nearest.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_secret_scan(docs, empty):
    got = {r["doc_id"]: r for r in secret_scan.summary(secret_scan.scan(docs)).collect()}
    for i, t in enumerate(texts()):
        spans = [(m.start(), 0, m.end()) for m in secret_scan.ASSIGN.finditer(t or "") if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 32]
        text = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert got[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert secret_scan.find_secrets("secret: api_key: abcdefgh12") == []
    assert [k for _, k, _ in secret_scan.find_secrets("key 9fK2xQ7vLm4TzR8wYb3N end")] == [3] and not secret_scan.find_secrets("123e4567-e89b-12d3-a456-426614174000")
    masked = {r["doc_id"]: r for r in secret_scan.redact(docs).collect()}
    assert "a9ce" not in masked[len(texts()) - 3]["text"] and masked[0]["text"] == texts()[0] and secret_scan.redact(empty).count() == 0


def keys(r, letters, size, groups=1, sep="-"):
    return sep.join("".join(r.choice(letters) for _ in range(size)) for _ in range(groups))


def entropy_hits(make, n=300):
    r = random.Random(7)
    return sum(any(k == 3 for _, k, _ in secret_scan.find_secrets(make(r))) for _ in range(n)) / n


def test_hexadecimal_keys_behind_a_name():
    for digits, size in (("0123456789abcdef", 20), ("0123456789abcdef", 31), ("0123456789ABCDEF", 32), ("0123456789ABCDEF", 40)):
        for name in ("", "key=", "key-", "my_key/"):
            assert entropy_hits(lambda r: name + keys(r, digits, size)) > 0.94
    assert not secret_scan.find_secrets("order=12345678901234567890")


def test_allowed_names_suppress_only_themselves():
    both = string.ascii_letters + string.digits
    assert entropy_hits(lambda r: "sk1-" + keys(r, both, 8, 4)) > 0.95
    assert entropy_hits(lambda r: "key2_" + keys(r, both, 12, 3, "_")) > 0.95
    assert entropy_hits(lambda r: "K7-" + keys(r, both, 5, 5)) > 0.7
    assert entropy_hits(lambda r: "api/example/" + keys(r, both, 40)) > 0.98
    assert entropy_hits(lambda r: keys(r, string.ascii_letters, 40)) > 0.98
    for name in ("getUserNameFromRequestHeader", "src/main/java/org/apache/spark/sql/CodeGenerator2", "Donaudampfschifffahrtsgesellschaft", "docs/2024/11/28/release-notes-v2", "id=123e4567-e89b-12d3-a456-426614174000", "api/example/changeme/xxxxxxxxxxxx"):
        assert not secret_scan.find_secrets(name)


def test_transport_streams(docs, empty):
    for n in (0, 1, 150, 176, 177, 184, 5000, 16_384, 16_385, 400_000):
        payload, _ = transport_stream.padded("x" * n)
        read = transport_stream.read_stream(transport_stream.write_stream(payload))
        assert read["payload"] == payload and read["gaps"] == 0 and len(read["times"]) == len(read["points"]) == -(-len(payload) // 16_384)
    media = bytearray(transport_stream.write_stream(bytes(5000)))
    del media[188 * 5 : 188 * 6]
    with pytest.raises(ValueError):
        transport_stream.read_stream(bytes(media))
    rows = transport_stream.summary(transport_stream.from_media(transport_stream.to_media(docs))).collect()
    for r in rows:
        payload, n = transport_stream.padded(texts()[r["doc_id"]])
        assert (r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert transport_stream.from_media(transport_stream.to_media(empty)).count() == 0


def test_pipeline_stages_follow_each_other(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 0
