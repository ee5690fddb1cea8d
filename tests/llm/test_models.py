"""The trained operators against plain loops, and edge cases of all operators that the main tests leave out."""

import hashlib
import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gaugeworks.llm import features, jaccard_join, license_scan, mixing, nearest, quality, secret_scan, sentencepiece_codec, toxicity, transport_stream
from gaugeworks.llm.queries import THRESHOLD, tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_follow_the_leader_equals_its_formula():
    r = random.Random(3)
    rows = [([r.randrange(6) for _ in range(3)], r.randrange(2)) for _ in range(10)]
    rows = [(sorted(set(at)), y) for at, y in rows]
    model = quality.Leader(6, rate=0.3, beta=1.0, l1=0.02, l2=0.01)
    z, n = [0.0] * 6, [0.0] * 6
    for at, y in rows * 2:
        w = [0.0 if abs(z[i]) <= 0.02 else -(z[i] - math.copysign(0.02, z[i])) / ((1 + math.sqrt(n[i])) / 0.3 + 0.01) for i in at]
        mine = model.weights(np.array(at))
        assert np.allclose(mine, w)
        p = 1 / (1 + math.exp(-sum(w)))
        model.update(np.array(at), mine, np.full(len(at), p - y))
        for i, wi in zip(at, w):
            g = p - y
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.3 * wi
            n[i] += g * g


def test_scores_are_sparse_dot_products(spark):
    r = np.random.default_rng(1)
    w = r.normal(size=(1 << quality.BITS) + 1)
    texts = ["one two three", "one one, two!", "", None, "ein Wort\n\nmehr"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["score"] for x in quality.score(df, w).collect()}
    for i, t in enumerate(texts):
        found, off = features.ngrams(pa.array([t], pa.string()), quality.BITS)
        s = sum(w[f] for f in found) / max(1, len(found)) * quality.SCALE + w[-1]
        assert off[-1] == len(found) and abs(got[i] - 1 / (1 + math.exp(-np.clip(s, -35, 35)))) < 1e-9
    assert len(features.ngrams(pa.array(["a b a b"]), 18)[0]) == 4 + 3


def loss(w, t, at, x, grade):
    reach = [1.0, *(1 / (1 + math.exp(-(sum(w[i] * v for i, v in zip(at, x)) - b))) for b in t), 0.0]
    return -math.log(reach[grade] - reach[grade + 1])


def test_ordinal_gradient_and_fit():
    at, x, w, t, eps = [0, 2], [0.5, 2.0], [0.3, 0.0, -0.7], [0.2, 1.1], 1e-6
    for grade in (0, 1, 2):
        reach = np.array([1.0, *(1 / (1 + np.exp(-(0.5 * 0.3 - 2.0 * 0.7 - np.array(t))))), 0.0])
        for j, i in enumerate(at):
            up = [a + eps * (k == i) for k, a in enumerate(w)]
            assert abs((loss(up, t, at, x, grade) - loss(w, t, at, x, grade)) / eps - x[j] * (reach[grade] + reach[grade + 1] - 1)) < 1e-4
    rows = pd.DataFrame({"at": [np.array([1, 9]), np.array([2, 9]), np.array([3, 9]), np.array([2, 3])] * 60, "label": [1, 0, 0, 0] * 60})
    weights, seen, thresholds = toxicity.fit(rows)
    assert weights[1] > 0 > min(weights[2], weights[3]) and list(seen[[1, 2, 3, 9]]) == [60, 120, 120, 180] and thresholds[0] < thresholds[1]


def test_severity_is_the_sum_over_thresholds(spark):
    r = np.random.default_rng(1)
    w, idf, t = r.normal(size=1 << toxicity.BITS), r.random(1 << toxicity.BITS) + 0.1, np.array([0.1, 0.9])
    texts = ["some longer words here", "", None, "some some some"]
    got = {x["doc_id"]: x for x in toxicity.severity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), w, t, idf).collect()}
    for i, text in enumerate(texts):
        at = np.unique(toxicity.marks(pa.array([text], pa.string()))[0])
        v = idf[at] * toxicity.LENGTH / math.sqrt(max((idf[at] ** 2).sum(), 1e-12))
        reach = 1 / (1 + np.exp(-((w[at] * v).sum() - t)))
        assert abs(got[i]["expected_severity"] - reach.sum()) < 1e-4 and got[i]["grade"] == (reach >= toxicity.CUT).sum()


def test_training_edges(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} other", "x") for i in range(60)] + [(3, "word3 other", "y")], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, i % 2, int(i % 7 == 0)) for i in range(60)] + [(1, None, None), (2, 1, 1), (2, 1, 1)], "doc_id long, quality int, toxic int")
    for df in (docs, docs.union(docs)):
        assert quality.score(df, quality.train(df, labels)).count() == toxicity.severity(df, *toxicity.train(df, labels)).count() == df.count()
    none = labels.limit(0)
    assert {x["score"] for x in quality.score(docs, quality.train(docs, none)).collect()} == {0.5}
    assert all(x["expected_severity"] < 1e-9 and x["grade"] == 0 for x in toxicity.severity(docs, *toxicity.train(docs, none)).collect())
    kept = quality.score(docs.withColumn("score", F.lit("mine")), quality.train(docs, labels), keep=True, name="other")
    assert kept.columns == ["doc_id", "text", "label", "score", "other"] and kept.first()["score"] == "mine"


def entropy(s):
    return -sum(s.count(c) / len(s) * math.log2(s.count(c) / len(s)) for c in set(s))


def test_entropy_windows_equal_a_plain_count():
    r = random.Random(8)
    hexa, plain = "0123456789abcdefABCDEF", "abcdefghijKLMNOPQ0123456789+/"
    for _ in range(200):
        s = "".join(r.choice(r.choice((hexa, plain, "aab1"))) for _ in range(r.randint(5, 80)))
        assert covered_by_windows(s) == {i for a, b in secret_scan.entropy_spans(s) for i in range(a, b)}


def covered_by_windows(s, window=secret_scan.WINDOW):
    """Positions of s in a window whose plain entropy reaches its class's threshold."""
    hexa, out = "0123456789abcdefABCDEF", set()
    for k in range(len(s) - window + 1):
        w = s[k : k + window]
        of_hex = all(c in hexa for c in w) and any(c > "9" for c in w)
        if entropy(w) >= (secret_scan.HEX_BITS if of_hex else secret_scan.OTHER_BITS) - 1e-9:
            out |= set(range(k, k + window))
    return out


def runs(r, longest=500):
    """Text of runs of one character, of random lengths."""
    out = ""
    while len(out) < longest:
        out += r.choice("aAfF09zZq+/_=-g") * r.choice((1, 1, 1, 2, 3, 19, 20, 21, 22, 40, r.randint(1, 90)))
    return out[: r.randint(0, longest)]


def test_runs_of_one_character_have_a_result():
    r = random.Random(21)
    for n in (19, 20, 21, 22, 23, 40, 41, 300_000):
        for c in "aAfF0zZ=/":
            for around in ("", "zzz_", "iVBORw0KGgo", "key=" + "q7Rt2LpXz9", "0f3b"):
                s = around + c * n
                if n < 100:
                    assert covered_by_windows(s) == {i for a, b in secret_scan.entropy_spans(s) for i in range(a, b)}
                elif not around:
                    assert [x for x in secret_scan.find_secrets(s) if x[1] == 3] == []
                secret_scan.find_secrets(s)
    for _ in range(150):
        s = runs(r)
        assert covered_by_windows(s) == {i for a, b in secret_scan.entropy_spans(s) for i in range(a, b)}
        for a, k, b in secret_scan.find_secrets(f"x {s} y"):
            assert 0 <= a < b <= len(s) + 4 and k in range(4)
    for window in (1, 2, 7, 33):
        assert secret_scan.entropy_spans("a" * 90, window) == []


def test_runs_of_one_character_in_scan_redact_and_pipeline(spark):
    long = "A" * 300_000
    rows = [(1, "a" * 21), (2, "x " + long + " y"), (3, "iVBORw0KGgo" + "A" * 30), (4, f"token={'q' * 22} {long}"), (5, "f" * 32 + long), (6, None)]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    got = {x["doc_id"]: x["spans"] for x in secret_scan.summary(secret_scan.scan(docs)).collect()}
    assert got == {1: "", 2: "", 3: "", 4: "assign:0:28", 5: "hex:0:32", 6: ""}
    for stage in (secret_scan.redact(docs), corpus_pipeline.mask_secrets(spark, docs, "")):
        masked = {x["doc_id"]: x["text"] for x in stage.collect()}
        assert masked[4] == f"<secret> {long}" and masked[5] == "<secret>" + long and [masked[i] for i in (1, 2, 3, 6)] == [rows[i - 1][1] for i in (1, 2, 3, 6)]


def sources(spark, sizes):
    rows = [(f"{s}{i}", " ".join(["w"] * n), s) for s, ns in sizes.items() for i, n in enumerate(ns)]
    return spark.createDataFrame(rows, "doc_id string, text string, source string")


def level(sizes, weights=(5, 2, 1), most=3):
    """Targets by handing the rest on again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    cap, left, target, open_ = {s: most * sum(sizes[s]) for s in names}, sum(map(sum, sizes.values())), dict.fromkeys(names, 0.0), set(names)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        given = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s, g in given.items():
            target[s] += g
            if target[s] >= cap[s]:
                left += target[s] - cap[s]
                target[s] = float(cap[s])
                open_.discard(s)
    return target


@pytest.mark.parametrize("sizes", [{"a": [300] * 3, "b": [900] * 9, "c": [50, 7]}, {None: [10, 20]}, {"a": [0, 0], None: [5]}, {"a": [0], "b": [0]}, {"a": [1], "b": [40], "c": [2000], "d": [3], None: [500] * 4}])
def test_mixing_targets(spark, sizes):
    docs = sources(spark, sizes).withColumn("ratio", F.lit("clash")).withColumn("sid", F.lit("clash"))
    want, rows = level(sizes), mixing.taken(mixing.mix(docs)).join(docs.select("doc_id", "source"), "doc_id").collect()
    assert len(rows) == docs.count()
    for s in sizes:
        mine = [r for r in rows if r["source"] == s]
        assert all(abs(r["target"] - want[s]) < 1e-6 and r["source_size"] == sum(sizes[s]) and r["taken"] <= 3 * r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= 1
    again = mixing.taken(mixing.mix(docs.repartition(5))).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in rows)


def brute_nearest(rows, k=20, every=20):
    out = {}
    for q, x in rows.items():
        if q % every == 0:
            s = sorted(((-float(np.dot(x, v)), i) for i, v in rows.items() if i != q))
            out[q] = [i for _, i in s[:k]]
    return out


@pytest.mark.parametrize("scale", [1.0, 1e-7, 1e7, 1e150])
def test_nearest_in_any_unit_and_over_cells(spark, scale):
    r = np.random.default_rng(5)
    centres = r.normal(size=(12, 24))
    v = (centres[r.integers(0, 12, 3000)] + 0.05 * r.normal(size=(3000, 24))) * scale
    rows = {i: v[i] for i in range(3000)}
    df = spark.createDataFrame([(i, x.tolist(), "clash") for i, x in rows.items()] + [(0, (v[0] + 1e9 * scale).tolist(), "again")], "vec_id long, embedding array<double>, rank string")
    got = {}
    for x in nearest.nearest(df, block=512).collect():
        got.setdefault(x["query_id"], {})[x["rank"]] = (x["vec_id"], x["score"])
    rows[0] = np.array(min(v[0].tolist(), (v[0] + 1e9 * scale).tolist()))
    want = brute_nearest(rows)
    hits = sum(len(set(want[q]) & {i for i, _ in got[q].values()}) for q in want)
    assert got.keys() == want.keys() and hits >= 0.9 * 20 * len(want)
    for q, found in got.items():
        assert sorted(found) == list(range(1, 21)) and all(abs(s - np.dot(rows[q], rows[i])) <= 1e-12 * abs(s) + 1e-300 for i, s in found.values())


def test_the_chi_square_stop_leaves_leaves_shut():
    r = np.random.default_rng(7)
    centres = 3 * r.normal(size=(40, 32))
    v = centres[r.integers(0, 40, 8000)] + 0.1 * r.normal(size=(8000, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    space = nearest.Space(32, 1.0, float((v * v).sum(axis=1).max()))
    leaves = nearest.build_block(pd.DataFrame({"vec_id": np.arange(8000), "v": list(v)}), space)
    at = np.arange(0, 8000, 20)
    row, found, _, (opened, verified) = nearest.search_block(v[at], at, np.full(len(at), -np.inf), leaves, 20, space)
    want = brute_nearest({i: v[i] for i in range(8000)})
    hits = sum(i in set(want[at[k]]) for k, i in zip(row.tolist(), found.tolist()))
    assert hits >= 0.9 * 20 * len(at) and opened < 0.5 and verified < 0.25


def test_equal_vectors_and_few_candidates(spark):
    rows = [(i, [1.0, 2.0]) for i in range(100)] + [(200, [0.5, 0.5]), (201, [1.0]), (220, [2.0, 2.0])]
    got = {}
    for x in nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"]))
    assert [i for _, i in sorted(got[40])] == [220, *range(19)] and [i for _, i in sorted(got[0])] == [220, *range(1, 20)]
    few = nearest.nearest(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(x["query_id"], x["vec_id"], x["score"]) for x in few] == [(0, 1, 5.0), (0, 2, 5.0)]


def test_a_difference_is_left_to_the_library():
    m = sentencepiece_codec.Merger(tokenizer("piece_bpe_32k.model"))
    texts = ["the other text", "plain", None]
    i = m.pieces["▁the"]
    m.place[i] = sentencepiece_codec._NEVER  # the agenda no longer knows this piece
    ids, decoded, odd = m.texts(pa.array(texts, pa.string()))
    assert ids.to_pylist() == [m.library.encode(t or "") for t in texts] and decoded.to_pylist() == [t or "" for t in texts] and odd.tolist() == [True, False, False]


def test_segments_in_rows_equal_the_heap(monkeypatch):
    m = sentencepiece_codec.Merger(tokenizer("piece_bpe_32k.model"))
    r = random.Random(6)
    some = ["▁" + "".join(r.choice("theandiroéß日\n😀,.") for _ in range(r.randint(0, 90))) for _ in range(500)]
    monkeypatch.setattr(sentencepiece_codec, "KNOWN", 200)
    for a in range(0, 500, 100):
        ids, decoded, odd = m.texts(pa.array([s[1:] or "x" for s in some[a : a + 100]]))
        assert not odd.any() and len(m.keys) <= 400
        for s, x, d in zip(some[a : a + 100], ids.to_pylist(), decoded.to_pylist()):
            assert x == m.merge(s if len(s) > 1 else "▁x") and d == (s[1:] or "x")


def test_lost_and_repeated_packets():
    payload = bytes(range(256)) * 256
    media = transport_stream.write_stream(payload)
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    twice = transport_stream.read_stream(b"".join([*packets[:10], packets[9], *packets[10:]]))
    assert twice["payload"] == payload and twice["gaps"] == 0
    lost = transport_stream.read_stream(b"".join(packets[:10] + packets[11:]), strict=False)
    assert (lost["gaps"], lost["damaged"], lost["payload"]) == (1, 1, payload[transport_stream.UNIT :])
    with pytest.raises(ValueError):
        transport_stream.read_stream(b"".join(packets[:10] + packets[11:]))


def test_license_edges(spark):
    known = license_scan.known_licenses(spark)
    schema = "doc_id long, text string, license_id string"
    assert license_scan.license_scan(spark.createDataFrame([], schema), known).count() == 0
    long = "word " * 50_000 + "\nReleased under the MIT License."
    got = license_scan.license_scan(spark.createDataFrame([(1, long, "x"), (1, long, "x"), (2, None, "x")], schema), known).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["license_id"], r["notice_ids"]) for r in got] == [(1, None, "MIT-notice"), (1, None, "MIT-notice"), (2, None, "")]


def test_licenses_inside_longer_texts(spark):
    texts = dict(license_scan.whole_texts())
    mit = license_scan.KNOWN["MIT"].replace("\n", "\n\n").replace("Copyright (c)", "Copyright (c) 2020 Some Body")
    bare = mit.split("\n\n", 2)[2]
    bsd = texts["BSD-3-Clause"]
    rows = [(1, f"Preface\n\n{mit}\n\nand more"), (2, f"x\n  \n{bare.upper()}\n\n{bsd}"), (3, mit.replace("\n\nThe above", "\n\nA paragraph between.\n\nThe above")), (4, bare.split("\n\n")[0]), (5, None), (6, mit), (6, mit)]
    known, runs = license_scan.known_licenses(spark), license_scan.known_runs(spark)
    got = sorted((r["doc_id"], r["embedded_ids"]) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), known, runs=runs).collect())
    assert got == [(1, "MIT"), (2, "BSD-3-Clause,MIT"), (3, ""), (4, ""), (5, ""), (6, "MIT"), (6, "MIT")]


def test_jaccard_edges(spark):
    same = " ".join(f"w{i}" for i in range(30))
    rows = [(None, same), (3, same), (1, same + " tail"), (1, "other words that nobody else has at all"), (1, same + " tail"), (5, ""), (6, "  \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("root", F.lit("clash")).withColumn("node", F.lit("clash"))
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df).collect())
    assert got == sorted([("None", 26, 1), ("3", 26, 1), ("1", 27, 1), ("1", 27, 1), ("1", 4, 1), ("5", 0, 5), ("6", 0, 6)])
    kept = sorted((str(r["doc_id"]), r["text"]) for r in jaccard_join.keep_one(df).collect())
    assert kept == sorted([("1", same + " tail"), ("1", rows[3][1]), ("5", ""), ("6", "  \n")])
    passage = " ".join(f"p{i}" for i in range(60))  # that all share, between words of their own
    hot = spark.createDataFrame([(i, f"start{i} {passage} end{i}") for i in range(60)], "doc_id long, text string")
    assert jaccard_join.jaccard_components(hot).select("component_id").distinct().count() == 1


def pipeline_docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("mine")).withColumn("_score", F.lit(1)).withColumn("_key", F.lit(2))


def test_pipeline_stages_keep_rows_and_columns(spark, tmp_path):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    texts = [" ".join(word() for _ in range(60)) for _ in range(80)]
    rows = [(i, t if i % 5 else t.replace(" ", "### "), "en", ["a", "b", None][i % 3], len(t)) for i, t in enumerate(texts)]
    rows += [(100, texts[1], "en", "a", 1), (101, texts[2] + " token = a9ce335683f9772ddc", "en", "b", 1), (None, None, None, None, None), (103, "", "en", "a", 0)]
    docs = pipeline_docs(spark, rows)
    spark.createDataFrame([(i, int(bool(i % 5)), 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d = str(tmp_path)
    good = corpus_pipeline.keep_quality(spark, docs, d)
    weights = quality.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    want = {x["doc_id"] for x in quality.score(docs, weights).where(F.col("score") >= THRESHOLD).collect()}
    assert good.columns == docs.columns and {x["doc_id"] for x in good.collect()} == want and good.first()["score"] == "mine" and not any(i is not None and i < 80 and i % 5 == 0 for i in want)
    one = corpus_pipeline.keep_distinct(spark, good, d)
    assert one.columns == docs.columns and {x["doc_id"] for x in one.collect()} == want - {100, 101}
    masked = {x["doc_id"]: x for x in corpus_pipeline.mask_secrets(spark, docs, d).collect()}
    assert masked[101]["text"] == texts[2] + " <secret>" and masked[101]["n_chars"] == len(masked[101]["text"]) and masked[None]["text"] is None and masked[1]["text"] == texts[1]
    mixed = corpus_pipeline.mix_sources(spark, docs, d)
    assert mixed.columns == docs.columns and mixed.where("text is null or text = ''").count() == 0
    ids = corpus_pipeline.encode(spark, docs, d).collect()
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    by_id = {a: b for a, b, *_ in rows}
    for x in ids:
        e = lib.encode(by_id[x["doc_id"]] or "")
        assert (x["n_tokens"], x["ids_sha256"]) == (len(e), hashlib.sha256(",".join(map(str, e)).encode()).hexdigest())
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, d).count() == 0
