import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import compare, evaluate, profile, splits


def test_paired_repeats(spark):
    rows = [(c, f, r, s, v + 0.1 * (f == "forest") + 0.01 * r) for c, f, v in (("l1", "logistic", 0.2), ("l2", "logistic", 0.1), ("f1", "forest", 0.2)) for r in range(5) for s in range(5)]
    df = spark.createDataFrame(rows, "candidate string, family string, repeat int, split int, average_precision double")
    pairs = evaluate.paired_repeats(df, "logistic", "forest")
    row = evaluate.paired_summary(pairs).first()
    assert row["repeats"] == row["challenger_wins"] == 5 and abs(row["mean_difference"] - 0.1) < 1e-9
    assert evaluate.sign_flip(pairs).first()["p_value"] == 0.0625
    with pytest.raises(ValueError):
        evaluate.paired_repeats(df.where("not (candidate = 'f1' and repeat = 4)"), "logistic", "forest")


def poisson_by_hand(spark, df, fractions, replicates):
    """The same weights, summed in Python row by row."""
    u = evaluate.hashed_uniform()
    rows = df.select("id", "score", "label", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep")).withColumn("u", u(F.col("rep"), F.col("id"))).collect()
    steps, out = evaluate.poisson_thresholds(), {}
    for f in fractions:
        capture, precision = [], []
        for rep in range(replicates):
            groups = {}
            for r in rows:
                if r["rep"] == rep:
                    w = sum(r["u"] >= t for t in steps)
                    g = groups.setdefault(r["score"], [0, 0])
                    g[0], g[1] = g[0] + w, g[1] + w * r["label"]
            n, total = (sum(g[i] for g in groups.values()) for i in (0, 1))
            left, hit = math.ceil(n * f), 0.0
            cut = left
            for s in sorted(groups, reverse=True):
                w, p = groups[s]
                if w and left > 0:
                    hit += p * min(1, left / w)
                    left -= w
            if total:
                capture.append(hit / total)
                precision.append(hit / cut)
        out[f] = [len(capture)] + [float(g(x)) for x in (capture, precision) for g in (np.mean, lambda x: np.quantile(x, 0.025), lambda x: np.quantile(x, 0.975))]
    return out


NAMES = ["replicates", "mean", "low", "high", "precision_mean", "precision_low", "precision_high"]


@pytest.mark.parametrize("groups", [1, 2, 8, 1024])
def test_poisson_interval_equals_a_plain_sum(spark, groups):
    for scores in ((F.col("id") * 37 % 100) / 100, F.floor(F.col("id") / 30) / 10, F.lit(0.5)):
        df = spark.range(150).select("id", scores.cast("double").alias("score"), ((F.col("id") % 11 == 0) | (F.col("id") > 140)).cast("int").alias("label"))
        got = {r["fraction"]: [r[n] for n in NAMES] for r in evaluate.poisson_interval(df, [0.05, 0.2, 1.0], 25, groups=groups).collect()}
        want = poisson_by_hand(spark, df, [0.05, 0.2, 1.0], 25)
        assert got.keys() == want.keys() and all(got[f] == pytest.approx(want[f], abs=1e-12) for f in want)


def test_poisson_interval_is_near_the_exact_one(spark):
    df = spark.range(400).select("id", ((F.col("id") * 7919 % 400) / 400).alias("score"))
    df = df.withColumn("label", (F.pmod(F.xxhash64("id"), F.lit(100)) < F.col("score") * 40).cast("int"))
    exact = evaluate.capture_interval(splits.bootstrap_draws(df.select("id"), "id", 400), df, [0.2]).first()
    near = evaluate.poisson_interval(df, [0.2], 400).first()
    assert exact["replicates"] == near["replicates"] == 400
    assert all(abs(exact[n] - near[n]) < 0.04 for n in NAMES[1:])
    whole = df.agg(F.sum(F.when(F.col("score") >= 0.8, F.col("label"))) / F.sum("label")).first()[0]
    assert near["low"] < whole < near["high"]


def test_intervals_of_nothing(spark):
    df = spark.range(20).select("id", F.lit(0.1).alias("score"), F.lit(0).alias("label"))
    for t in (df, df.limit(0)):
        row = evaluate.poisson_interval(t, [0.1], 5).first()
        assert row["replicates"] == 0 and row["mean"] is None and row["precision_high"] is None
    assert abs(sum(1 - t for t in evaluate.poisson_thresholds()) - 1) < 1e-12  # the mean of the weights


def test_capture_interval(spark):
    df = spark.range(100).select("id", (F.col("id") / 100).alias("score"), (F.col("id") >= 90).cast("int").alias("label"))
    got = evaluate.capture_interval(splits.bootstrap_draws(df.select("id"), "id", 50), df, [0.1, 1.0]).orderBy("fraction").collect()
    assert got[0]["precision_mean"] > got[1]["precision_mean"] and abs(got[1]["precision_mean"] - 0.1) < 0.02
    assert got[1]["low"] == got[1]["high"] == 1.0 and 0.5 < got[0]["low"] <= got[0]["mean"] <= got[0]["high"] <= 1.0
    none = df.withColumn("label", F.lit(0))
    assert evaluate.capture_interval(splits.bootstrap_draws(df.select("id"), "id", 5), none, [0.1]).first()["replicates"] == 0


def test_stored_values_must_agree_on_both_sides(spark):
    a = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 1.0)], "k int, x double, y double")
    b = spark.createDataFrame([(1, 1.0 + 1e-13, None), (3, 2.0, 1.0)], "k int, x double, y double")
    got = {(r["k"], r["field"]): r["agrees"] for r in evaluate.stored_check(a, b, ["k"], ["x", "y"]).collect()}
    assert got == {(1, "x"): True, (1, "y"): True, (2, "x"): False, (2, "y"): False, (3, "x"): False, (3, "y"): False}


def test_score_tables(spark):
    df = spark.createDataFrame([("a", 0.5, 1, 1), ("b", None, 0, 1), ("b", 0.2, 3, 5)], "id string, score double, label int, ts int")
    row = compare.score_contract(df, 1, F.lit(2)).first()
    assert (row["repeated_ids"], row["bad_scores"], row["bad_labels"], row["after_cutoff"], row["accepted"]) == (1, 1, 1, 1, False)
    w = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "b", 3), (3, "c", 3)], "w int, id string, ts int")
    assert [tuple(r) for r in compare.windows_disjoint(w, "w", "id", "ts").orderBy("w").collect()] == [(1, 2, 1, True), (2, 1, 1, True), (3, 1, 0, False)]


def test_logs_and_keys(spark):
    df = spark.createDataFrame([("m", 0, 1.0, 5), ("m", 10, None, 6), ("m", 10, 2.0, 1)], "k string, s int, x double, c int").withColumn("ts", F.timestamp_seconds("s"))
    row = profile.log_audit(df, "k", ["ts", "c"], "ts", "x", "c").first()
    assert (row["records"], row["without_value"], row["gaps"], row["repeats"], row["median_step_us"]) == (3, 1, 1, 1, 5_000_000.0)
    keys = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), (None, 1)], "k string, x int")
    assert sorted(map(tuple, profile.key_audit(keys, "k", ["x"]).collect())) == [(0, 1, 0), (1, 1, 0), (2, 1, 1)]
    assert profile.manifest_match(keys.where("k = 'b'"), keys.where("k is not null").distinct(), "k", ["x"]).first().asDict() == {"found": 1, "absent": 1, "changed": 0, "unknown": 0}


def test_logistic_scores_cover_all_rows_and_tell_the_class(spark, tmp_path):
    import random
    import zlib

    from gaugeworks.plans import registry

    r = random.Random(6)
    rows = [(i, [float(i % 4 == 3) + r.gauss(0, 0.3), r.gauss(0, 1), r.gauss(0, 1)], i % 4) for i in range(240)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.QUERIES["mod_logistic_scores"](spark, str(tmp_path)).cache()
    assert sorted(x["id"] for x in got.collect()) == list(range(240))
    assert all(x["held_out"] == (zlib.crc32(str(x["id"]).encode()) % 5 == 0) and 0 <= x["score"] <= 1 and x["label"] == int(x["id"] % 4 == 3) for x in got.collect())
    assert evaluate.roc_auc(got.where("held_out")).first()[0] > 0.9
