"""Golden values of the operators on hand-made rows."""

import datetime
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.functions.ranking import global_rank
from gaugeworks.operators import compare, contracts, evaluate, features, review, spc, windowed
from gaugeworks.plans import registry
from gaugeworks.sources import readers
from gaugeworks.streaming import readings


def series(spark, values):
    return spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, i int, value double")


def test_individuals_chart_worked_example(spark):
    base = [49.6, 47.6, 49.9, 51.3, 47.8, 51.2, 52.6, 52.4, 53.6, 52.1]
    chart = spc.individuals_chart(series(spark, [*base, 56.0, 45.0, 50.0, None]), "k", ["i"])
    rows = chart.orderBy("i").collect()
    assert (round(rows[0]["center"], 2), round(rows[0]["ucl"], 4), round(rows[0]["lcl"], 4)) == (50.81, 55.8041, 45.8159)
    assert [r["status"] for r in rows[10:]] == ["above_limit", "below_limit", "within_limits", "unknown"]


def test_suspect_and_short_baselines(spark):
    rows = spc.individuals_chart(series(spark, [100.0] * 9 + [200.0, 100.0, None]), "k", ["i"]).orderBy("i").collect()
    assert [r["status"] for r in rows[-2:]] == ["baseline_review_required", "unknown"]
    assert spc.individuals_limits(series(spark, [1.0, 2.0]), "k", ["i"]).first()["baseline_state"] == "baseline_too_short"


def test_cusum_equals_the_step_by_step_fold(spark):
    values = [0.2, 1.4, 2.2, -0.3, 3.0, 0.1, -4.0, -2.0, 0.0]
    rows = series(spark, values).withColumnRenamed("i", "k2").withColumn("k", F.col("k2")).withColumn("s", F.lit("x"))
    got = windowed.statistics(rows, "s", 0.0, 1.0, windowed.Config(width=1, period=1)).orderBy("k").collect()
    up = down = e = 0.0
    for x, r in zip(values, got, strict=True):
        up, down, e = max(0, up + x - 0.5), max(0, down - x - 0.5), 0.2 * x + 0.8 * e
        assert abs(r["cusum"] - max(up, down)) < 1e-9 and abs(r["ewma"] - abs(e) / (0.2 / 1.8) ** 0.5) < 1e-9


def test_classification_and_ties(spark):
    df = spark.createDataFrame([("a", 0, 0.1), ("b", 0, 0.8), ("c", 1, 0.7), ("d", 1, 0.9)], "id string, label int, score double")
    m = evaluate.classification_metrics(df).first()
    assert (m["tp"], m["fp"], m["recall"]) == (2, 1, 1.0)
    tied = spark.createDataFrame([("b", 0, 0.9), ("a", 1, 0.9), ("c", 0, 0.8), ("d", 1, 0.1)], "id string, label int, score double")
    rows = evaluate.top_k(tied, [0.25, 0.5]).orderBy("fraction").collect()
    assert [(r["inspected"], r["captured"]) for r in rows] == [(1, 1), (2, 1)]


def test_registered_sign_flip_covers_all_rows(spark, tmp_path):
    rows = [(i, f"s{i % 20:02d}") for i in range(3000)]
    spark.createDataFrame(rows, "doc_id long, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    groups = {}
    for i, _ in rows:
        groups.setdefault(zlib.crc32(str(i).encode()) % 16, []).append(round(i * 7919 % 1000 / 1000, 3) - round(i * 104729 % 1000 / 1000, 3))
    d = [round(sum(x) / len(x), 9) for x in groups.values()]
    totals = np.array([0.0])
    for x in d:
        totals = np.concatenate([totals + x, totals - x])
    got = registry.eval_sign_flip(spark, str(tmp_path)).first()
    assert len(d) == 16 and abs(got["p_value"] - (np.abs(totals) >= abs(sum(d)) - 1e-12).mean()) < 1e-3 and abs(got["mean_difference"] - np.mean(d)) < 1e-5


def test_sign_flip(spark):
    assert evaluate.sign_flip(spark.createDataFrame([(0.1,)] * 5, "d double")).first()["p_value"] == 0.0625


def test_transitions(spark):
    before = spark.createDataFrame([("a", 1, 0.9), ("b", 0, 0.8), ("c", 1, 0.7), ("d", None, 0.1)], "id string, label int, score double")
    after = spark.createDataFrame([("a", 1, 0.9), ("b", 0, 0.1), ("c", 1, 0.8), ("d", None, 0.2)], "id string, label int, score double")
    n = {(r["label_class"], r["move"]): r["n"] for r in compare.transitions(before, after, 2).collect()}
    assert n["fail", "newly_selected"] == 1 and n["normal", "newly_removed"] == 1 and sum(n.values()) == 4
    with pytest.raises(ValueError):
        compare.transitions(before, after.where("id <> 'a'"), 2)


def test_regularise_collisions_and_skew(spark):
    t = datetime.datetime(2025, 1, 1)
    at = lambda s: t + datetime.timedelta(seconds=s)
    df = spark.createDataFrame([("p", at(0), None), ("p", at(1), 2.0), ("p", at(302), -0.5), ("p", at(640), 1.0)], "k string, ts timestamp, value double")
    slots, rejected = contracts.regularise(df, "k", "ts", "value", 300, 30)
    assert [(r["value"], r["clipped"]) for r in slots.orderBy("slot").collect()] == [(2.0, 2.0), (-0.5, 0.0)] and rejected.count() == 1


def test_local_times_that_do_not_exist_or_come_twice(spark):
    df = spark.sql("SELECT explode(array(timestamp_ntz'2024-03-31 02:30:00', timestamp_ntz'2024-10-27 02:30:00', timestamp_ntz'2024-07-01 12:00:00')) AS t")
    got = [r[0] for r in df.select(contracts.localise(F.col("t").cast("timestamp"), "Europe/Paris")).collect()]
    assert got == [None, None, datetime.datetime(2024, 7, 1, 10)]


def test_strict_contract_raises(spark):
    rules = [contracts.Rule("negative", F.col("value") < 0)]
    with pytest.raises(ValueError):
        contracts.apply_contract(series(spark, [1.0, -1.0]), rules, "strict")
    good, bad = contracts.apply_contract(series(spark, [1.0, -1.0, None]), rules)
    assert (good.count(), bad.count()) == (2, 1)


def test_column_filter(spark):
    df = spark.createDataFrame([(i, float(i), 1.0, None if i < 8 else 1.0 * i, float(i)) for i in range(10)], "id int, keep double, constant double, high_missing double, duplicate_keep double")
    assert features.fit_columns(df, "id", ["keep", "constant", "high_missing", "duplicate_keep"]) == ["keep"]


def test_decisions(spark):
    queue = spark.createDataFrame([("a",), ("b",)], "review_id string")
    d = spark.createDataFrame([("a", 1, 2, "false_alarm", "release"), ("z", 1, 2, "false_alarm", "release")], "review_id string, decided_at int, recorded_at int, outcome string, action string")
    bound, rejected = review.bind_decisions(queue, d)
    assert {r["review_id"]: r["state"] for r in bound.collect()} == {"a": "decided", "b": "pending"}
    assert [r["reason"] for r in rejected.collect()] == ["unknown_review"]


def test_global_rank_matches_a_sort(spark):
    df = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(97)).alias("x"), "id")
    got = [(r["x"], r["id"]) for r in global_rank(df, F.asc("x"), F.asc("id")).orderBy("rank").collect()]
    assert got == sorted(got) and len(got) == 1000


def test_readers(spark, tmp_path):
    (tmp_path / "m.txt").write_text("1 NaN 3\n4 5 6\n")
    assert [r["features"] for r in readers.matrix(spark, str(tmp_path / "m.txt")).orderBy("line").collect()] == [[1.0, None, 3.0], [4.0, 5.0, 6.0]]
    (tmp_path / "r.json").write_text('{"readings": [{"asset_code": "a", "ts": "t", "reading": {"p": 1.5}}]}')
    assert readers.readings_json(spark, str(tmp_path / "r.json")).first()["reading"] == {"p": 1.5}


def test_stream_equals_its_batch_twin(spark, tmp_path):
    t0 = datetime.datetime(2025, 1, 1)
    at = lambda s: t0 + datetime.timedelta(seconds=s)
    rows = [("a", at(0), 1.0, at(1), 1), ("a", at(0), 1.0, at(2), 2), ("a", at(10), 1.0, at(1000), 3), ("a", at(900), 1.0, at(100), 4), ("a", at(500), 1.0, at(501), 5), ("b", at(0), 2.0, at(1), 6)]
    df = spark.createDataFrame(rows, "asset string, ts timestamp, value double, observed_at timestamp, seq long")
    df.write.parquet(str(tmp_path / "in"))
    stream = readings.stateful(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    readings.write_batches(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    accepted = {r["seq"] for r in spark.read.parquet(str(tmp_path / "out/accepted")).collect()}
    dead = {r["seq"]: r["reason"] for r in spark.read.parquet(str(tmp_path / "out/dead")).collect()}
    twin = {r["seq"]: r["reason"] for r in readings.batch(df).collect()}
    assert accepted == {s for s, r in twin.items() if r is None} and dead == {s: r for s, r in twin.items() if r}
    assert spark.read.parquet(str(tmp_path / "out/alerts")).count() == 1
