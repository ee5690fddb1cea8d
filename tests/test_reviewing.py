"""Context reviews, saved tables, sinks, readers and models on hand-made rows."""

import datetime
import gzip
import json
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions.ranking import exact_quantiles, group_rank, running_sums
from gaugeworks.operators import compare, contracts, evaluate, features, models, profile, review, splits
from gaugeworks.plans import registry
from gaugeworks.sources import readers, sinks

T = lambda m: datetime.datetime(2026, 1, 1, 0, m)


def test_series_without_a_baseline_are_withheld_and_kept(spark):
    rows = spark.createDataFrame([("a", T(1), 1.0), ("a", T(9), 2.0), ("b", T(1), None), ("c", T(1), 1.0)], "k string, ts timestamp, value double")
    changes = spark.createDataFrame([("a", T(5))], "k string, effective_at timestamp")
    base = spark.createDataFrame([("a", T(0), T(2), False), ("c", T(0), T(2), True)], "k string, baseline_start timestamp, baseline_end timestamp, flagged boolean")
    cover = spark.createDataFrame([("a", T(0), T(10), True), ("b", T(0), T(10), False)], "k string, start timestamp, end timestamp, complete boolean")
    got = sorted((r["k"], r["ts"].minute, ",".join(r["hold_reasons"]), r["state"]) for r in review.context_holds(rows, changes, base, "k", coverage=cover).collect())
    assert got == [
        ("a", 1, "", "context_clear"), ("a", 9, "change_after_baseline", "withheld"), ("b", 1, "history_coverage_unverified,baseline_absent,measurement_missing", "withheld"),
        ("c", 1, "history_coverage_unverified,statistical_baseline_requires_review", "withheld"),
    ]
    spans = spark.createDataFrame([("a", T(4), T(5), T(6))], "k string, first timestamp, baseline_end timestamp, last timestamp")
    all_changes = spark.createDataFrame([("a", T(m)) for m in (3, 5, 6, 7)] + [("z", T(1))], "k string, effective_at timestamp")
    mine, other = review.change_timeline(all_changes, spans, "k")
    assert [r["period"] for r in mine.orderBy("effective_at").collect()] == ["before_baseline", "baseline", "monitoring", "scheduled"] and other.count() == 1


@pytest.mark.parametrize("ids", [1, 2, 4096])
def test_related_changes_over_long_histories(spark, monkeypatch, ids):
    monkeypatch.setattr(review, "IDS", ids)
    monkeypatch.setattr(review._related, "__defaults__", (ids,))
    r = random.Random(6)
    at = lambda m: datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=m)
    rows = [(k, r.randint(0, 60), i) for k in "abc" for i in range(40)] + [("none", 5, 1), ("unbased", 5, 2)]
    changes = [(k, r.randint(-5, 70), f"c{i:02d}") for k in "ab" for i in range(30)] + [("unbased", 3, "x"), ("other", 3, "y"), ("a", 20, "same2"), ("a", 20, "same1")]
    bases = {"a": (10, 20), "b": (5, 5), "c": (0, 9), "none": (0, 9)}
    got = review.context_holds(
        spark.createDataFrame([(k, at(t), i, 1.0) for k, t, i in rows], "k string, ts timestamp, i int, value double"), spark.createDataFrame([(k, at(t), c) for k, t, c in changes], "k string, effective_at timestamp, name string"),
        spark.createDataFrame([(k, at(a), at(b)) for k, (a, b) in bases.items()], "k string, baseline_start timestamp, baseline_end timestamp"), "k", change_id="name").collect()
    assert len(got) == len(rows)
    for x in got:
        t = next(t for k, t, i in rows if (k, i) == (x["k"], x["i"]))
        a, b = bases.get(x["k"], (None, None))
        want = sorted((c, n) for k, c, n in changes if a is not None and k == x["k"] and (a <= c <= b or b < c <= t))
        assert x["related_changes"] == [n for _, n in want] and len(want) == x["changes_inside"] + x["changes_after"]


def test_knowledge_cutoff_and_queue_integrity(spark):
    rows = spark.createDataFrame([("a", T(1)), ("a", T(20))], "k string, ts timestamp")
    history = spark.createDataFrame([("a", T(12), T(0), T(13)), ("b", T(5), T(0), T(4))], "k string, available_at timestamp, start timestamp, end timestamp")
    changes = spark.createDataFrame([("b", T(6)), ("b", T(5))], "k string, available_at timestamp")
    got = {(r["k"], r["reason"]): r["n"] for r in review.knowledge_cutoff(rows, history, changes, "k", F.lit(T(10))).collect()}
    assert got == {("a", "measurement_after_cutoff"): 1, ("a", "history_unavailable_at_cutoff"): 1, ("a", "coverage_dates_invalid"): 1, ("b", "change_postdates_history"): 1}
    q = spark.createDataFrame([("s1", "p", 1.0, "ab"), ("s2", "p", None, "ab")], "sample_id string, measurement string, value double, source_sha256 string")
    names = ["sample_id", "measurement", "value"]
    q = q.withColumn("evidence_sha256", review.evidence_digest(names)).withColumn("review_id", review.review_identity(F.col("source_sha256"), F.col("sample_id"), F.col("measurement")))
    assert review.queue_integrity(q, names).count() == 0
    bad = q.withColumn("value", F.coalesce("value", F.lit(5.0))).unionByName(q.where("sample_id = 's1'"))
    assert {(tuple(r["reasons"])) for r in review.queue_integrity(bad, names).collect()} == {("review_id_repeated",), ("evidence_digest_differs",)}


def test_psi_of_constant_and_missing_references(spark):
    def one(ref, cur):
        a, b = (spark.createDataFrame([(x,) for x in xs], "x double") for xs in (ref, cur))
        return evaluate.psi(a, b, "x").first()["psi"]

    assert one([5.0] * 4, [5.0, None]) == 0.0 and one([5.0] * 4, [9.0] * 4) == math.inf and one([None] * 3, [float("nan")]) == 0.0 and one([None] * 3, [1.0]) == math.inf
    assert one([1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 3.0, 4.0]) == 0.0 and one([1.0, 2.0, 3.0, None], [3.0, 4.0, float("nan"), None]) > 0
    a = spark.createDataFrame([("a", 1.0)], "g string, x double")
    b = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "g string, x double")
    assert {r["g"]: r["psi"] for r in evaluate.psi(a, b, "x", "g").collect()} == {"a": 0.0, "b": None}


def test_ranked_sums_and_quantiles(spark):
    r = random.Random(1)
    rows = [(r.choice("ab"), r.random() if r.random() > 0.1 else None) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {x["g"]: x["quantiles"] for x in exact_quantiles(df, "g", "x", [0.0, 0.13, 0.5, 1.0]).collect()}
    want = {x["g"]: x["q"] for x in df.groupBy("g").agg(F.percentile("x", F.array(*map(F.lit, (0.0, 0.13, 0.5, 1.0)))).alias("q")).collect()}
    assert all(abs(a - b) < 1e-12 for g in want for a, b in zip(want[g], got[g]))
    ranks = group_rank(df.where("x is not null"), ["g"], F.desc("x")).collect()
    for g in "ab":
        mine = sorted((x for x in ranks if x["g"] == g), key=lambda x: x["rank"])
        assert [x["rank"] for x in mine] == list(range(1, mine[0]["_n"] + 1)) and all(a["x"] >= b["x"] for a, b in zip(mine, mine[1:]))
    n = spark.range(100).selectExpr("id", "id * 2 AS v")
    assert all(x["s"] == x["id"] * (x["id"] + 1) for x in running_sums(n, [F.asc("id")], {"s": "v"}).collect())


def test_regularised_slots_lose_nothing(spark):
    s = lambda x: datetime.datetime(2026, 1, 1, 0, x // 60, x % 60)
    rows = [("a", s(0), None), ("a", s(1), 2.0), ("a", s(302), -0.5), ("a", s(600), 1.0), ("a", s(601), 3.0), ("a", s(740), 1.0)]
    good, rejected = contracts.regularise(spark.createDataFrame(rows, "k string, ts timestamp, v double"), "k", "ts", "v", 300, 30)
    assert [(r["value"], r["readings"], r["clipped"], r["adjusted"]) for r in good.orderBy("slot").collect()] == [(2.0, 2, 2.0, True), (-0.5, 1, 0.0, True)]
    assert sorted(r["reason"] for r in rejected.collect()) == ["clock_skew", "slot_conflict", "slot_conflict"]
    start = good.agg(F.min("slot")).first()[0]
    a = contracts.grid_audit(contracts.on_grid(good, "k", start, start + 1200, 300), "k").first()
    assert (a["normalized_rows"], a["missing_slots"], a["rounded"], a["collisions"], a["value_over_null"], a["missing_values"], a["clipped_negatives"]) == (4, 2, 2, 1, 1, 2, 1)


def test_readings_of_all_shapes(spark, tmp_path):
    one = {"asset_code": "p", "ts": "2026-01-01T00:00:00Z", "reading": {"a": 1.5, "b": None}}
    shapes = {"array": json.dumps([one, one]), "object": json.dumps({"readings": [one]}), "lines": json.dumps(one) + "\n" + json.dumps(one) + "\n\n"}
    for name, text in shapes.items():
        (tmp_path / f"{name}.json").write_text(text)
        got = readers.readings_json(spark, f"{tmp_path}/{name}.json").collect()
        assert len(got) == (1 if name == "object" else 2) and got[0]["reading"] == {"a": 1.5, "b": None}
    (tmp_path / "odd.json").write_text('{"something": 1}')
    with pytest.raises(Exception, match="no readings in"):
        readers.readings_json(spark, f"{tmp_path}/odd.json").collect()
    assert features.measurement_columns(readers.readings_json(spark, f"{tmp_path}/array.json"), "reading").columns[-2:] == ["measurement__a", "measurement__b"]


def test_sensor_and_station_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Time,A_x,A_y\n0.0,1,nan\n0.1,,2e3\nbad,1,oops\n")
    rows = readers.sensor_csv(spark, f"{tmp_path}/x.csv", ["A_x", "A_y"]).orderBy("line").collect()
    assert [(r["t"], r["A_x"], r["A_y"], r["reasons"]) for r in rows] == [(0.0, 1.0, None, []), (0.1, None, 2000.0, []), (None, 1.0, None, ["time_nonfinite_or_nonnumeric", "value_nonnumeric"])]
    with gzip.open(tmp_path / "s.csv.gz", "wt") as f:
        f.write("NUM_POSTE;AAAAMMJJHH;GLO;T\n75;2024010100;12.5;1\n75;2023123123;1;1\n76;2024010100;2;1\n75;2024010101;;1\n")
    got = readers.station_year(spark, f"{tmp_path}/s.csv.gz", "75", 2024, ["GLO"]).orderBy("hour").collect()
    assert [(r["hour"].hour, r["GLO"]) for r in got] == [(0, 12.5), (1, None)]
    (tmp_path / "h.json").write_text(json.dumps({"outputs": {"hourly": [{"time": "20200101:0010", "P": 1.5}, {"time": "20200101:0110", "P": None}]}}))
    assert [(r["time"], r["P"]) for r in readers.hourly_json(spark, f"{tmp_path}/h.json", ["P"]).collect()] == [("20200101:0010", 1.5), ("20200101:0110", None)]
    (tmp_path / "l.csv").write_text("id,when,y,f_b,f_a\n1,2026-01-01,1,2.5,x\n2,2026-01-02,0,,3\n")
    t = readers.labelled_csv(spark, f"{tmp_path}/l.csv", "id", "when", "y", "f_", 2)
    assert t.columns == ["id", "when", "y", "f_a", "f_b", "bad_cells"] and [r["bad_cells"] for r in t.orderBy("id").collect()] == [["f_a"], []]
    with pytest.raises(ValueError):
        readers.labelled_csv(spark, f"{tmp_path}/l.csv", "id", "when", "y", "f_", 3)


def test_publishing_is_all_or_nothing(spark, tmp_path):
    good = spark.range(3)
    fails = spark.range(3).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        sinks.publish({"a": good, "b": fails}, f"file://{tmp_path}/out")
    assert not list(tmp_path.iterdir())
    (tmp_path / "out").mkdir()
    sinks.publish({"a": good}, f"file://{tmp_path}/out", "csv")
    assert spark.read.csv(f"{tmp_path}/out/a", header=True).count() == 3
    with pytest.raises(ValueError, match="absent or empty"):
        sinks.publish({"a": good}, f"file://{tmp_path}/out")


def labelled(spark, n=240):
    r = random.Random(2)
    rows = [(i, datetime.datetime(2026, 1, 1) + datetime.timedelta(hours=i // 2), int(r.random() < 0.3)) for i in range(n)]
    return spark.createDataFrame([(i, t, y, y + r.gauss(0, 0.5), r.gauss(0, 1)) for i, t, y in rows], "id long, ts timestamp, label int, f0 double, f1 double").cache()


def test_walk_forward_selects_fits_and_skips(spark):
    df = labelled(spark)
    table, scored = models.walk_forward_scores(df, "ts", ["f0", "f1"], ["l1_C0.1", "l1_C1"], folds=2, inner=2)
    rows = table.orderBy("fold").collect()
    assert [r["status"] for r in rows] == ["EVALUATED"] * 2 and all(r["average_precision"] > 0.5 and r["candidate"] for r in rows) and scored.count() == sum(r["test_rows"] for r in rows)
    one_class, none = models.walk_forward_scores(df.withColumn("label", F.lit(0)), "ts", ["f0", "f1"], ["l1_C1"], folds=2)
    assert {r["skip_reason"] for r in one_class.collect()} == {"TRAIN_SINGLE_CLASS"} and none.count() == 0
    parts = df.select("*", F.lit(1).alias("fold"), F.when(F.col("id") < 200, "train").otherwise("test").alias("role"))
    assert splits.skip_reasons(parts, least=1000).first()["skip_reason"] == "TRAIN_CLASS_SUPPORT_BELOW_CV_SPLITS"
    assert splits.skip_reasons(parts.where("role = 'train' or label = 0")).first()["skip_reason"] == "VALIDATION_NO_FAIL"


def test_models_in_use(spark, tmp_path):
    df = labelled(spark)
    fit, later = df.where("id < 160"), df.where("id >= 160")
    whole = models.balanced(fit)
    forest = models.candidates(whole.count(), ["f0", "f1"])["forest_d8_l4"].fit(whole)
    assert [f for f, _, _ in models.importance(forest, ["f0", "f1"])][0] == "f0" and evaluate.roc_auc(models.score(forest, later)).first()[0] > 0.7
    cal = models.calibrated_scores(forest, fit, later)
    assert evaluate.roc_auc(cal.select("id", "label", F.col("calibrated").alias("score"))).first()[0] > 0.7
    path, target = f"file://{tmp_path}/model", f"file://{tmp_path}/scores"
    sinks.save_model(forest, path, ["f0", "f1"], fit, "id", "label", "forest_d8_l4")
    _, manifest = sinks.load_model(spark, path)
    models.verify_selection(manifest, fit, ["f0", "f1"], ["forest_d8_l4"])
    with pytest.raises(ValueError, match="rows_digest"):
        models.verify_selection(manifest, fit.withColumn("label", F.when(F.col("id") == 0, 1 - F.col("label")).otherwise(F.col("label"))), ["f0", "f1"], ["forest_d8_l4"])
    approved = {"features_sha256": manifest["features_sha256"], "n_rows": later.count()} | later.agg(sinks.rows_digest("id", "label").alias("rows_digest")).first().asDict()
    out = models.locked_scores(path, later, approved, target, [0.1, 0.5], replicates=200)
    assert out["predictions"].count() == later.count() and out["budgets"].count() == 2 and out["metrics"].first()["roc_auc"] > 0.7
    assert [(r["fraction"], r["replicates"]) for r in out["bootstrap"].orderBy("fraction").collect()] == [(0.1, 200), (0.5, 200)] and out["bootstrap"].where("low <= mean and mean <= high and precision_low <= precision_high").count() == 2
    signed = models.approval(manifest, later, "reviewer", "2025-01-01")
    again = models.locked_scores(path, later, signed, f"{target}1", [0.1, 0.5], replicates=200)
    assert again["bootstrap"].orderBy("fraction").collect() == out["bootstrap"].orderBy("fraction").collect()
    assert again["metrics"].first()["approval_digest"] == signed.first()["digest"] and out["metrics"].first()["approval_digest"] is None
    for changed in (signed.withColumn("n_rows", F.lit(3).cast("long")), signed.withColumn("approved_by", F.lit("another")), signed.union(signed), signed.limit(0)):
        with pytest.raises(ValueError, match="approval"):
            models.locked_scores(path, later, changed, f"{target}2", [0.1])
    with pytest.raises(ValueError, match="rows_digest"):
        models.locked_scores(path, later, models.approval(manifest, fit, "reviewer", "2025-01-01"), f"{target}2", [0.1])
    with pytest.raises(ValueError, match="absent or empty"):
        models.locked_scores(path, later, approved, target, [0.1])
    with pytest.raises(ValueError, match="n_rows"):
        models.locked_scores(path, later, approved | {"n_rows": 3}, f"{target}2", [0.1])


def test_a_refit_needs_the_frozen_split(spark, tmp_path):
    fit = labelled(spark).where("id < 160")
    frozen, path, known = fit.select("id", "label", "ts"), f"file://{tmp_path}/model", ["l1_C0.1", "l1_C1"]
    whole = models.balanced(fit)
    saved = models.candidates(whole.count(), ["f0", "f1"])["l1_C1"].fit(whole)
    sinks.save_model(saved, path, ["f0", "f1"], fit, "id", "label", "l1_C1")
    loaded, manifest = sinks.load_model(spark, path)
    again = models.refit_selected(manifest, frozen, fit, ["f0", "f1"], known)
    assert again.stages[-1].coefficients.toArray() == pytest.approx(loaded.stages[-1].coefficients.toArray(), rel=1e-9) and again.stages[-1].intercept == pytest.approx(loaded.stages[-1].intercept, rel=1e-9)
    later = F.col("ts") + F.expr("interval 1 hour")
    for changed, why in (
        (frozen.where("id <> 3"), "unexpected"), (frozen.unionByName(frozen.where("id = 3").withColumn("id", F.lit(999).cast("long"))), "missing"),
        (frozen.withColumn("label", F.when(F.col("id") == 3, 1 - F.col("label")).otherwise(F.col("label"))), "label_changed"), (frozen.withColumn("ts", F.when(F.col("id") == 3, later).otherwise(F.col("ts"))), "time_changed"),
    ):
        with pytest.raises(ValueError, match=why):
            models.refit_selected(manifest, changed, fit, ["f0", "f1"], known)
    for rows in (fit.where("id <> 3"), fit.unionByName(fit.where("id = 3")), fit.withColumn("label", F.when(F.col("id") == 3, 1 - F.col("label")).otherwise(F.col("label")))):
        with pytest.raises(ValueError):
            models.refit_selected(manifest, frozen, rows, ["f0", "f1"], known)
    with pytest.raises(ValueError, match="candidate"):
        models.refit_selected(manifest, frozen, fit, ["f0", "f1"], ["l1_C0.1"])


def test_saved_tables_and_budgets(spark):
    a = spark.createDataFrame([("a", 1, 0.9, 1), ("b", 2, 0.6, 1), ("c", 3, 0.1, 0)], "id string, rank long, score double, prediction int")
    b = spark.createDataFrame([("a", 2, 0.7, 1), ("b", 1, 0.8, 1), ("d", 3, 0.1, 0)], "id string, rank long, score double, prediction int")
    got = {r["id"]: [c["field"] for c in r["changes"]] for r in compare.priority_changes(a, b, 1).collect()}
    every = ["score", "rank", "prediction", "selected"]
    assert got == {"a": ["score", "rank", "selected"], "b": ["score", "rank", "selected"], "c": every, "d": every}
    assert compare.rank_permutation(a).first()["is_permutation"] and not compare.rank_permutation(a.where("rank <> 1")).first()["is_permutation"]
    ids = spark.range(10)
    gate = lambda k, **o: compare.budget_gate(ids, ids.where("id < 8"), ids.where("id >= 8"), "id", k, **o).first()["reason"]
    assert gate(1) is None and gate(2) == "declared_k_differs" and gate(9, count=9) == "budget_exceeds_eligible" and gate(2, numerator=11, denominator=100, basis="original") is None
    assert compare.budget_gate(ids, ids, ids.where("id = 1"), "id", 1).first()["reason"] == "eligible_and_held_overlap"
    s = spark.createDataFrame([("a", "p", 3.0), ("a", "q", 1.0), ("a", "q", 3.0)], "f string, l string, v double").withColumn("i", F.monotonically_increasing_id())
    assert profile.without_maximum(s.where("l = 'q'"), "f", "l", "v", "i").first()["mean_without_max"] == 1.0


@pytest.mark.parametrize("zone", ["Asia/Tokyo", "America/New_York"])
def test_times_without_a_zone_are_not_read_in_that_of_the_process(spark, monkeypatch, tmp_path, zone):
    day = lambda n: datetime.datetime(1997, 12, 31) + datetime.timedelta(days=n)
    lines = [(k, day(n)) for k, n in ((1, 0), (2, 1), (3, 2), (4, 1), (5, 3))]
    spark.createDataFrame(lines, "l_orderkey long, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, 1) for k in (1, 2, 3, 4, 6)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setenv("TZ", zone)
    time.tzset()
    try:
        found = registry.QUERIES["rev_receipts"](spark, str(tmp_path)).collect()
        parts = splits.time_holdout(spark.createDataFrame(lines, "k long, ts timestamp_ntz"), "ts", 1).where("split = 'train'").collect()
    finally:
        monkeypatch.delenv("TZ")
        time.tzset()
    assert [tuple(r) for r in found] == [(1, 5, 3, 1, 1, 3, "BLOCKED")]
    assert [r["k"] for r in parts] == [1]


def test_a_plain_cutoff_beside_receipts_without_a_zone(spark, monkeypatch):
    cutoff = datetime.datetime(1998, 1, 1)
    roster = spark.createDataFrame([(1, 1)], "k long, g long")
    receipts = spark.createDataFrame([(1, cutoff)], "k long, received_at timestamp_ntz")
    monkeypatch.setenv("TZ", "Asia/Tokyo")
    time.tzset()
    try:
        assert review.receipt_audit(roster, receipts, cutoff, "k", "g").first()["verdict"] == "MATCH"
    finally:
        monkeypatch.delenv("TZ")
        time.tzset()


def test_frequent_values_and_large_groups_are_dealt_out(spark, monkeypatch):
    from gaugeworks.functions import ranking

    largest = []

    def noted(df):
        out = plain(df)
        largest.append(max([r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()], default=0))
        return out

    plain = ranking.saved
    monkeypatch.setattr(ranking, "saved", noted)
    monkeypatch.setattr(evaluate, "saved", noted)
    monkeypatch.setattr(ranking, "RANKS", 100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges aren't put together
    ties = spark.range(20_000).select(F.lit("a").alias("g"), F.when(F.col("id") < 3, F.col("id")).otherwise(7).cast("double").alias("x"))
    (got,) = exact_quantiles(ties, "g", "x", [0.0, 0.5, 1.0]).collect()
    assert list(got["quantiles"]) == [0.0, 7.0, 7.0] and max(largest) < 100  # one value of nearly all rows
    largest.clear()
    apart = spark.range(20_000).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("x"))
    (got,) = evaluate.psi(apart, apart.withColumn("x", F.col("x") + 10_000), "x", "g").collect()
    # Of ten bins the first five lose their rows, and the last one has six times its share.
    low, same = 5 * (1e-6 - 0.1) * math.log(1e-6 / 0.1), (0.6 - 0.1) * math.log(0.6 / 0.1)
    assert got["psi"] == pytest.approx(low + same, abs=1e-3) and len(largest) == 2 and max(largest) < 15_000  # one group of all rows
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_receipts_are_compared_by_tasks_that_go_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(review, "TASK_ROWS", 100, raising=False)
    listed = [("a", 1), ("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 1), ("d", 1), ("e", None), (None, 1)]
    got = [("a", 1), ("a", 2), ("b", 1), ("c", 1), ("c", 9), ("d", 1), ("d", 1), ("e", None), (None, 1), ("f", 1)]
    many = spark.range(1_000).select(F.lit("m").alias("r"), F.col("id").cast("int").alias("k"))
    table = lambda rows: many.unionByName(spark.createDataFrame(rows, "r string, k int"))
    found = review.receipt_sets(table(listed), table(got), "r", "k")
    odd, no = "SUBSTITUTED", "MISSING"
    assert {r["r"]: r["state"] for r in found.collect()} == {"a": "MATCH", "b": no, "c": odd, "d": odd, "e": odd, None: odd, "f": odd, "m": "MATCH"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and ", 21)" in plan  # 2,019 rows by 100
