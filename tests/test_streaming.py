import datetime
import json
import math
import random
import time

from gaugeworks.streaming import readings

T0 = datetime.datetime(2025, 1, 1)


def at(s):
    return T0 + datetime.timedelta(seconds=s)


SCHEMA = "asset string, ts timestamp, value double, observed_at timestamp, seq long"
ROWS = [
    ("a", at(100), 1.0, at(0), 1), ("a", at(100), 1.0, at(101), 2), ("a", at(100), 1.0, at(102), 3), ("a", at(110), float("nan"), at(111), 4), ("a", None, 1.0, at(111), 5),
    (None, at(0), 1.0, at(1), 6), ("a", at(0), 1.0, at(900), 7), ("a", at(120), None, at(121), 8), ("b", at(100), 1.0, at(101), 9), ("a", at(100), 1.0, at(100 + 90_000), 10),
]
REASONS = {1: "future", 2: None, 3: "duplicate", 4: "contract", 5: "contract", 6: "contract", 7: "late", 8: None, 9: None, 10: "late"}


def test_dead_rows_count_for_nothing_and_broken_rows_are_kept(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert {r["seq"]: r["reason"] for r in readings.batch(df).collect()} == REASONS
    assert tuple(readings.batch_counts(readings.batch(df)).first()) == (10, 3, 7)
    df.write.parquet(str(tmp_path / "in"))
    stream = readings.stateful(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    readings.write_batches(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    found = {r["seq"]: r["reason"] for name in ("accepted", "dead") for r in spark.read.parquet(str(tmp_path / "out" / name)).collect()}
    assert found == REASONS


def test_a_silent_asset_is_told_once(spark, tmp_path):
    df = spark.createDataFrame([("a", at(0), 1.0, at(1), 1)], SCHEMA)
    df.write.parquet(str(tmp_path / "in"))
    stream = readings.stateful(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), readings.Limits(silent=0.5), timer=True)
    running = stream.writeStream.format("memory").queryName("silent").outputMode("append").trigger(processingTime="1 second").start()
    try:
        running.awaitTermination(12)
    finally:
        running.stop()
    assert sorted((r["seq"] or 0, r["reason"]) for r in spark.table("silent").collect()) == [(0, "disconnect"), (1, None)]


def test_a_restart_goes_on_where_it_ended(spark, tmp_path):
    row = lambda s, seq, seen=None: ("a", at(s), 1.0, at(seen if seen is not None else s), seq)
    run = lambda: readings.write_batches(readings.stateful(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/check")
    seen = []
    for rows in ([row(0, 1), row(10, 2)], [row(10, 3), row(20, 4)], [row(30, 5, 250)], [row(60, 6, 251)], [row(251, 7)]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = run()
        query.awaitTermination()
        seen += readings.throughput(query)
    table = lambda n: spark.read.parquet(f"{tmp_path}/out/{n}")
    assert sorted(r["seq"] for r in table("accepted").collect()) == [1, 2, 4, 5, 6, 7]
    assert [(r["seq"], r["reason"]) for r in table("dead").collect()] == [(3, "duplicate")]
    assert sorted((r["ts"] - table("accepted").where("seq = 1").first()["ts"]) // 10**6 for r in table("alerts").collect()) == [30, 60]  # told again after an accepted reading
    assert sorted((r["batch_id"], r["input_count"], r["accepted_count"], r["dead_letter_count"]) for r in table("counts").collect()) == [(0, 2, 2, 0), (1, 2, 1, 1), (2, 1, 1, 0), (3, 1, 1, 0), (4, 1, 1, 0)]
    assert [n for _, n, _ in seen] == [2, 2, 1, 1, 1]


def state_of(query):
    return [p["stateOperators"][0] for p in query.recentProgress if p["numInputRows"]]


def test_restarted_batches_equal_the_batch_twin_and_touch_their_own_entries_alone(spark, tmp_path):
    r = random.Random(5)
    rows, seq = [], 0
    for part in range(3):  # 300 assets in the first, few in the others; repeated, late, early and broken rows in all
        for _ in range(2000 if part == 0 else 40):
            seq += 1
            ts = part * 400 + r.randint(0, 390)
            rows.append((part, f"a{r.randint(0, 299 if part == 0 else 3)}", at(ts), r.choice([1.0, 2.0, None, float("inf")]), at(ts + r.choice([0, 1, 2, -10, 299, 400])), seq))
    run = lambda: readings.write_batches(readings.stateful(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/check")
    states = []
    for part in range(3):
        spark.createDataFrame([x[1:] for x in rows if x[0] == part], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = run()
        assert query.awaitTermination(120)
        states += state_of(query)
    want = {x["seq"]: x["reason"] for x in readings.batch(spark.createDataFrame([x[1:] for x in rows], SCHEMA)).collect()}
    found = [x for name in ("accepted", "dead") for x in spark.read.parquet(f"{tmp_path}/out/{name}").collect()]
    assert {x["seq"]: x["reason"] for x in found} == want and len(found) == len(want)
    assert set(want.values()) == {None, "duplicate", "future", "late", "contract"}
    first, *others = states
    assert first["numRowsTotal"] > 900 and first["numRowsUpdated"] > 900
    assert all(s["numRowsTotal"] > 900 and s["numRowsUpdated"] < 200 for s in others)  # what no row of the batch touches isn't written again
    dead = [x for x in found if x["reason"] is not None]
    assert all(json.loads(x["raw"])["seq"] == x["seq"] for x in dead) and all(x["raw"] is None for x in found if x["reason"] is None)
    counts = spark.read.parquet(f"{tmp_path}/out/counts").orderBy("batch_id").collect()
    assert [x["input_count"] for x in counts] == [2000, 40, 40] and sum(x["dead_letter_count"] for x in counts) == len(dead)


def test_entries_go_after_their_time_to_live(spark, tmp_path):
    stream = lambda: readings.stateful(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), ttl=1)
    for seq, s in ((1, 0), (2, 0), (3, 1)):
        spark.createDataFrame([("a", at(s), 1.0, at(s), seq)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = readings.write_batches(stream(), f"{tmp_path}/out", f"{tmp_path}/check")
        assert query.awaitTermination(60)
        time.sleep(2)
    assert sorted(x["seq"] for x in spark.read.parquet(f"{tmp_path}/out/accepted").collect()) == [1, 2, 3]


def test_a_continuous_trigger_tells_silent_assets_by_their_timer(spark, tmp_path):
    spark.createDataFrame([("a", at(0), 1.0, at(1), 1), ("b", at(0), 1.0, at(0), 2)], SCHEMA).write.parquet(f"{tmp_path}/in")
    stream = readings.stateful(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), readings.Limits(silent=1), timer=True)
    running = readings.write_batches(stream, f"{tmp_path}/out", f"{tmp_path}/check", processingTime="1 second")
    try:
        running.awaitTermination(15)
        assert running.isActive
    finally:
        running.stop()
    table = spark.read.parquet(f"{tmp_path}/out/alerts")
    assert sorted(x["asset"] for x in table.collect()) == ["a", "b"]  # once each


def test_the_cheap_mode_has_the_accepted_rows(spark, tmp_path):
    rows = [(f"a{i % 7}", at(s), 1.0, at(s + lag), 10 * i + k) for i in range(200) for s in [i * 20] for k, lag in enumerate((0, 5, 100, 299, 301, -6)[: 1 + i % 6])]
    rows += [("a0", None, 1.0, at(0), 9001), (None, at(0), 1.0, at(0), 9002), ("a0", at(1), float("nan"), at(1), 9003)]
    rows.sort(key=lambda x: x[3])
    n = len(rows)
    for part in range(4):
        spark.createDataFrame(rows[part * n // 4 : (part + 1) * n // 4], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = readings.accepted_only(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"))
        query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        assert query.awaitTermination(60)
    kept = query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]
    want = {(x["asset"], x["ts"]) for x in readings.batch(spark.createDataFrame(rows, SCHEMA)).where("reason is null").collect()}
    found = [(x["asset"], x["ts"]) for x in spark.read.schema(SCHEMA).parquet(f"{tmp_path}/out").collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert kept < 60  # what can't be repeated any more is gone


def test_drift_alerts(spark):
    ref = spark.createDataFrame([("p", float(i)) for i in range(20)] + [("t", 5.0)] * 6 + [("u", 5.0)] * 6 + [("few", 1.0)], "m string, x double")
    cur = spark.createDataFrame([("p", float(i)) for i in range(20)] + [("t", 6.0)] * 6 + [("u", 5.0)] * 5 + [("u", None), ("few", 1.0), ("new", 1.0)], "m string, x double")
    got = {r["m"]: (r["psi"], r["alert"]) for r in readings.drift_alerts(ref, cur, "m", "x").collect()}
    assert got == {"p": (0.0, None), "t": (math.log(1_000_000), "distribution_drift"), "u": (0.0, None), "few": (None, "drift_evidence_insufficient")}
