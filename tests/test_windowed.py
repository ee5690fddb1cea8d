"""Windowed control against a plain loop that makes every window, empty ones too."""

import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import windowed
from gaugeworks.operators.windowed import Config

C = Config(width=50, period=10, gap_factor=1.5, cadence=5.0, least=2, most=100.0, edge=1)


def loop(times, values, c):
    """Per complete window: n, reasons, value."""
    t0, complete = times[0], (times[-1] - times[0]) // c.width
    out = [[[], set(), None] for _ in range(complete)]
    for t, v in zip(times, values):
        k = (t - t0) // c.width
        if k < complete:
            out[k][0].append(v)
    for a, b in zip(times, times[1:]):
        if b - a > c.period * c.gap_factor:
            for k in range((a + c.period - t0) // c.width, min((b - t0) // c.width + 1, complete)):
                out[k][1].add("timestamp_gap")
    rows = []
    for vs, why, _ in out:
        why = [*why, *(["insufficient_samples"] if len(vs) < c.least else [])]
        if any(v is None or math.isnan(v) for v in vs):
            why.append("nonfinite_value")
        elif any(abs(v) > c.most for v in vs):
            why.append("value_out_of_range")
        rows.append((len(vs), why, math.sqrt(sum(v * v for v in vs) / len(vs)) if not why else None))
    return rows


def tables(spark, files, c=C):
    rows = [(f, i, t, v) for f, (ts, vs) in files.items() for i, (t, v) in enumerate(zip(ts, vs))]
    s = spark.createDataFrame(rows, "file string, pos int, t long, x double")
    states = windowed.file_states(s, "file", ["pos"], "t", c)
    placed = windowed.windows(s, states, "file", "t", ["x"], c)
    return states, placed, windowed.runs(placed, "file", c)


def test_windows_equal_a_plain_loop(spark):
    r = random.Random(5)
    files = {}
    for f in "abcdef":
        t, ts, vs = r.randrange(1000), [], []
        for _ in range(200):
            ts.append(t)
            vs.append(r.choice([1.0, 2.0, 3.0] * 20 + [float("nan"), 500.0]))
            t += r.choice([8, 10, 12] * 8 + [60, 130, 400])
        files[f] = (ts, vs)
    states, placed, runs = tables(spark, files)
    got = {}
    for x in runs.collect():
        for k in range(x["k"], x["k"] + x["count"]):
            assert (x["file"], k) not in got
            got[x["file"], k] = (x["n"], x["reasons"], x["value"])
    summary = {x["file"]: x for x in windowed.file_summary(states, placed, runs, "file", C).collect()}
    for f, (ts, vs) in files.items():
        want = loop(ts, vs, C)
        assert len(want) == summary[f]["complete"] == sum(1 for k in got if k[0] == f)
        for k, (n, why, value) in enumerate(want):
            assert got[f, k][:2] == (n, why) and (value is None) == (got[f, k][2] is None) and (value is None or abs(value - got[f, k][2]) < 1e-9)
        assert summary[f]["evaluable"] == sum(not w for _, w, _ in want) and summary[f]["timestamp_gap"] == sum("timestamp_gap" in w for _, w, _ in want)
        tail = [t for t in ts if (t - ts[0]) // C.width >= len(want)]
        assert summary[f]["tail_samples"] == len(tail) and summary[f]["tail_duration"] == ts[-1] - ts[0] - 50 * len(want)
        assert summary[f]["near_boundary"] == sum((t - ts[0]) % 50 in (1, 49) for t in ts) and summary[f]["n_gaps"] == sum(b - a > 15 for a, b in zip(ts, ts[1:]))


def test_samples_are_shuffled_once_for_windows_runs_and_figures(spark):
    s = spark.createDataFrame([("a", i, 10 * i, 1.0) for i in range(20)], "file string, pos int, t long, x double")
    states = windowed.saved(windowed.file_states(s, "file", ["pos"], "t", C))
    plan = windowed.runs(windowed.windows(s, states, "file", "t", ["x"], C), "file", C)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Union" not in plan


def test_spans_of_too_many_windows_are_refused(spark):
    far = [("a", 0, 0), ("a", 1, 10), ("a", 2, 500), ("b", 0, -(2**63)), ("b", 1, 2**63 - 1), ("c", 0, 0), ("c", 1, 10), ("c", 2, 499)]
    s = spark.createDataFrame([(f, i, t, 1.0) for f, i, t in far], "file string, pos int, t long, x double")
    wide = replace(C, cadence=1e30)
    states = windowed.file_states(s, "file", ["pos"], "t", wide, most_windows=9)
    assert {r["file"]: (r["complete"], r["reasons"]) for r in states.collect()} == {f: (None, ["time_span_exceeds_window_index_limit"]) for f in "ab"} | {"c": (9, [])}
    placed = windowed.windows(s, states, "file", "t", ["x"], wide)
    assert {r["file"] for r in placed.select("file").collect()} == {"c"}
    summary = windowed.file_summary(states, placed, windowed.runs(placed, "file", wide), "file", wide)
    assert {r["file"]: (r["file_status"], r["n_gaps"], r["tail_samples"]) for r in summary.collect()} == {"a": ("invalid", None, None), "b": ("invalid", None, None), "c": ("valid", 1, 1)}


def test_the_mask_holds_empty_windows(spark):
    ts = [t for t in range(0, 351, 10) if not 100 <= t < 250]
    _, _, runs = tables(spark, {"a": (ts, [1.0] * len(ts))}, replace(C, gap_factor=100.0))
    row = windowed.mask(runs, "file").first()
    assert row["mask"] == "1x2,0x3,1x2" and runs.where("n = 0").count() == 1


def test_invalid_files_and_axes(spark):
    files = {"short": ([0], [1.0]), "back": ([0, 10, 5], [1.0] * 3), "null": ([0, None, 20], [1.0] * 3), "slow": ([0, 500, 1000], [1.0] * 3), "good": ([0, 10, 20, 60], [3.0] * 4)}
    states, _, runs = tables(spark, files)
    assert {r["file"]: list(r["reasons"]) for r in states.collect()} == {"short": ["shape_invalid"], "back": ["time_not_strictly_increasing"], "null": ["time_nonfinite_or_nonnumeric"], "slow": ["cadence_mismatch"], "good": []}
    assert {r["file"] for r in runs.collect()} == {"good"}
    rows = spark.createDataFrame([("a", t, 3.0, 4.0) for t in range(0, 101, 10)], "file string, t long, x double, y double")
    st = windowed.file_states(rows, "file", ["t"], "t", C)
    assert [r["value"] for r in windowed.runs(windowed.windows(rows, st, "file", "t", ["x", "y"], C), "file", C).orderBy("k").collect()] == [5.0, 5.0]
    assert [r["value"] for r in windowed.runs(windowed.windows(rows, st, "file", "t", ["x", "y"], C, mode="y"), "file", C).orderBy("k").collect()] == [4.0, 4.0]


def walk(values, method, threshold, c):
    e = up = down = 0.0
    before, out = False, [0, 0, 0]
    for v in values:
        if v is None:
            e = up = down = 0.0
            before = False
            continue
        e, up, down = c.lam * v + (1 - c.lam) * e, max(0, up + v - c.slack), max(0, down - v - c.slack)
        stat = {"shewhart": abs(v), "ewma": abs(e) / math.sqrt(c.lam / (2 - c.lam)), "cusum": max(up, down)}[method]
        out[0] += 1
        alarm = stat > threshold
        out[1] += alarm
        out[2] += alarm and not before
        before = alarm
        if alarm and c.reset_after_alarm:
            e = up = down = 0.0
    return out


@pytest.mark.parametrize("reset", [False, True])
def test_detectors_equal_a_plain_loop(spark, reset):
    r, c = random.Random(9), replace(C, reset_after_alarm=reset)
    files = {f: [None if r.random() < 0.08 else r.gauss(0, 1.5) for _ in range(300)] for f in "ab"}
    runs = spark.createDataFrame([(f, k, 1, 1, [] if v is not None else ["timestamp_gap"], v) for f, vs in files.items() for k, v in enumerate(vs)], "file string, k long, count long, n long, reasons array<string>, value double")
    for method, threshold in (("shewhart", 2.0), ("ewma", 1.5), ("cusum", 3.0)):
        got = windowed.alarm_counts(windowed.detect(runs, "file", 0.0, 1.0, method, threshold, c), runs, "file", c).collect()
        for x in got:
            n, alarms, episodes = walk(files[x["file"]], method, threshold, c)
            assert (x["evaluable"], x["alarms"], x["episodes"], x["resets_after_alarm"]) == (n, alarms, episodes, alarms if reset else 0)
            assert x["resets_not_evaluable"] == sum(v is None for v in files[x["file"]])


@pytest.mark.parametrize("chunk", [1000, 7])
def test_a_fold_hands_its_state_from_chunk_to_chunk(spark, monkeypatch, chunk):
    monkeypatch.setattr(windowed, "PART", 5)
    r, c = random.Random(4), replace(C, reset_after_alarm=True, grids={"shewhart": (1.0, 2.0), "ewma": (1.0,), "cusum": (1.0, 3.0)})
    files = {f: [None if r.random() < 0.1 else float("nan") if r.random() < 0.05 else r.gauss(0, 1.5) for _ in range(n)] for f, n in (("a", 40), ("b", 3), ("c", 21))}
    runs = spark.createDataFrame([(f, 2 * k, v) for f, vs in files.items() for k, v in enumerate(vs)], "file string, k long, value double")
    plain = {f: [None if v is None or math.isnan(v) else v for v in vs] for f, vs in files.items()}
    grid = [(m, t) for m in windowed.METHODS for t in c.grids[m]]
    at = {x["file"]: x["at"] for x in windowed._fold(runs, "file", 0.0, 1.0, grid, c, chunk=chunk).collect()}
    for f, vs in plain.items():
        assert [(s["alarms"], s["episodes"]) for s in at[f]] == [tuple(walk(vs, m, t, c)[1:]) for m, t in grid]
        for m, t in grid:
            rows = windowed._fold(runs, "file", 0.0, 1.0, [(m, t)], c, rows=True, chunk=chunk).where(F.col("file") == f).orderBy("k").collect() if f == "a" else []
            assert not rows or ([x["k"] for x in rows] == [2 * k for k, v in enumerate(vs) if v is not None] and sum(x["alarm"] for x in rows) == walk(vs, m, t, c)[1])
            assert not rows or [x["segment"] for x in rows] == [sum(v is None for v in vs[:k]) for k, v in enumerate(vs) if v is not None]
    tried = {(x["method"], x["threshold"]): (x["alarms"], x["evaluable"]) for x in windowed.calibrate(runs, "file", 0.0, 1.0, c).collect()}
    assert tried == {(m, t): (sum(walk(vs, m, t, c)[1] for vs in plain.values()), sum(v is not None for vs in plain.values() for v in vs)) for m, t in grid}
    assert windowed._fold(runs.limit(0), "file", 0.0, 1.0, grid, c).count() == 0


def test_reference_lag_is_pooled_over_files(spark):
    values = {"a": [1.0, 2.0, 4.0], "b": [3.0, 1.0]}
    runs = spark.createDataFrame([(f, k, 1, 1, [], v) for f, vs in values.items() for k, v in enumerate(vs)], "file string, k long, count long, n long, reasons array<string>, value double")
    got = windowed.reference_fit(runs, "file", C).first()
    d = [v - 2.2 for v in (1, 2, 4, 3, 1)]
    assert abs(got["lag1"] - sum(a * b for a, b in zip(d, d[1:])) / sum(x * x for x in d)) < 1e-12 and got["state"] == "fitted"
    assert windowed.reference_fit(runs.limit(0), "file", C).first()["state"] == "reference_windows_insufficient"
    assert windowed.reference_fit(runs.withColumn("value", F.lit(2.0)), "file", C).first()["state"] == "reference_scale_invalid"


def test_stability_and_roll_up(spark):
    rows = [("r", c, "supported", "study", "lab", None) for c in windowed.STABILITY]
    e = spark.createDataFrame([*rows, ("s", "trend", "supported", "", "lab", None), ("s", "distribution", None, None, None, 0.4)], "run string, category string, status string, basis string, assessed_by string, p_value double")
    got = {x["run"]: x for x in windowed.assess_stability(e, "run").collect()}
    assert got["r"]["status"] == "stability_supported_by_annotation"
    assert got["s"]["reasons"] == ["missing:operating_context", "incomplete:trend", "p_value_only_not_accepted:distribution", "missing:autocorrelation", "missing:motion_cycle"]
    summary = spark.createDataFrame([("a", "valid", 5), ("b", "valid", 2)], "file string, file_status string, complete long")
    counts = spark.createDataFrame([("a", 4, 1, 2), ("b", 2, 1, 1)], "file string, evaluable long, alarms long, episodes long")
    row = windowed.roll_up(summary, counts, "file").first()
    assert (row["series"], row["complete"], row["alarms"], row["contradictions"]) == (2, 7, 2, 1)
