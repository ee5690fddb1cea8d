"""Windowed control of many sampled files at once: windows, detectors, thresholds and the evaluation of files.

Times are integers (say nanoseconds). A file's windows are half-open, of one width, and begin at its first time. All its
windows are accounted for, but one without a sample is never made a row: `runs` holds a row for each populated window
(count 1) and one for each run of empty windows. Nothing is carried from file to file.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.ranking import saved

METHODS = ("shewhart", "ewma", "cusum")
#: Fixed value: windows of a file, at most.
MOST_WINDOWS = 2**53 - 1
#: Evidence that a claim of stable running needs.
STABILITY = ("operating_context", "trend", "distribution", "autocorrelation", "motion_cycle")


@dataclass(frozen=True)
class Config:
    """width, period (nominal, between samples) and edge (how close to a window's bound counts as near) are times."""

    width: int
    period: int
    gap_factor: float = 1.5
    cadence: float = 0.2
    least: int = 1
    most: float = 1e6
    edge: int = 0
    least_reference: int = 2
    floor: float = 1e-9
    lam: float = 0.2
    slack: float = 0.5
    budget: float = 0.05
    reset_after_alarm: bool = False
    grids: dict = field(default_factory=lambda: {"shewhart": (3.0, 4.0, 5.0), "ewma": (3.0, 4.0, 5.0), "cusum": (4.0, 6.0, 8.0)})

    @property
    def gap(self) -> float:
        return self.period * self.gap_factor


def _div(a: str, b: int) -> Column:
    return F.expr(f"({a}) div {b}")


def file_states(samples: DataFrame, key: str, order: list[str], t: str, c: Config, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """By file: n, t0, t1, complete (windows) and reasons (none: valid). order: the columns that give a file's own order of samples."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = samples.select(key, F.col(t).alias("t"), F.lag(t).over(w).alias("last"), F.row_number().over(w).alias("at"))
    out = rows.groupBy(key).agg(
        F.count("*").alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.count_if(F.col("t").isNull()).alias("bad"),
        F.count_if((F.col("at") > 1) & (F.col("t") <= F.col("last"))).alias("falls"), F.percentile(F.try_subtract("t", "last"), F.lit(0.5)).alias("step"),
    )
    off = F.abs(F.col("step") - c.period) / c.period > c.cadence
    complete = F.expr(f"try_subtract(t1, t0) div {c.width}")  # null: a span beyond a long
    reason = (
        F.when(F.col("n") < 2, "shape_invalid").when(F.col("bad") > 0, "time_nonfinite_or_nonnumeric")
        .when(F.col("falls") > 0, "time_not_strictly_increasing").when(off, "cadence_mismatch").when(F.coalesce(complete > most_windows, F.lit(True)), "time_span_exceeds_window_index_limit")
    )
    return out.select(key, "n", "t0", "t1", F.when(reason.isNull(), complete).alias("complete"), F.array_compact(F.array(reason)).alias("reasons"))


def windows(samples: DataFrame, states: DataFrame, key: str, t: str, axes: list[str], c: Config, mode: str = "vector") -> DataFrame:
    """A row for each window of valid files that has samples, those of the tail too: all that `runs` and `file_summary` need, so
    the samples are placed once. They are shuffled by file; sorting, placing and summing keep that partitioning.

    (key, complete, t0, k, n, touched: by a gap beside a sample, broken and over: a value is, rms: of an axis or of all in mode
    `vector`, n_gaps, near: samples close to a bound, last: the time of the last sample, then that of the next one in the file and
    whether a gap lies between)."""
    x = [F.col(a).cast("double") for a in axes]
    broken = F.greatest(*[(v.isNull() | F.isnan(v) | (F.abs(v) == math.inf)).cast("int") for v in x], F.lit(0)) == 1
    over = F.greatest(*[(F.abs(v) > c.most).cast("int") for v in x], F.lit(0)) == 1
    used = x if mode == "vector" else [F.col(mode).cast("double")]
    square = sum([v * v for v in used[1:]], used[0] * used[0])
    rows = samples.select(key, F.col(t).alias("t"), broken.alias("broken"), over.alias("over"), F.when(~over, square).alias("square"))
    rows = rows.join(states.where(F.size("reasons") == 0).select(key, "t0", "complete"), key).withColumn("k", _div("t - t0", c.width))
    w = Window.partitionBy(key).orderBy("t")
    gap = lambda later, sooner: F.coalesce(F.col(later) - F.col(sooner) > c.gap, F.lit(False))
    rows = rows.withColumns({"next": F.lead("t").over(w), "before": F.lag("t").over(w)}).withColumns({"gap_next": gap("next", "t"), "gap_before": gap("t", "before")})
    touched = (F.col("gap_next") & (_div(f"t + {c.period} - t0", c.width) == F.col("k"))) | F.col("gap_before")
    off = F.pmod(F.col("t") - F.col("t0"), F.lit(c.width))
    near = (off > 0) & ((off <= c.edge) | (c.width - off <= c.edge))
    return rows.groupBy(key, "complete", "t0", "k").agg(
        F.count("*").alias("n"), F.max(touched).alias("touched"), F.max("broken").alias("broken"), F.max("over").alias("over"), F.sqrt(F.avg("square")).alias("rms"), F.count_if("gap_next").alias("n_gaps"),
        F.count_if(near).alias("near"), F.max("t").alias("last"), F.max_by("next", "t").alias("next"), F.max_by("gap_next", "t").alias("gap_next"),
    )


def runs(placed: DataFrame, key: str, c: Config) -> DataFrame:
    """Rows (key, k, count, n, reasons, value) that cover every complete window of valid files once, made of `windows` row by row.
    value: root mean square, where no reason speaks against it."""
    why = F.array_compact(F.array(
        F.when(F.col("touched"), "timestamp_gap"), F.when(F.col("n") < c.least, "insufficient_samples"),
        F.when(F.col("broken"), "nonfinite_value").when(F.col("over"), "value_out_of_range")))
    row = lambda k, count, n, reasons, value: F.struct(k.alias("k"), count.cast("long").alias("count"), n.cast("long").alias("n"), reasons.alias("reasons"), value.cast("double").alias("value"))
    own = row(F.col("k"), (F.col("k") < F.col("complete")).cast("long"), F.col("n"), why, F.when(F.size(why) == 0, F.col("rms")))

    # Empty windows lie between a window and the file's next sample; a gap touches those from one period behind its first sample on.
    first, end = F.col("k") + 1, F.least(_div("next - t0", c.width), F.col("complete")) - 1
    low = F.when(F.col("gap_next"), F.greatest(_div(f"last + {c.period} - t0", c.width), first)).otherwise(end + 1)
    piece = lambda a, b, reasons: row(a, b - a + 1, F.lit(0), F.array(*[F.lit(y) for y in reasons]), F.lit(None))
    empty = piece(first, F.least(low - 1, end), ["insufficient_samples"]), piece(low, end, ["timestamp_gap", "insufficient_samples"])
    return placed.select(key, F.inline(F.array(own, *empty))).where("count > 0")


def file_summary(states: DataFrame, placed: DataFrame, run_table: DataFrame, key: str, c: Config) -> DataFrame:
    """By file of any state: durations, windows, exclusions by reason, gaps, tail and samples near a bound."""
    tail = F.when(F.col("k") >= F.col("complete"), F.col("n")).otherwise(0)
    seen = placed.groupBy(key).agg(F.sum("n_gaps").alias("n_gaps"), F.sum("near").alias("near_boundary"), F.sum(tail).alias("tail_samples"))
    names = ("timestamp_gap", "insufficient_samples", "nonfinite_value", "value_out_of_range")
    why = [F.sum(F.when(F.array_contains("reasons", r), F.col("count")).otherwise(0)).alias(r) for r in names]
    of_runs = run_table.groupBy(key).agg(F.count("value").alias("evaluable"), F.count_if(F.col("n") == 0).alias("empty_runs"), *why)
    out = states.join(seen, key, "left").join(of_runs, key, "left")
    valid = F.size("reasons") == 0
    zero = lambda name: F.when(valid, F.coalesce(name, F.lit(0))).alias(name)
    share = F.when(valid & (F.col("complete") > 0), (F.col("complete") - F.coalesce("evaluable", F.lit(0))) / F.col("complete"))
    return out.select(
        key, F.when(valid, "valid").otherwise("invalid").alias("file_status"), F.array_join("reasons", ",").alias("file_reasons"), "complete", zero("evaluable"),
        F.when(valid, F.col("t1") - F.col("t0")).alias("duration"), F.when(valid, F.coalesce("evaluable", F.lit(0)) * c.width).alias("evaluable_duration"), share.alias("excluded_share"),
        *map(zero, names), zero("empty_runs"), zero("n_gaps"), zero("near_boundary"), zero("tail_samples"), F.when(valid, F.col("t1") - F.col("t0") - F.col("complete") * c.width).alias("tail_duration"),
    )


def reference_fit(run_table: DataFrame, key: str, c: Config) -> DataFrame:
    """One row on the reference files' evaluable windows: n, center, scale, lag1 and a state. The files follow each other in the
    order of their keys for lag1, the sum of products of neighbouring deviations over the sum of squared ones."""
    v = run_table.where("value is not null").select(key, "k", "value")
    fit = v.agg(F.count("*").alias("n"), F.avg("value").alias("center"), F.stddev_samp("value").alias("scale"))
    w = Window.partitionBy(key).orderBy("k")
    dev = v.join(F.broadcast(fit), how="cross").withColumn("d", F.col("value") - F.col("center")).withColumn("product", F.col("d") * F.lag("d").over(w))
    files = dev.groupBy(key).agg(F.sum("product").alias("inner"), F.sum(F.col("d") * F.col("d")).alias("squares"), F.min_by("d", "k").alias("first"), F.max_by("d", "k").alias("last"))
    files = files.withColumn("across", F.col("first") * F.lag("last").over(Window.orderBy(key)))  # a row for each reference file
    lag1 = files.agg((F.coalesce(F.sum("inner"), F.lit(0.0)) + F.coalesce(F.sum("across"), F.lit(0.0))).alias("a"), F.sum("squares").alias("b"))
    state = (
        F.when(F.col("n") < c.least_reference, "reference_windows_insufficient").when(F.coalesce(~(F.col("scale") > 0), F.lit(True)), "reference_scale_invalid")
        .when(F.col("scale") < c.floor, "reference_scale_below_floor").otherwise("fitted")
    )
    return fit.join(lag1, how="cross").select("n", "center", "scale", F.when((F.col("n") > 2) & (F.col("b") > 0), F.col("a") / F.col("b")).alias("lag1"), state.alias("state"))


def statistics(run_table: DataFrame, key: str, center: Column | float, scale: Column | float, c: Config) -> DataFrame:
    """Rows (key, k, segment, shewhart, ewma, cusum) of evaluable windows, without reset after an alarm. Any other window starts anew.

    CUSUM is a running sum less its running minimum. EWMA sums a frame so long that what lies before it is below double precision.
    """
    w = Window.partitionBy(key).orderBy("k")
    z = run_table.withColumn("segment", F.sum(F.col("value").isNull().cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    z = z.where("value is not null").withColumn("z", (F.col("value") - center) / scale)
    s = Window.partitionBy(key, "segment").orderBy("k")
    run = s.rowsBetween(Window.unboundedPreceding, 0)
    reach = 0 if c.lam >= 1 else math.ceil(math.log(1e-18) / math.log(1 - c.lam))
    fold = F.aggregate(F.collect_list("z").over(s.rowsBetween(-reach, 0)), F.lit(0.0), lambda e, x: c.lam * x + (1 - c.lam) * e)
    z = z.withColumn("ewma", F.abs(fold) / math.sqrt(c.lam / (2 - c.lam))).withColumn("up", F.sum(F.col("z") - c.slack).over(run)).withColumn("down", F.sum(-F.col("z") - c.slack).over(run))
    up, down = (F.col(x) - F.least(F.lit(0.0), F.min(x).over(run)) for x in ("up", "down"))
    return z.select(key, "k", "segment", F.abs("z").alias("shewhart"), "ewma", F.greatest(up, down).alias("cusum"))


#: Windows of a file that are folded as one row, and of its parts, whose results are joined.
CHUNK, PART = 16_384, 256


def _fold(run_table: DataFrame, key: str, center: Column | float, scale: Column | float, grid: list[tuple[str, Column | float]], c: Config, rows: bool = False, keep: tuple[str, ...] = (), chunk: int = CHUNK) -> DataFrame:
    """Detectors that start anew after an alarm, all of the grid in one pass. A file's windows are cut into chunks of bounded size; each is
    folded in order, and its end state is handed on to the next, so there are as many rounds as the longest file has chunks.

    Rows (key, keep, at): by detector of the grid its alarms and episodes. With rows: (key, k, segment, statistic, alarm) of evaluable
    windows for the one detector. keep: columns that are the same for all of a file's windows; thresholds may be made of them."""
    w = Window.partitionBy(key).orderBy("k")
    ok = F.col("value").isNotNull() & ~F.isnan("value")
    items = run_table.select(
        key, *keep, "k", F.when(ok, (F.col("value") - center) / scale).alias("z"), F.sum((~ok).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("segment"),
        F.floor((F.row_number().over(w) - 1) / chunk).alias("chunk"),
    )
    items = saved(items.groupBy(key, *keep, "chunk").agg(F.sort_array(F.collect_list(F.struct("k", "segment", "z"))).alias("items")))

    def state(e: Column, up: Column, down: Column, alarms: Column, episodes: Column, alarm: Column) -> Column:
        return F.struct(e.alias("e"), up.alias("up"), down.alias("down"), alarms.alias("alarms"), episodes.alias("episodes"), alarm.alias("alarm"))

    zero, none = F.lit(0.0), F.lit(0).cast("long")

    def after(s: Column, z: Column, method: str, threshold: Column | float) -> tuple[Column, Column]:
        e, up, down = c.lam * z + (1 - c.lam) * s["e"], F.greatest(zero, s["up"] + z - c.slack), F.greatest(zero, s["down"] - z - c.slack)
        if method == "shewhart":
            stat, moved = F.abs(z), (zero, zero, zero)
        elif method == "ewma":
            stat, moved = F.abs(e) / math.sqrt(c.lam / (2 - c.lam)), (e, zero, zero)
        else:
            stat, moved = F.greatest(up, down), (zero, up, down)
        alarm = F.coalesce(stat > threshold, F.lit(False))
        new = state(*[F.when(alarm, zero).otherwise(x) for x in moved], s["alarms"] + alarm.cast("long"), s["episodes"] + (alarm & ~s["alarm"]).cast("long"), alarm)
        return F.when(z.isNull(), state(zero, zero, zero, s["alarms"], s["episodes"], F.lit(False))).otherwise(new), stat

    def all_after(at: Column, item: Column) -> Column:
        return F.array(*[after(at[i], item["z"], m, t)[0] for i, (m, t) in enumerate(grid)])

    def told(a: Column, item: Column) -> Column:
        s, stat = after(a["at"][0], item["z"], *grid[0])
        row = F.struct(item["k"].alias("k"), item["segment"].alias("segment"), stat.alias("statistic"), s["alarm"].alias("alarm"))
        return F.struct(F.array(s).alias("at"), F.when(item["z"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(row))).alias("out"))

    start = F.array(*[state(zero, zero, zero, none, none, F.lit(False)) for _ in grid])
    no_rows = F.array().cast("array<struct<k:bigint,segment:bigint,statistic:double,alarm:boolean>>")
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("items") - 1) / PART)), lambda i: F.slice("items", i * PART + 1, PART))
    first = F.array(F.struct(F.col("at"), no_rows.alias("out")))
    by_part = F.aggregate(parts, first, lambda done, part: F.concat(done, F.array(F.aggregate(part, F.struct(F.element_at(done, -1)["at"].alias("at"), no_rows.alias("out")), told))))
    rounds, states = items.agg(F.max("chunk")).first()[0], None
    done = []
    for r in range((rounds or 0) + 1):
        now = items.where(F.col("chunk") == r)
        now = now.withColumn("at", start) if states is None else now.join(states, key)
        if rows:
            now = now.select(key, *keep, "chunk", by_part.alias("done")).select(key, *keep, "chunk", F.element_at("done", -1)["at"].alias("at"), F.flatten("done.out").alias("out"))
        else:
            now = now.select(key, *keep, "chunk", F.aggregate("items", F.col("at"), all_after).alias("at"))
        now = saved(now) if rounds else now
        states = now.select(key, "at")
        done.append(now)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    if rows:
        return out.select(key, F.inline("out"))
    return out if not rounds else out.groupBy(key, *keep).agg(F.max_by("at", "chunk").alias("at"))


def detect(run_table: DataFrame, key: str, center: float, scale: float, method: str, threshold: float, c: Config) -> DataFrame:
    """Rows (key, k, segment, statistic, alarm) of evaluable windows for one method and threshold. With reset after an alarm the
    statistic depends on the threshold, and a file's windows (not its samples) are gone through in order."""
    if c.reset_after_alarm:
        return _fold(run_table, key, center, scale, [(method, threshold)], c, rows=True)
    return statistics(run_table, key, center, scale, c).select(key, "k", "segment", F.col(method).alias("statistic"), (F.col(method) > threshold).alias("alarm"))


def alarm_counts(detected: DataFrame, run_table: DataFrame, key: str, c: Config) -> DataFrame:
    """By file: evaluable windows, alarms, episodes (runs of alarms) and resets by reason."""
    s = Window.partitionBy(key, "segment").orderBy("k")
    begins = F.col("alarm") & ~F.coalesce(F.lag("alarm").over(s), F.lit(False))
    found = detected.select(key, "alarm", begins.alias("begins")).groupBy(key).agg(F.count("*").alias("evaluable"), F.count_if("alarm").alias("alarms"), F.count_if("begins").alias("episodes"))
    resets = run_table.groupBy(key).agg(F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("count"))), F.lit(0)).alias("resets_not_evaluable"))
    zero = [F.coalesce(x, F.lit(0)).alias(x) for x in ("evaluable", "alarms", "episodes")]
    after = F.coalesce("alarms", F.lit(0)) if c.reset_after_alarm else F.lit(0).cast("long")
    return resets.join(found, key, "left").select(key, *zero, "resets_not_evaluable", after.alias("resets_after_alarm"))


def mask(run_table: DataFrame, key: str) -> DataFrame:
    """By file: runs of evaluable and other windows as text (`1x2,0x3,..`) and its digest."""
    w = Window.partitionBy(key).orderBy("k")
    bit = F.col("value").isNotNull().cast("int")
    rows = run_table.select(key, "k", "count", bit.alias("bit"), (~bit.eqNullSafe(F.lag(bit).over(w))).cast("int").alias("turn"))
    rows = rows.withColumn("run", F.sum("turn").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(key, "run").agg(F.first("bit").alias("bit"), F.sum("count").alias("n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "bit", "n"))), lambda r: F.concat(r["bit"], F.lit("x"), r["n"])), ",")
    return rows.groupBy(key).agg(F.count("*").alias("runs"), text.alias("mask")).withColumn("mask_sha256", F.sha2("mask", 256))


def calibrate(run_table: DataFrame, key: str, center: float, scale: float, c: Config) -> DataFrame:
    """Rows (method, threshold, alarms, evaluable, tried, chosen): each method's grid, whether a threshold was reached before an
    earlier one fitted, and the one chosen: the first whose alarms are within the budget. A method without one has failed."""
    grid = [(m, i, float(t)) for m in METHODS for i, t in enumerate(c.grids[m])]
    if c.reset_after_alarm:
        at = _fold(run_table, key, center, scale, [(m, t) for m, _, t in grid], c)
        counts = at.agg(*[F.coalesce(F.sum(F.col("at")[j]["alarms"]), F.lit(0)).alias(f"a{j}") for j in range(len(grid))])
        counts = counts.join(run_table.agg(F.count_if(F.col("value").isNotNull() & ~F.isnan("value")).alias("evaluable")), how="cross")  # one row each
    else:
        s = statistics(run_table, key, center, scale, c)
        counts = s.agg(F.count("*").alias("evaluable"), *[F.count_if(F.col(m) > t).alias(f"a{j}") for j, (m, _, t) in enumerate(grid)])
    rows = counts.select("evaluable", F.inline(F.array(*[F.struct(F.lit(m).alias("method"), F.lit(i).alias("i"), F.lit(t).alias("threshold"), F.col(f"a{j}").alias("alarms")) for j, (m, i, t) in enumerate(grid)])))
    fits = F.coalesce((F.col("evaluable") > 0) & (F.col("alarms") / F.col("evaluable") <= c.budget), F.lit(False))
    w = Window.partitionBy("method").orderBy("i")  # a method's grid
    before = F.coalesce(F.max(fits).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    return rows.select("method", "threshold", "alarms", "evaluable", (~before).alias("tried"), (fits & ~before).alias("chosen"))


def assess_stability(evidence: DataFrame, key: str, categories: tuple[str, ...] = STABILITY) -> DataFrame:
    """By key: whether every category has documented evidence (status supported, a basis and an assessor). A p-value alone is none.
    evidence: (key, category, status, basis, assessed_by, p_value), one row for each key and category at most."""
    full = (F.col("status") == "supported") & (F.length("basis") > 0) & (F.length("assessed_by") > 0)
    why = F.when(F.coalesce(full, F.lit(False)), "").when(F.col("p_value").isNotNull(), F.concat(F.lit("p_value_only_not_accepted:"), "category")).otherwise(F.concat(F.lit("incomplete:"), "category"))
    have = evidence.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("category", why.alias("why")))).alias("have"))
    each = [F.nullif(F.coalesce(F.element_at("have", F.lit(x)), F.lit(f"missing:{x}")), F.lit("")) for x in categories]
    out = have.select(key, F.array_compact(F.array(*each)).alias("reasons"))
    return out.select(key, F.when(F.size("reasons") == 0, "stability_supported_by_annotation").otherwise("stability_unverified").alias("status"), "reasons")


def roll_up(summary: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """One row over all files: sums, and files whose figures contradict each other (episodes <= alarms <= evaluable <= complete)."""
    j = summary.where("file_status = 'valid'").select(key, "complete").join(counts, key, "left").fillna(0, ["evaluable", "alarms", "episodes"])
    ordered = (F.col("episodes") <= F.col("alarms")) & (F.col("alarms") <= F.col("evaluable")) & (F.col("evaluable") <= F.col("complete"))
    return j.agg(F.count("*").alias("series"), *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("complete", "evaluable", "alarms", "episodes")], F.count_if(~ordered).alias("contradictions"))
