"""Profiling and audit aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.ranking import exact_quantiles
from gaugeworks.operators.evaluate import psi


def audit(df: DataFrame, features: list[str], label: str, ts: str) -> DataFrame:
    """One row on a table: sizes, failures, times, missing cells, features mostly missing or without information."""
    miss = [F.count_if(F.col(c).isNull()) for c in features]
    agg = df.agg(
        F.count("*").alias("n_rows"), F.sum(label).alias("fails"), F.count_distinct(ts).alias("unique_times"), (F.count("*") - F.count_distinct(F.struct(*features))).alias("duplicate_rows"),
        *[m.alias(f"m{i}") for i, m in enumerate(miss)], *[F.coalesce(F.min(c) != F.max(c), F.lit(False)).alias(f"d{i}") for i, c in enumerate(features)],
    )
    m, d = [F.col(f"m{i}") for i in range(len(features))], [F.col(f"d{i}") for i in range(len(features))]
    total = sum(m[1:], m[0])
    count = lambda xs: sum([F.when(x, 1).otherwise(0) for x in xs], F.lit(0)).cast("long")
    return agg.select(
        "n_rows", F.col("fails").cast("long").alias("fails"), "unique_times", "duplicate_rows", (F.col("n_rows") * len(features)).alias("cells"), total.alias("missing_cells"),
        count([x > 0 for x in m]).alias("features_with_missing"), count([x * 2 > F.col("n_rows") for x in m]).alias("features_mostly_missing"), count([~x for x in d]).alias("uninformative"),
    )


def group_summary(df: DataFrame, feature: str, label: str, value: str) -> DataFrame:
    """By feature and label: size, missing, mean, deviation, quantiles."""
    shares = (5, 25, 50, 75, 95)
    out = df.groupBy(feature, label).agg(F.count("*").alias("n"), F.count(value).alias("observed"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    quantiles = exact_quantiles(df.select(F.struct(feature, label).alias("_pair"), value), "_pair", value, [p / 100 for p in shares])
    out = out.withColumn("_pair", F.struct(feature, label)).join(quantiles, "_pair", "left")
    return out.select(feature, label, "n", "observed", (1 - F.col("observed") / F.col("n")).alias("missing_rate"), "mean", "std", *[F.col("quantiles")[i].alias(f"q{p}") for i, p in enumerate(shares)])


def standardised_difference(summary: DataFrame, feature: str, label: str) -> DataFrame:
    """Mean of label 1 less that of label 0 over the pooled deviation; null with a reason where it has no meaning."""
    side = lambda y: F.max(F.when(F.col(label) == y, F.struct("observed", "mean", "std")))
    p = summary.groupBy(feature).agg(side(1).alias("a"), side(0).alias("b"))
    n, m = F.col("a.observed"), F.col("b.observed")
    pooled = ((n - 1) * F.col("a.std") * F.col("a.std") + (m - 1) * F.col("b.std") * F.col("b.std")) / F.nullif(n + m - 2, F.lit(0))
    few = F.coalesce((n < 2) | (m < 2), F.lit(True))
    reason = F.when(few, "group_too_small").when(~(pooled > 0), "variance_not_positive")
    return p.select(feature, (F.col("a.mean") - F.col("b.mean")).alias("difference"), F.when(reason.isNull(), (F.col("a.mean") - F.col("b.mean")) / F.sqrt(pooled)).alias("standardised"), reason.alias("reason"))


def without_maximum(df: DataFrame, feature: str, label: str, value: str, order: str) -> DataFrame:
    """By feature and label: the row with the largest value (ties: the first in order) and how many tie, and the group's mean and
    deviation with and without that row."""
    known = df.where(F.col(value).isNotNull())
    x = F.col(value)
    g = known.groupBy(feature, label).agg(F.max_by(F.struct(F.col(order).alias("id")), F.struct(x, -F.col(order)))["id"].alias("excluded_id"), F.max(x).alias("largest"), F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))
    rows = known.select(feature, label, order, value).join(g, [feature, label])
    left = (F.col(order) != F.col("excluded_id"))
    return rows.groupBy(feature, label, "excluded_id", "largest", "mean", "std").agg(
        F.count_if(x == F.col("largest")).alias("ties"), F.avg(F.when(left, x)).alias("mean_without_max"), F.stddev_samp(F.when(left, x)).alias("std_without_max"))


def group_summary_by_month(df: DataFrame, feature: str, label: str, value: str, ts: str) -> DataFrame:
    """group_summary with the month as a further key."""
    keyed = df.withColumn("_key", F.struct(F.col(feature), F.date_format(ts, "yyyy-MM").alias("month")))
    return group_summary(keyed, "_key", label, value).select(F.col(f"_key.{feature}").alias(feature), F.col("_key.month").alias("month"), *[c for c in (label, "n", "observed", "missing_rate", "mean", "std", "q5", "q25", "q50", "q75", "q95")])


def quality_report(df: DataFrame, asset: str, ts: str, measurements: list[str]) -> DataFrame:
    """One row on a batch: readings, assets, first and last time, missing cells and their rate (0 without cells)."""
    gone = sum([F.count_if(F.col(m).isNull()) for m in measurements], F.lit(0))
    out = df.agg(F.count("*").alias("readings"), F.count_distinct(asset).alias("assets"), F.min(ts).alias("event_time_min"), F.max(ts).alias("event_time_max"), gone.cast("long").alias("missing_cells"))
    return out.withColumn("missing_rate", F.coalesce(F.try_divide("missing_cells", F.col("readings") * len(measurements)), F.lit(0.0)))


def audit_order(df: DataFrame, features: list[str], ts: str, position: str) -> DataFrame:
    """One row: times that couldn't be read, first and last time, rows that repeat a time, steps back in the order of `position`, features
    without any value, and features that equal an earlier one (nulls equal nulls). The order is laid out in ranges, not in one task."""
    from gaugeworks.functions.ranking import global_rank
    from gaugeworks.operators.features import equal_features

    us = F.unix_micros(F.col(ts).cast("timestamp"))
    ranked = global_rank(df.where(F.col(ts).isNotNull()).select(F.col(position), us.alias("_us")), F.asc(position))
    pairs = ranked.select("rank", "_us").join(ranked.select((F.col("rank") + 1).alias("rank"), F.col("_us").alias("_last")), "rank")
    back = pairs.agg(F.count_if(F.col("_us") < F.col("_last")).alias("time_reversals"))
    empty = sum([F.when(F.count(c) == 0, 1).otherwise(0) for c in features], F.lit(0))
    out = df.agg(F.count_if(F.col(ts).isNull()).alias("time_failures"), F.min(ts).alias("time_min"), F.max(ts).alias("time_max"), (F.count(ts) - F.count_distinct(ts)).alias("repeated_time_rows"), empty.cast("long").alias("all_missing"))
    return out.join(back, how="cross").withColumn("duplicate_features", F.lit(len(equal_features(df, position, features))).cast("long"))


def monthly(df: DataFrame, ts: str, label: str) -> DataFrame:
    return df.groupBy(F.date_format(ts, "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.sum(label).alias("fails"))


def next_record(df: DataFrame, key: str, order: list[str], wanted, of: str) -> DataFrame:
    """Adds the value `of` of the next row of the series that meets a condition."""
    ahead = Window.partitionBy(key).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return df.withColumn("next_match", F.min(F.when(wanted, F.col(of))).over(ahead))


def trailing(df: DataFrame, key: str, order: list[str], ts: str, value: str, rows: int = 120, gap: float = 5.0) -> DataFrame:
    """Mean of the last rows and whether a gap of more than gap seconds stands before a row."""
    w = Window.partitionBy(key).orderBy(*order)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    return df.withColumn("trail_mean", F.avg(value).over(w.rowsBetween(1 - rows, 0))).withColumn("break_before", F.coalesce((us - F.lag(us).over(w)) > gap * 1e6, F.lit(False)))


def split_summary(df: DataFrame, split: str, label: str, ts: str) -> DataFrame:
    """By split: rows, failures and their rate, first and last time."""
    return df.groupBy(split).agg(F.count("*").alias("n"), F.coalesce(F.sum(label), F.lit(0)).cast("long").alias("fails"), F.avg(label).alias("fail_rate"), F.min(ts).alias("time_min"), F.max(ts).alias("time_max"))


def trace(df: DataFrame, key: str, order: str, ts: str, value: str, at: dict, rows: int = 120, gap: float = 5.0) -> DataFrame:
    """The last rows of chosen series up to a position: (key, order, ts, value, break_before). at: by series, the position that the trace ends
    at. A gap of more than gap seconds before a row breaks the line there; the first row of a trace has no break."""
    ends = df.sparkSession.createDataFrame([(k, v) for k, v in at.items()], f"`{key}` {df.schema[key].dataType.simpleString()}, _at {df.schema[order].dataType.simpleString()}")
    last = Window.partitionBy(key).orderBy(F.desc(order))
    mine = df.join(F.broadcast(ends), key).where(F.col(order) <= F.col("_at")).withColumn("_rn", F.row_number().over(last)).where(F.col("_rn") <= rows)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(order)
    return mine.select(key, order, ts, value, F.coalesce((us - F.lag(us).over(w)) > gap * 1e6, F.lit(False)).alias("break_before"))


def process_cadence(df: DataFrame, key: str, order: list[str], ts: str, features: list[str], longest: float = 0.3) -> DataFrame:
    """By series of a process: rows, median and largest interval in microseconds, intervals that don't increase or are longer than `longest`
    seconds, and cells that are missing or not finite."""
    w = Window.partitionBy(key).orderBy(*order)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    odd = sum([(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))).cast("int") for c in features], F.lit(0))
    rows = df.select(key, (us - F.lag(us).over(w)).alias("step"), odd.alias("odd"))
    return rows.groupBy(key).agg(
        F.count("*").alias("n_rows"), F.percentile("step", F.lit(0.5)).alias("median_step_us"), F.max("step").alias("largest_step_us"), F.count_if(F.col("step") <= 0).alias("not_increasing"),
        F.count_if(F.col("step") > longest * 1_000_000).alias("long_steps"), F.sum("odd").alias("nonfinite_cells"),
    )


def both_ways(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys in both, in left alone, in right alone."""
    a, b = left.select(*keys, F.lit(1).alias("l")).distinct(), right.select(*keys, F.lit(1).alias("r")).distinct()
    return a.join(b, keys, "full").agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("matched"), F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"))


def log_audit(df: DataFrame, key: str, order: list[str], ts: str, value: str, counter: str, gap: float = 5.0) -> DataFrame:
    """By series of a machine's log: records, those without a value, gaps longer than gap seconds, falls of the counter, median, least and largest interval in microseconds."""
    w = Window.partitionBy(key).orderBy(*order)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.select(key, F.col(value).isNull().alias("gone"), (us - F.lag(us).over(w)).alias("step"), (F.col(counter) < F.lag(counter).over(w)).alias("fall"))
    return rows.groupBy(key).agg(
        F.count("*").alias("records"), F.count_if("gone").alias("without_value"), F.count_if(F.col("step") > gap * 1_000_000).alias("gaps"), F.count_if("fall").alias("counter_falls"), F.count_if(F.col("step") == 0).alias("repeats"),
        F.percentile("step", F.lit(0.5)).alias("median_step_us"), F.min("step").alias("least_step_us"), F.max("step").alias("largest_step_us"),
    )


def key_audit(df: DataFrame, key: str, coordinates: list[str]) -> DataFrame:
    """By number of rows of a key: keys with that number, and rows that repeat a coordinate within them. Rows without a key have the number 0."""
    at = df.where(F.col(key).isNotNull()).groupBy(key, *coordinates).agg(F.count("*").alias("n"))
    keyed = at.groupBy(key).agg(F.sum("n").alias("rows_of_key"), F.sum(F.col("n") - 1).alias("again"))
    out = keyed.groupBy("rows_of_key").agg(F.count("*").alias("keys"), F.sum("again").alias("repeated_coordinates"))
    blank = df.where(F.col(key).isNull()).agg(F.lit(0).cast("long").alias("rows_of_key"), F.count("*").alias("keys"), F.lit(0).cast("long").alias("repeated_coordinates")).where("keys > 0")
    return out.union(blank)


def lots(df: DataFrame, index: str, state: str, size: int = 4) -> DataFrame:
    """By lot of `size` consecutive pieces: inserted, completed, bad, missing."""
    lot = F.floor(F.col(index) / size).alias("lot")
    return df.groupBy(lot).agg(F.count("*").alias("inserted"), F.count_if(F.col(state) == "completed").alias("completed"), F.count_if(F.col(state) == "bad").alias("bad"), F.count_if(F.col(state).isNull()).alias("missing"))


def manifest_match(df: DataFrame, manifest: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row: rows of a frozen manifest found, absent, changed, and rows it doesn't know."""
    j = df.select(key, F.struct(*fields).alias("a")).join(manifest.select(key, F.struct(*fields).alias("b")), key, "full")
    a, b = F.col("a"), F.col("b")
    return j.agg(F.count_if(a.eqNullSafe(b)).alias("found"), F.count_if(a.isNull()).alias("absent"), F.count_if(a.isNotNull() & b.isNotNull() & ~a.eqNullSafe(b)).alias("changed"), F.count_if(b.isNull()).alias("unknown"))


def drift(reference: DataFrame, current: DataFrame, features: list[str]) -> DataFrame:
    """By feature: missing share in either table, its change, and population stability."""
    tall = lambda df: df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features])))
    r, c = tall(reference), tall(current)
    gone = lambda df, n: df.groupBy("feature").agg(F.avg(F.col("x").isNull().cast("int")).alias(n))
    out = gone(r, "reference_missing").join(gone(c, "current_missing"), "feature").join(psi(r, c, "x", "feature"), "feature")
    return out.withColumn("missing_change", F.col("current_missing") - F.col("reference_missing"))
