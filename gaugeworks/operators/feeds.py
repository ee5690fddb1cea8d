"""Contracts of time-stamped feeds: versioned estimates, quarter-hour envelopes, energy, modelled hours, station years.

Every function works over many series at once. Broken rows carry reasons; nothing is dropped unseen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.operators.contracts import Rule, finite, localise, with_reasons

#: Kilowatts of a unit; letters with accents and their plain forms.
KILOWATTS = {"W": 0.001, "kW": 1.0, "MW": 1000.0}
ACCENTS, PLAIN = "àâäçéèêëîïôöùûü", "aaaceeeeiioouuu"


def micros(ts: Column | str) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def _repeated(*keys: Column | str) -> Column:
    return F.count("*").over(Window.partitionBy(*keys)) > 1


def power(df: DataFrame, key: str, ts: str, value: str, zone: str, unit: str) -> DataFrame:
    """Adds ts_utc and power_kw. A wall time that the zone skips or has twice, a repeated instant and an infinite value are named; nulls stay."""
    out = df.withColumn("ts_utc", localise(F.col(ts).cast("timestamp"), zone)).withColumn("power_kw", F.col(value) * KILOWATTS[unit])
    rules = [
        Rule("time_missing_or_ambiguous", F.col("ts_utc").isNull()),
        Rule("value_not_finite", F.col(value).isNotNull() & ~finite(F.col(value))),
        Rule("duplicate_time", F.col("ts_utc").isNotNull() & _repeated(key, "ts_utc")),
    ]
    return with_reasons(out, rules)


def versioned_estimates(df: DataFrame, entity: str, interval: str, updated: str, value: str, minutes: int = 30) -> DataFrame:
    """Adds reasons: estimates must be known and not negative, intervals aligned, updates no earlier than their interval's end, revisions unique."""
    rules = [
        Rule("value_missing", ~finite(F.col(value)) | F.col(value).isNull()),
        Rule("negative_estimate", F.col(value) < 0),
        Rule("interval_not_aligned", micros(interval) % (minutes * 60_000_000) != 0),
        Rule("updated_before_end", micros(updated) < micros(interval)),
        Rule("duplicate_revision", _repeated(entity, interval, updated)),
    ]
    return with_reasons(df, rules)


def revision_counts(df: DataFrame, entity: str, interval: str) -> DataFrame:
    """By entity: rows, intervals, intervals with revisions, rows beyond the first of an interval."""
    each = df.groupBy(entity, interval).agg(F.count("*").alias("n"))
    return each.groupBy(entity).agg(F.sum("n").alias("n_rows"), F.count("*").alias("intervals"), F.count_if(F.col("n") > 1).alias("revised_intervals"), F.sum(F.col("n") - 1).alias("rows_beyond_first"))


def revision_status(text: Column) -> Column:
    """Folds a free status: definitive or consolidated, whatever its case and accents; null if neither is named."""
    t = F.translate(F.lower(text), ACCENTS, PLAIN)
    return F.when(t.contains("definit"), "definitive").when(t.contains("consolid"), "consolidated")


def quarter_hours(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Adds structural (slots at :15 and :45 of a series that has any) and reasons. Structural slots must be null, others finite and not negative."""
    minute = (micros(ts) / 60_000_000).cast("long") % 60
    off_grid = micros(ts) % 900_000_000 != 0
    quarter = minute.isin(15, 45)
    rules = [
        Rule("off_grid", off_grid),
        Rule("structural_value", quarter & F.col(value).isNotNull()),
        Rule("value_missing", ~quarter & ~F.coalesce(finite(F.col(value)), F.lit(False))),
        Rule("negative", ~quarter & (F.col(value) < 0)),
        Rule("duplicate_time", _repeated(key, ts)),
    ]
    return with_reasons(df.withColumn("structural", quarter), rules)


def steps(df: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """By series: rows, and steps that are not the nominal one."""
    us = micros(ts)
    step = us - F.lag(us).over(Window.partitionBy(key).orderBy(us))
    return df.select(key, step.alias("step")).groupBy(key).agg(F.count("*").alias("n_rows"), F.count_if(F.col("step") != seconds * 1_000_000).alias("broken_steps"))


def day_shape(df: DataFrame, ts: str, zone: str, columns: list[str]) -> DataFrame:
    """By UTC day of quarter-hours: rows, exact copies, missing quarters, the zone's change of offset, and whether the shape is the expected one.

    96 rows on plain days; 100 with four exact copies when the offset grows by an hour; 92 with four missing when it shrinks.
    Rows at one time that differ are in conflict and spoil the day.
    """
    at = F.col(ts).cast("timestamp")
    start = F.date_trunc("day", at)
    offset = lambda t: micros(F.from_utc_timestamp(t, zone)) - micros(t)
    content = F.struct(*columns)
    slots = df.select(start.alias("day"), at.alias("at"), content.alias("content")).groupBy("day", "at").agg(F.count("*").alias("n"), (F.min("content") != F.max("content")).alias("conflict"))
    out = slots.groupBy("day").agg(
        F.sum("n").alias("n_rows"), F.sum(F.col("n") - 1).alias("copies"), F.count_if("conflict").alias("conflicts"), (96 - F.count_if(micros("at") % 900_000_000 == 0)).alias("missing"),
        F.count_if(micros("at") % 900_000_000 != 0).alias("off_grid"),
    )
    out = out.withColumn("offset_change", ((offset(F.col("day") + F.expr("interval 1 day")) - offset(F.col("day"))) / 60_000_000).cast("int"))
    fits = lambda n, c, m: (F.col("n_rows") == n) & (F.col("copies") == c) & (F.col("missing") == m)
    shape = F.when(F.col("offset_change") == 60, fits(100, 4, 0)).when(F.col("offset_change") == -60, fits(92, 0, 4)).otherwise(fits(96, 0, 0))
    return out.withColumn("accepted", shape & (F.col("conflicts") == 0) & (F.col("off_grid") == 0))


def fill_days(df: DataFrame, key: str, ts: str, value: str, minutes: int = 30) -> DataFrame:
    """Every slot of each day that a series has: (key, day, slot, value); slots without a reading are null. Of several readings the latest known one stands."""
    us, step = micros(ts), minutes * 60_000_000
    day = F.floor(us / 86_400_000_000).cast("long")
    rows = df.select(key, day.alias("day"), F.floor((us - day * 86_400_000_000) / step).cast("int").alias("slot"), us.alias("us"), F.col(value).alias("value"))
    found = rows.groupBy(key, "day", "slot").agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("us"))).alias("value"))
    grid = found.select(key, "day").distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(1440 // minutes - 1))))
    return grid.join(found, [key, "day", "slot"], "left").withColumn("day", F.date_from_unix_date(F.col("day").cast("int")))


def energy(df: DataFrame, key: str, ts: str, wh: str, points: str) -> DataFrame:
    """Adds mean_power_w (energy of half an hour, doubled; null stays null) and reasons."""
    rules = [
        Rule("time_missing", F.col(ts).isNull()),
        Rule("duplicate_time", _repeated(key, ts)),
        Rule("energy_not_valid", F.col(wh).isNotNull() & (~finite(F.col(wh)) | (F.col(wh) < 0))),
        Rule("points_not_valid", F.coalesce((F.col(points) < 0) | (F.floor(points) != F.col(points)), F.lit(True))),
    ]
    return with_reasons(df.withColumn("mean_power_w", F.col(wh) * 2.0), rules)


def modelled_hours(df: DataFrame, time: str, values: list[str], flag: str, key: str | None = None) -> DataFrame:
    """Adds ts (from yyyyMMdd:HHmm) and reasons: times readable, values finite and not negative, flag 0 or 1; with a key also times
    that repeat in a series, and rows that don't follow the time before theirs by an hour (of repeated times all or none)."""
    out = df.withColumn("ts", F.try_to_timestamp(F.col(time), F.lit("yyyyMMdd:HHmm")))
    rules = [Rule("time_not_readable", F.col("ts").isNull())]
    rules += [Rule(f"{v}_not_valid", ~F.coalesce(finite(F.col(v)) & (F.col(v) >= 0), F.lit(False))) for v in values]
    rules += [Rule("flag_not_valid", ~F.coalesce(F.col(flag).isin(0, 1), F.lit(False)))]
    if key is not None:
        us = micros("ts")
        step = us - F.max(us).over(Window.partitionBy(key).orderBy(us).rangeBetween(Window.unboundedPreceding, -1))
        rules += [Rule("time_repeated", F.col("ts").isNotNull() & _repeated(key, "ts")), Rule("hour_gap", step != 3_600_000_000)]
    return with_reasons(out, rules)


def half_hours(df: DataFrame, key: str, ts: str, value: str, nature: str, expected: str | None = None, continuous: bool = True) -> tuple[DataFrame, DataFrame]:
    """(accepted half-hours, rejected rows) of a feed of quarter-hours: quarter_hours' rules, the expected revision status if one is
    named, and, where continuous, each half-hour half an hour after the one before. Structural slots are dropped once they are checked."""
    checked = quarter_hours(df, key, ts, value).withColumn("status", revision_status(F.col(nature)))
    step = micros(ts) - F.max(F.when(~F.col("structural"), micros(ts))).over(Window.partitionBy(key).orderBy(micros(ts)).rangeBetween(Window.unboundedPreceding, -1))
    gap = F.lit(continuous) & ~F.col("structural") & (step != 1_800_000_000)
    status = F.lit(expected is not None) & ~F.col("status").eqNullSafe(F.lit(expected))
    more = F.array_compact(F.array(F.when(gap, "not_continuous"), F.when(status, "status_not_expected")))
    checked = checked.withColumn("_more", more).withColumn("reasons", F.concat("reasons", "_more")).drop("_more")
    return checked.where((F.size("reasons") == 0) & ~F.col("structural")).drop("reasons", "structural"), checked.where(F.size("reasons") > 0)


def report_rules(report: str, ranges: dict[str, tuple[float | None, float | None]], flags: list[str], above_zero: tuple[str, ...] = ()) -> list[Rule]:
    """Rules for reports in a map of texts: every key present, numbers finite and in their closed range (or above zero), flags true or false."""
    out = []
    for k, (low, high) in ranges.items():
        x = F.try_element_at(report, F.lit(k)).try_cast("double")
        bad = ~F.coalesce(finite(x), F.lit(False))
        for edge in [x < low] * (low is not None) + [x > high] * (high is not None) + [x <= 0] * (k in above_zero):
            bad = bad | F.coalesce(edge, F.lit(False))
        out.append(Rule(f"{k}_not_valid", F.map_contains_key(report, F.lit(k)) & bad))
    out += [Rule(f"{k}_not_boolean", F.map_contains_key(report, F.lit(k)) & ~F.coalesce(F.lower(F.try_element_at(report, F.lit(k))).isin("true", "false"), F.lit(False))) for k in flags]
    return [Rule(f"{k}_missing", ~F.coalesce(F.map_contains_key(report, F.lit(k)), F.lit(False))) for k in [*ranges, *flags]] + out


def station_years(df: DataFrame, station: str, name: str, ts: str, joules: str) -> DataFrame:
    """By station and year: hours of the year, hours seen, repeated hours, names, and mean irradiance in W/m2 of J/cm2 by the hour."""
    us = micros(ts)
    rows = df.select(station, F.year(ts).alias("year"), F.floor(us / 3_600_000_000).alias("hour"), F.col(name).alias("name"), (F.col(joules) * 10000 / 3600).alias("wm2"))
    # Names are few for an hour and a station; equal ones fold at once, so two extremes tell whether there is one.
    hours = rows.groupBy(station, "year", "hour").agg(F.count("*").alias("n"), F.min("name").alias("a"), F.max("name").alias("b"), F.sum("wm2").alias("s"), F.count("wm2").alias("k"))
    out = hours.groupBy(station, "year").agg(F.count("*").alias("seen"), F.count_if(F.col("n") > 1).alias("repeated"), (F.min("a") == F.max("b")).alias("one_name"), (F.sum("s") / F.sum("k")).alias("mean_wm2"))
    days = F.datediff(F.make_date(F.col("year") + 1, F.lit(1), F.lit(1)), F.make_date("year", F.lit(1), F.lit(1)))
    out = out.withColumn("expected", (days * 24).cast("long"))
    return out.withColumn("complete", (F.col("seen") == F.col("expected")) & (F.col("repeated") == 0) & F.col("one_name"))


def traces(df: DataFrame, asset: str, equipment: str, unit: str, wanted_unit: str, stream: list[str], batch: str) -> DataFrame:
    """Adds reasons: equipment is the asset, the unit is the measurement's, a batch holds one stream."""
    w = Window.partitionBy(batch)
    key = F.xxhash64(*stream)
    rules = [
        Rule("equipment_differs", ~F.col(equipment).eqNullSafe(F.col(asset))),
        Rule("unit_differs", ~F.col(unit).eqNullSafe(F.lit(wanted_unit))),
        Rule("several_streams", F.min(key).over(w) != F.max(key).over(w)),
    ]
    return with_reasons(df, rules)


def roles(df: DataFrame, group: str, role: str, expected: dict[str, int] | None = None) -> DataFrame:
    """By role: distinct groups, groups that have another role too, and whether the number of groups is the expected one."""
    pairs = df.select(group, role).distinct()
    many = pairs.groupBy(group).agg((F.count("*") > 1).alias("shared"))
    out = pairs.join(many, group).groupBy(role).agg(F.count("*").alias("n_groups"), F.count_if("shared").alias("shared_groups"))
    if expected is None:
        return out
    wanted = F.create_map(*[F.lit(x) for pair in expected.items() for x in pair])
    return out.withColumn("as_expected", F.coalesce(F.col("n_groups") == F.try_element_at(wanted, F.col(role)), F.lit(False)))


def range_rules(ranges: dict[str, tuple[float | None, float | None]]) -> list[Rule]:
    """Rules for required numbers: known, finite and within their closed range (None: open)."""
    out = []
    for c, (low, high) in ranges.items():
        v = F.col(c)
        bad = ~finite(v)
        bad = bad | (v < low) if low is not None else bad
        out.append(Rule(f"{c}_not_valid", v.isNull() | (bad | (v > high) if high is not None else bad)))
    return out
