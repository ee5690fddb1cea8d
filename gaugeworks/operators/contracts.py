"""Row contracts: rules with names; strict mode raises, quarantine parts accepted rows from rejected ones with reasons."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.sources.readers import NUMBER


@dataclass(frozen=True)
class Rule:
    name: str
    broken: Column  # null counts as not broken


def with_reasons(df: DataFrame, rules: list[Rule]) -> DataFrame:
    return df.withColumn("reasons", F.array_compact(F.array(*[F.when(r.broken, F.lit(r.name)) for r in rules])))


def apply_contract(df: DataFrame, rules: list[Rule], mode: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected). In strict mode any rejected row raises."""
    checked = with_reasons(df, rules)
    rejected = checked.where(F.size("reasons") > 0)
    if mode == "strict" and (first := rejected.first()):
        raise ValueError(f"contract broken: {list(first['reasons'])}")
    return checked.where(F.size("reasons") == 0).drop("reasons"), rejected


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def reading_rules(asset: str, ts: str, value: str, required: Column | None = None) -> list[Rule]:
    """Asset named, time known, value finite or null, no second reading of an asset and time."""
    twice = F.count("*").over(Window.partitionBy(asset, ts)) > 1
    rules = [
        Rule("asset_missing", F.coalesce(F.trim(F.col(asset).cast("string")) == "", F.lit(True))),
        Rule("time_missing", F.col(ts).isNull()),
        Rule("value_not_finite", F.col(value).isNotNull() & ~finite(F.col(value))),
        Rule("duplicate", twice),
    ]
    return rules + ([Rule("measurement_missing", required)] if required is not None else [])


def open_readings(df: DataFrame, required: tuple[str, ...] = ()) -> DataFrame:
    """Readings (asset_code, user_ts, ts, reading map) with sample_id, event_time and reasons: a blank asset, no reading, a time that is absent or
    can't be read, required names absent, values that aren't finite (null is a missing measurement), an asset and time that occur twice."""
    text = F.coalesce("user_ts", "ts")
    at = F.when(~text.rlike(r"^[0-9.+-]+$") | text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text))
    df = df.withColumn("event_time", at)
    df = df.withColumn("sample_id", F.concat_ws(":", "asset_code", F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")))
    values = F.map_values("reading")
    rules = [
        Rule("asset_missing", F.coalesce(F.trim("asset_code") == "", F.lit(True))), Rule("reading_missing", F.col("reading").isNull()),
        Rule("time_missing", text.isNull()), Rule("time_not_valid", text.isNotNull() & F.col("event_time").isNull()),
        Rule("value_not_finite", F.exists(values, lambda v: v.isNotNull() & ~finite(v))),
        Rule("duplicate", F.col("event_time").isNotNull() & (F.count("*").over(Window.partitionBy("asset_code", "event_time")) > 1)),
    ]
    rules += [Rule(f"{n}_absent", ~F.map_contains_key("reading", F.lit(n))) for n in required]
    return with_reasons(df, rules)


def board_rows(df: DataFrame, board: str, pad: str, value: str, position: str) -> DataFrame:
    """Adds number and reasons to an export's rows: ids blank, a value that is no finite number of the usual form or negative, and every
    occurrence of a board and pad after the first in the order of `position`."""
    ids = [F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in (board, pad)]
    raw = F.trim(F.coalesce(F.col(value).cast("string"), F.lit("")))
    x = F.when(raw.rlike(NUMBER), raw.try_cast("double"))
    later = F.row_number().over(Window.partitionBy(*ids).orderBy(position)) > 1
    rules = [Rule("id_missing", (ids[0] == "") | (ids[1] == "")), Rule("value_not_valid", ~F.coalesce(finite(x) & (x >= 0), F.lit(False))), Rule("board_and_pad_repeated", later)]
    return with_reasons(df, rules).withColumn("number", x)


def latest(df: DataFrame, keys: list[str], *version: str) -> DataFrame:
    """The last version of each key, by a partial aggregate."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("last"))
    return best.select(*keys, *[F.col(f"last.{c}").alias(c) for c in rest])


def coverage(df: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """One row: slots of the grid that df lacks, rows of df off the grid, slots that occur more than once."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    both = counts.join(grid.select(*keys, F.lit(1).alias("on_grid")), keys, "full")
    return both.agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("on_grid").isNull()).alias("unexpected"), F.count_if(F.col("n") > 1).alias("repeated"))


def regularise(df: DataFrame, key: str, ts: str, value: str, step: int, skew: int) -> tuple[DataFrame, DataFrame]:
    """(slots, rejected): readings on the nearest multiple of step seconds (halves to the even slot) if they lie within
    skew seconds of it. In a slot a value beats a null, then a reading on the grid, then the earliest wins. Readings too far
    off (`clock_skew`) and all readings of a slot with different values (`slot_conflict`) are rejected with that reason."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    slot = F.rint(us / F.lit(step * 1_000_000)).cast("long") * step
    df = df.withColumn("slot", slot).withColumn("off", F.abs(us - F.col("slot") * 1_000_000))
    near = df.where(F.col("off") <= skew * 1_000_000)
    best = F.min_by(F.struct(F.col(value).alias("value"), (F.col("off") > 0).alias("adjusted")), F.struct(F.col(value).isNull(), F.col("off") > 0, us))
    slots = near.groupBy(key, "slot").agg(best.alias("best"), F.count("*").alias("readings"), F.count_if(F.col(value).isNull()).alias("nulls"), (F.max(value) - F.min(value)).alias("spread"))
    agrees = F.coalesce(F.col("spread") <= 1e-9, F.lit(True))
    good = slots.where(agrees).select(key, "slot", "best.value", "readings", F.when(F.col("best.value").isNotNull(), F.greatest("best.value", F.lit(0.0))).alias("clipped"), "best.adjusted", "nulls")
    conflicts = near.join(slots.where(~agrees).select(key, "slot"), [key, "slot"], "left_semi").withColumn("reason", F.lit("slot_conflict"))
    far = df.where(F.col("off") > skew * 1_000_000).withColumn("reason", F.lit("clock_skew"))
    return good, far.unionByName(conflicts)


def on_grid(slots: DataFrame, key: str, start: int, end: int, step: int) -> DataFrame:
    """A row for each key and slot from start (epoch seconds) up to, not including, end: those without a reading are `missing`."""
    grid = slots.select(key).distinct().withColumn("slot", F.explode(F.sequence(F.lit(start), F.lit(end - 1), F.lit(step))))
    out = grid.join(slots.where(F.col("slot").between(start, end - 1)), [key, "slot"], "left")
    return out.withColumn("missing", F.col("readings").isNull()).withColumn("adjusted", F.coalesce("adjusted", F.lit(False)))


def grid_audit(filled: DataFrame, key: str) -> DataFrame:
    """By key of on_grid(): rows, slots missing from the source, adjusted ones, collisions, values that beat a null, values still missing, negatives clipped."""
    return filled.groupBy(key).agg(
        F.count("*").alias("normalized_rows"), F.count_if("missing").alias("missing_slots"), F.count_if("adjusted").alias("rounded"), F.count_if(F.col("readings") > 1).alias("collisions"),
        F.count_if((F.col("readings") - F.col("nulls") == 1) & (F.col("nulls") > 0)).alias("value_over_null"), F.count_if(F.col("value").isNull()).alias("missing_values"), F.count_if(F.col("value") < 0).alias("clipped_negatives"),
    )


def split_mapping(mapping: DataFrame, files: list[str], label: str, expected: DataFrame) -> DataFrame:
    """Findings (kind, item, n) of a segment mapping (split, label, file columns): counts by split and label that differ from the
    expected table (split, label, n), and files that occur more than once, within a split or across splits."""
    counts = mapping.groupBy("split", label).agg(F.count("*").alias("n"))
    j = expected.withColumnRenamed("n", "wanted").join(counts, ["split", label], "full").where(~F.col("wanted").eqNullSafe(F.col("n")))
    off = j.select(F.lit("count").alias("kind"), F.concat_ws(":", "split", F.col(label).cast("string")).alias("item"), F.coalesce("n", F.lit(0)).alias("n"))
    each = mapping.select("split", F.explode(F.array(*files)).alias("file")).groupBy("file").agg(F.count("*").alias("n"), F.count_distinct("split").alias("splits")).where("n > 1")
    again = each.select(F.when(F.col("splits") > 1, "file_across_splits").otherwise("file_within_split").alias("kind"), F.col("file").cast("string").alias("item"), "n")
    return off.unionByName(again)


#: Fixed value: a time with date, clock and zone.
ZONED = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(?:\.(\d{1,18}))?(Z|[+-]\d{2}:\d{2})$"


def zoned_instant(text: Column) -> Column:
    """(seconds, fraction) of a text with a zone, at the full precision that is written: fractions are compared as padded digits. Null if it isn't one."""
    part = lambda i: F.regexp_extract(text, ZONED, i)
    second = F.unix_seconds(F.try_to_timestamp(F.concat(part(1), part(3))))
    return F.when(second.isNotNull() & text.rlike(ZONED), F.struct(second.alias("second"), F.rpad(part(2), 18, "0").alias("fraction")))


def screening_input(df: DataFrame, stream: list[str], position: str, ts: str, value: str) -> DataFrame:
    """Adds reasons to rows of an equipment's export, in the order of `position` within a stream: a time without a zone, times that don't
    increase (compared at full precision), values that are no number, no finite number or negative."""
    number = F.col(value).cast("string")
    x = number.try_cast("double")
    w = Window.partitionBy(*stream).orderBy(position)
    df = df.withColumn("_at", zoned_instant(F.col(ts)))
    rules = [
        Rule("time_not_zoned", F.col("_at").isNull()),
        Rule("time_not_increasing", F.col("_at") <= F.lag("_at").over(w)),
        Rule("value_not_numeric", number.isNotNull() & (F.trim(number) != "") & ~F.coalesce(finite(x), F.lit(False))),
        Rule("value_negative", x < 0),
    ]
    return with_reasons(df, rules).withColumn("number", x).drop("_at")


def cadence(df: DataFrame, key: str, *order: str, ts: str = "ts") -> DataFrame:
    """By series: rows, steps that don't increase, median, least and largest step in microseconds."""
    w = Window.partitionBy(key).orderBy(*order)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    step = df.select(key, (us - F.lag(us).over(w)).alias("step"))
    return step.groupBy(key).agg(F.count("*").alias("n_rows"), F.count_if(F.col("step") <= 0).alias("not_increasing"), F.percentile("step", F.lit(0.5)).alias("median_step"), F.min("step").alias("min_step"), F.max("step").alias("max_step"))


def inspect_dataset(df: DataFrame, id_col: str, ts: str, label: str, features: list[str], positive: int = 1) -> DataFrame:
    """One row on a labelled table: what is missing, repeated or not finite, and whether a locked model may score it."""
    bad = [F.count_if(~finite(F.col(c)) & F.col(c).isNotNull()) for c in features]
    out = df.agg(
        F.count("*").alias("n_rows"), (F.count("*") - F.count_distinct(id_col)).alias("repeated_ids"), F.count_if(F.col(ts).isNull()).alias("missing_times"),
        F.count_if(F.col(label) == positive).alias("positives"), F.count_if(~F.col(label).isin(0, 1)).alias("other_labels"),
        sum(bad[1:], bad[0]).alias("bad_cells"), sum([F.count_if(F.col(c).isNull()) for c in features[1:]], F.count_if(F.col(features[0]).isNull())).alias("missing_cells"),
    )
    fit = (F.col("n_rows") > 0) & (F.col("repeated_ids") == 0) & (F.col("missing_times") == 0) & (F.col("other_labels") == 0) & (F.col("bad_cells") == 0) & (F.col("positives") > 0)
    return out.withColumn("eligibility", F.when(fit, "locked_model_candidate").otherwise("schema_only"))


def localise(local: Column, zone: str) -> Column:
    """UTC instant of a zone's wall time; null for times that the zone skips or has twice."""
    utc = F.to_utc_timestamp(local, zone)
    back = lambda t: F.from_utc_timestamp(t, zone)
    hour = F.expr("interval 1 hour")
    return F.when((back(utc) == local) & (back(utc + hour) != local) & (back(utc - hour) != local), utc)
