"""Feature engineering fitted on training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.ranking import column_quantiles


def fit_columns(df: DataFrame, id_col: str, features: list[str], most_missing: float = 0.5) -> list[str]:
    """Columns that are known often enough, vary, and don't equal an earlier one (by an order-free fingerprint, then exactly)."""
    stats = df.agg(F.count("*").alias("n"), *[x for i, c in enumerate(features) for x in (
        F.count(c).alias(f"k{i}"), F.min(c).alias(f"a{i}"), F.max(c).alias(f"b{i}"), F.sum(F.xxhash64(id_col, c).cast("decimal(38)")).alias(f"h{i}"))]).first()
    kept, seen = [], {}
    for i, c in enumerate(features):
        if stats["n"] and 1 - stats[f"k{i}"] / stats["n"] <= most_missing and stats[f"a{i}"] != stats[f"b{i}"]:
            same = [s for s in seen.get(stats[f"h{i}"], []) if not df.where(~F.col(s).eqNullSafe(F.col(c))).take(1)]
            if not same:
                kept.append(c)
                seen.setdefault(stats[f"h{i}"], []).append(c)
    return kept


def equal_features(df: DataFrame, id_col: str, features: list[str]) -> list[str]:
    """Columns that equal an earlier one in all rows: fingerprints first, then an exact look at those that agree."""
    prints = df.agg(*[F.sum(F.xxhash64(id_col, c).cast("decimal(38)")).alias(f"h{i}") for i, c in enumerate(features)]).first()
    out, seen = [], {}
    for i, c in enumerate(features):
        if any(not df.where(~F.col(s).eqNullSafe(F.col(c))).take(1) for s in seen.get(prints[f"h{i}"], [])):
            out.append(c)
        else:
            seen.setdefault(prints[f"h{i}"], []).append(c)
    return out


def impute_and_scale(train: DataFrame, df: DataFrame, features: list[str]) -> DataFrame:
    """Medians of train for missing values, with indicators, then z-scores by train's mean and population deviation."""
    med = column_quantiles(train, features) | train.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}_gone") for c in features]).first().asDict()
    filled = lambda c: F.coalesce(F.col(c), F.lit(med[c]))
    fit = train.agg(*[x for c in features for x in (F.avg(filled(c)).alias(f"{c}_m"), F.stddev_pop(filled(c)).alias(f"{c}_s"))]).first()
    out = df
    for c in features:
        if med[f"{c}_gone"]:
            out = out.withColumn(f"{c}_missing", F.col(c).isNull().cast("int"))
        out = out.withColumn(c, (filled(c) - F.lit(fit[f"{c}_m"])) / F.lit(fit[f"{c}_s"] or 1.0))
    return out


def channel_features(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """By series: mean, deviation, RMS, 95th percentile of absolute values, RMS of steps, known share."""
    w = Window.partitionBy(key).orderBy(*order)
    x, step = F.col(value), F.col(value) - F.lag(value).over(w)
    d = df.select(key, x.alias("x"), step.alias("step"))
    return d.groupBy(key).agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.percentile(F.abs("x"), F.lit(0.95)).alias("abs_p95"), F.sqrt(F.avg(F.col("step") * F.col("step"))).alias("diff_rms"), (F.count("x") / F.count("*")).alias("valid_fraction"))


def segment_features(samples: DataFrame, segment: str, channel: str, order: list[str], value: str, channels: list[str]) -> DataFrame:
    """One row for each segment: the channel features of all declared channels as columns `channel_feature`; null for a channel without samples."""
    keyed = samples.withColumn("_key", F.struct(segment, channel))
    long = channel_features(keyed, "_key", order, value).select(F.col(f"_key.{segment}").alias(segment), F.col(f"_key.{channel}").alias("_channel"), "mean", "std", "rms", "abs_p95", "diff_rms", "valid_fraction")
    names = ["mean", "std", "rms", "abs_p95", "diff_rms", "valid_fraction"]
    return long.groupBy(segment).agg(*[F.max(F.when(F.col("_channel") == c, F.col(n))).alias(f"{c}_{n}") for c in channels for n in names])


def recording_group(file_id: Column) -> Column:
    """The text before the last `_dataLog_` of a file's id; the whole id without one."""
    return F.when(file_id.contains("_dataLog_"), F.regexp_extract(file_id, r"(?s)^(.*)_dataLog_", 1)).otherwise(file_id)


def measurement_columns(df: DataFrame, reading: str, names: list[str] | None = None) -> DataFrame:
    """df with a column `measurement__name` for each of the names, in order, in place of the map. Without names, those of all rows by name:
    one job finds them, and a map is thought of as having some thousands of names at most."""
    if names is None:
        names = [r[0] for r in df.select(F.explode(F.map_keys(reading)).alias("n")).distinct().orderBy("n").limit(10_001).collect()]
        if len(names) > 10_000:
            raise ValueError("more than 10,000 measurements; name those that are wanted")
    return df.select(*[c for c in df.columns if c != reading], *[F.try_element_at(reading, F.lit(n)).alias(f"measurement__{n}") for n in names])
