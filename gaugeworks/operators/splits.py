"""Time splits, walk-forward folds and hashed folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.ranking import global_rank, group_rank, running_sums
from gaugeworks.functions.times import time_beside


def _boundaries(df: DataFrame, ts: str, positions: list[int]) -> list:
    """The time at each position in time order (from 0), by one pass over running counts of distinct times."""
    times = running_sums(df.groupBy(ts).agg(F.count("*").alias("n")), [F.asc(ts)], {"upto": "n"})
    return list(times.agg(*[F.min(F.when(F.col("upto") > p, F.col(ts))) for p in positions]).first())


def time_holdout(df: DataFrame, ts: str, train_size: int) -> DataFrame:
    """Adds split: train before the time at position train_size, test from it on; equal times stay together in test."""
    (at,) = _boundaries(df, ts, [train_size])
    return df.withColumn("split", F.lit("train") if at is None else F.when(F.col(ts) < time_beside(df, ts, at), "train").otherwise("test"))


def walk_forward(df: DataFrame, ts: str, initial: float = 0.55, folds: int = 4) -> DataFrame:
    """Rows (fold, role, ...): each fold is fitted on all before its block. Blocks begin at a time, never within equal times."""
    n = df.count()
    first = int(n * initial)
    cuts = [int(first + (n - first) * i / folds) for i in range(folds)]
    times = _boundaries(df, ts, cuts)
    if len(set(times)) < folds or None in times or not df.where(F.col(ts) < time_beside(df, ts, times[0])).take(1):
        raise ValueError("too few distinct times for these folds")
    # One scan: each row is handed to the folds that hold it. Rows without a time belong to the last block alone.
    role = lambda at: F.when(F.col(ts) < time_beside(df, ts, at), "train").otherwise("test").alias("role")
    until = [F.col(ts) < time_beside(df, ts, at) for at in times[1:]] + [F.lit(True)]
    held = F.array(*[F.when(end, F.struct(F.lit(k).alias("fold"), role(at))) for k, (at, end) in enumerate(zip(times, until, strict=True), 1)])
    return df.select(F.inline(F.array_compact(held)), "*")


def stratified_folds(df: DataFrame, id_col: str, label: str, k: int = 5, repeats: int = 5, seed: int = 20260822) -> DataFrame:
    """Adds repeat and fold: within a label, rows in the order of md5(seed, repeat, id) are dealt in turn."""
    rep = df.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("repeat").cast("string"), F.col(id_col).cast("string")).cast("binary"))
    ranked = group_rank(rep.withColumn("_place", place), ["repeat", label], F.asc("_place"), F.asc(id_col), name="fold")
    return ranked.withColumn("fold", ((F.col("fold") - 1) % k).cast("int")).drop("_place", "_n")


def group_disjoint(train: DataFrame, test: DataFrame, group: str) -> DataFrame:
    return train.join(test.select(group).distinct(), group, "left_anti")


def overlap(train: DataFrame, test: DataFrame, group: str, split: str) -> DataFrame:
    return train.join(test.select(group).distinct(), group, "left_semi").groupBy(split).agg(F.count("*").alias("n"))


def inner_split(df: DataFrame, ts: str, share: float = 0.8) -> DataFrame:
    """Adds part: fit for the first share of the rows in time order, calibrate for the rest; equal times stay together in the latter."""
    (at,) = _boundaries(df, ts, [int(df.count() * share)])
    return df.withColumn("part", F.lit("fit") if at is None else F.when(F.col(ts) < time_beside(df, ts, at), "fit").otherwise("calibrate"))


def skip_reasons(folds: DataFrame, label: str = "label", least: int = 2) -> DataFrame:
    """By fold of walk_forward: why it can't be scored (null: it can), the first of: the training rows have one class, a class
    has fewer than `least` of them, the test rows have no positive."""
    has = lambda role, y: F.count_if((F.col("role") == role) & (F.col(label) == y))
    c = folds.groupBy("fold").agg(has("train", 0).alias("n0"), has("train", 1).alias("n1"), has("test", 1).alias("t1"))
    rarest = F.least("n0", "n1")
    return c.select("fold", F.when(rarest == 0, "TRAIN_SINGLE_CLASS").when(rarest < least, "TRAIN_CLASS_SUPPORT_BELOW_CV_SPLITS").when(F.col("t1") == 0, "VALIDATION_NO_FAIL").alias("skip_reason"))


def bootstrap_draws(ids: DataFrame, id_col: str, replicates: int, seed: int = 1) -> DataFrame:
    """Rows (rep, i, id): n draws with replacement for each replicate, from positions in the order of ids."""
    n = ids.count()
    at = global_rank(ids.select(id_col), F.asc(id_col)).select(id_col, (F.col("rank") - 1).alias("position"))
    draws = ids.sparkSession.range(replicates * n).select(F.floor(F.col("id") / n).alias("rep"), (F.col("id") % n).alias("i"))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.col("i").cast("string")).cast("binary"))
    draws = draws.withColumn("position", F.conv(F.substring(key, 1, 15), 16, 10).cast("long") % n)
    return draws.join(at, "position").select("rep", "i", id_col)
