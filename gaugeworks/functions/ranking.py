"""Exact ranks, running sums and quantiles over a whole table without sorting it in one task."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def saved(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a table in the shared folder of spark.checkpoint.dir. Unset, it is a temporary one for a session of one process and an error on a cluster."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-gaugeworks-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/gaugeworks/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def global_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Adds 1 .. n in the given order: ranges are sorted apart, and each starts where the counts before it end."""
    at = F.monotonically_increasing_id()
    part = saved(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at))
    part = part.withColumn("_part", F.shiftright("_at", 33))
    counts = part.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    start = counts.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return part.join(F.broadcast(start.drop("_n")), "_part").withColumn(name, rank).drop("_at", "_part", "_start")


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Adds, by name, the sum of a column over all rows up to each one in the given order (of distinct values): ranges are summed
    apart, and each starts at the totals before it."""
    part = saved(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = part.groupBy("_part").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])  # a row for each partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    run = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return part.join(F.broadcast(totals), "_part").select(*df.columns, *[(F.col(f"_{n}") + F.sum(c).over(run)).alias(n) for n, c in sums.items()])


def group_rank(df: DataFrame, keys: list[str], *order: Column, name: str = "rank") -> DataFrame:
    """Adds 1 .. n within each group, and the group's n as _n, without bringing a group into one task."""
    ranked = global_rank(df, *[F.asc(k) for k in keys], *order, name=name)
    groups = ranked.groupBy(*keys).agg(F.min(name).alias("_first"), F.count("*").alias("_n"))
    other = groups.toDF(*[f"_{k}" for k in keys], "_first", "_n")
    return ranked.join(other, [ranked[k].eqNullSafe(other[f"_{k}"]) for k in keys]).withColumn(name, F.col(name) - F.col("_first") + 1).drop("_first", *[f"_{k}" for k in keys])


#: Ranks that are looked up together.
RANKS = 65_536


def exact_quantiles(df: DataFrame, by: str, value: str, shares: list[float]) -> DataFrame:
    """Rows (by, quantiles array): linear between neighbours, of the values that are not null. Equal values are counted before they are
    laid in order, and a group's values meet its ranks by blocks of ranks: neither a group nor a frequent value comes into one task."""
    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("_by"), F.col(value).alias("_value")).agg(F.count("*").alias("_count"))
    rows = running_sums(counted, [F.asc("_by"), F.asc("_value")], {"_end": "_count"}).withColumn("_start", F.col("_end") - F.col("_count"))
    groups = rows.groupBy("_by").agg(F.min("_start").alias("_first"), F.sum("_count").alias("_n"))
    place = [F.lit(float(s)) * (F.col("_n") - 1) for s in shares]
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in place])))
    block = lambda x: F.floor(x / RANKS)
    blocks = F.explode(F.sequence(block(F.col("_first")), block(F.col("_first") + F.col("_n") - 1)))
    asked = groups.select(F.col("_by").alias("_of"), "_first", "_n", wanted.alias("_wanted"), blocks.alias("_block"))
    rows = rows.withColumn("_in", block(F.col("_start")))
    met = rows.join(asked, F.col("_by").eqNullSafe(F.col("_of")) & (F.col("_in") == F.col("_block")))
    here = F.filter("_wanted", lambda p: (p >= F.col("_start") - F.col("_first")) & (p < F.col("_end") - F.col("_first")))
    found = met.select("_by", "_n", F.col("_value").cast("double").alias("_x"), F.explode(here).alias("_at")).groupBy("_by", "_n").agg(F.map_from_entries(F.collect_list(F.struct("_at", "_x"))).alias("_found"))
    at = lambda p: F.element_at("_found", p)
    return found.select(F.col("_by").alias(by), F.array(*[at(F.floor(p)) + (at(F.ceil(p)) - at(F.floor(p))) * (p - F.floor(p)) for p in place]).alias("quantiles"))


def column_quantiles(df: DataFrame, columns: list[str], share: float = 0.5) -> dict[str, float | None]:
    """Each column's exact quantile over its values that are not null, as a number (null: no value). A row for each column comes back."""
    tall = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_x")) for i, c in enumerate(columns)])))
    found = {r["_c"]: r["quantiles"][0] for r in exact_quantiles(tall, "_c", "_x", [share]).collect()}
    return {c: found.get(i) for i, c in enumerate(columns)}


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows, by a top-n of each partition."""
    return df.orderBy(*order).limit(n)
