"""Statistical process control over many series at once."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.ranking import global_rank
from gaugeworks.operators.contracts import screening_input
from gaugeworks.operators.review import evidence_digest, review_identity

#: Bias of the mean moving range of two; order of review.
D2 = 1.128
TIERS = {"baseline_review_required": (0, "BLOCKED_BASELINE"), "above_limit": (1, "P1_LIMIT_SIGNAL"), "below_limit": (1, "P1_LIMIT_SIGNAL"), "unknown": (2, "P2_EVIDENCE_GAP")}


def individuals_limits(df: DataFrame, key: str, order: list[str], value: str = "value", baseline: int = 10) -> DataFrame:
    """Frozen limits of each series from its first rows. Only those rows are sorted: the rank filter is applied before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    first = df.select(key, *order, value).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= baseline)
    first = first.withColumn("mr", F.abs(F.col(value) - F.lag(value).over(w)))
    out = first.groupBy(key).agg(F.count("*").alias("n"), F.count(value).alias("known"), F.avg(value).alias("center"), F.avg("mr").alias("mr"), F.min(value).alias("low"), F.max(value).alias("high"))
    half = F.col("mr") * 3 / D2
    out = out.withColumn("ucl", F.col("center") + half).withColumn("lcl", F.col("center") - half)
    total = df.groupBy(key).agg(F.count("*").alias("total"))
    state = F.when((F.col("n") < baseline) | (F.col("total") <= baseline), "baseline_too_short").when(F.col("known") < F.col("n"), "baseline_missing_value").when(~(F.col("mr") > 0), "no_variation").otherwise("valid")
    return out.join(total, key).select(key, "center", "lcl", "ucl", ((F.col("low") < F.col("lcl")) | (F.col("high") > F.col("ucl"))).alias("suspect"), state.alias("baseline_state"))


def status(value: Column) -> Column:
    return (
        F.when(value.isNull(), "unknown").when(F.col("suspect"), "baseline_review_required").when(value < F.col("lcl"), "below_limit")
        .when(value > F.col("ucl"), "above_limit").otherwise("within_limits")
    )


def individuals_chart(df: DataFrame, key: str, order: list[str], value: str = "value", baseline: int = 10) -> DataFrame:
    limits = individuals_limits(df, key, order, value, baseline).where(F.col("baseline_state") == "valid")
    return df.join(limits, key).withColumn("status", status(F.col(value)))


def review_queue(chart: DataFrame, key: str, sample: str, value: str = "value", source: str = "events") -> DataFrame:
    """Rows that need review: severity beyond the limit in widths of the limit, class, id."""
    v = F.col(value)
    severity = F.when(F.col("status") == "above_limit", (v - F.col("ucl")) / (F.col("ucl") - F.col("center"))).when(F.col("status") == "below_limit", (F.col("lcl") - v) / (F.col("center") - F.col("lcl")))
    tier = F.create_map(*[F.lit(x) for k, (t, _) in TIERS.items() for x in (k, t)])
    name = F.create_map(*[F.lit(x) for k, (_, n) in TIERS.items() for x in (k, n)])
    out = chart.where(F.col("status") != "within_limits").withColumn("severity", severity)
    review = F.substring(F.sha2(F.concat_ws(":", F.lit(source), F.col(sample).cast("string"), F.col(key).cast("string")), 256), 1, 24)
    return out.select(key, sample, "ts", value, "status", "severity", tier[F.col("status")].alias("tier"), name[F.col("status")].alias("priority"), review.alias("review_id"))


def against_range(df: DataFrame, ranges: DataFrame, key: str, value: str) -> DataFrame:
    """Measurements against specification ranges (a small table): missing, within or outside, and the distance to the nearer limit."""
    v, out = F.col(value), df.join(ranges, key, "left")
    state = F.when(F.col("low").isNull(), "waiting").when(v.isNull(), "missing").when(v.between(F.col("low"), F.col("high")), "within").otherwise("outside")
    return out.withColumn("state", state).withColumn("distance", F.round(F.greatest(F.col("low") - v, v - F.col("high"), F.lit(0.0)), 2))


def review_package(chart: DataFrame, key: str, sample: str, measurement: str, source_sha: Column, value: str = "value") -> DataFrame:
    """review_queue whose ids are tied to the bytes of the source, the sample and the measurement, with the digest of each row's evidence
    (sample, time, measurement, value, series) and its place in the order of review: tier, severity, time, id."""
    named = chart.withColumn("measurement", F.lit(measurement)).withColumn("source_sha256", source_sha)
    fields = [sample, "ts", "measurement", value, key]
    rows = named.select("*", evidence_digest(fields).alias("evidence_sha256"), review_identity(F.col("source_sha256"), F.col(sample), F.col("measurement")).alias("_id"))
    queue = review_queue(rows, key, sample, value).drop("review_id")
    queue = queue.join(rows.select(key, sample, "measurement", "source_sha256", "evidence_sha256", F.col("_id").alias("review_id")), [key, sample])
    return global_rank(queue.withColumn("_severity", -F.coalesce("severity", F.lit(0.0))), F.asc("tier"), F.asc("_severity"), F.asc("ts"), F.asc("review_id"), name="place").drop("_severity")


def screen(df: DataFrame, stream: list[str], position: str, ts: str, value: str, baseline: int = 10) -> tuple[DataFrame, DataFrame]:
    """(pending queue, refused rows with reasons) of an equipment's export. A stream with any row against the contract is refused whole;
    of the others, each row outside its limits, without a value or with a suspect baseline waits as pending."""
    checked = screening_input(df, stream, position, ts, value).withColumn("_stream", F.concat_ws("|", *stream))
    bad = checked.where(F.size("reasons") > 0)
    good = checked.join(bad.select("_stream").distinct(), "_stream", "left_anti")
    chart = individuals_chart(good.select("_stream", *stream, position, ts, F.col("number").alias("value")), "_stream", [position], "value", baseline)
    pending = chart.where(F.col("status") != "within_limits").select(*stream, position, ts, "value", "status", F.lit("pending").alias("state"))
    return pending, bad.drop("_stream", "number")
