"""Registered queries of the feed contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.operators import feeds
from gaugeworks.plans.registry import query, rounded, table


def slotted(df, seconds: int):
    """Adds slot: ts moved down to a multiple of seconds."""
    return df.withColumn("slot", F.timestamp_seconds(F.floor(feeds.micros("ts") / (seconds * 1_000_000)) * seconds))


VERSIONS = """v AS (SELECT user_id, value - 5 AS x, CASE WHEN event_id % 50 = 0 THEN epoch_us(ts) ELSE epoch_us(ts) // 1800000000 * 1800000000 END AS i, epoch_us(ts) - CASE WHEN event_id % 40 = 0 THEN 86400000000 ELSE 0 END AS u FROM events),
c AS (SELECT user_id, i, list_filter([CASE WHEN x < 0 THEN 'negative_estimate' END, CASE WHEN i % 1800000000 <> 0 THEN 'interval_not_aligned' END, CASE WHEN u < i THEN 'updated_before_end' END,
  CASE WHEN count(*) OVER (PARTITION BY user_id, i, u) > 1 THEN 'duplicate_revision' END], lambda r: r IS NOT NULL) AS reasons FROM v)"""


def versions(spark, d):
    e = slotted(table(spark, d, "events"), 1800).withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withColumn("interval_end", F.when(F.col("event_id") % 50 == 0, F.col("ts")).otherwise(F.col("slot")))
    e = e.withColumn("updated", F.when(F.col("event_id") % 40 == 0, F.col("ts") - F.expr("interval 1 day")).otherwise(F.col("ts"))).withColumn("value", F.col("value") - 5)
    return feeds.versioned_estimates(e, "user_id", "interval_end", "updated", "value")


@query(f"WITH {VERSIONS} SELECT array_to_string(reasons, ',') AS reasons, count(*) AS n FROM c GROUP BY 1")
def con_versioned_reasons(spark, d):
    return versions(spark, d).groupBy(F.array_join("reasons", ",").alias("reasons")).agg(F.count("*").alias("n"))


@query(f"WITH {VERSIONS}, t AS (SELECT user_id, i, count(*) AS n FROM c WHERE len(reasons) = 0 GROUP BY ALL) SELECT user_id, sum(n)::BIGINT AS n_rows, count(*) AS intervals, count_if(n > 1)::BIGINT AS revised_intervals, sum(n - 1)::BIGINT AS rows_beyond_first FROM t GROUP BY 1")
def con_revision_counts(spark, d):
    return feeds.revision_counts(versions(spark, d).where(F.size("reasons") == 0), "user_id", "interval_end")


@query("""WITH q AS (SELECT user_id, epoch_us(ts) // 900000000 AS s, CASE WHEN (epoch_us(ts) // 900000000) % 2 = 0 THEN value - 2 WHEN event_id % 100 = 0 THEN value END AS x FROM events),
c AS (SELECT user_id, s % 2 = 1 AS structural, s % 2 = 1 AND x IS NOT NULL AS a, s % 2 = 0 AND x IS NULL AS b, s % 2 = 0 AND x < 0 AS c, count(*) OVER (PARTITION BY user_id, s) > 1 AS d FROM q)
SELECT user_id, count(*) AS n_rows, count_if(structural)::BIGINT AS structural_rows, count_if(a)::BIGINT AS structural_values, count_if(b)::BIGINT AS missing, count_if(coalesce(c, false))::BIGINT AS negative, count_if(d)::BIGINT AS duplicates FROM c GROUP BY 1""")
def con_quarter_hours(spark, d):
    e = slotted(table(spark, d, "events"), 900)
    half = F.unix_seconds("slot") % 1800 == 0
    e = e.withColumn("value", F.when(half, F.col("value") - 2).when(F.col("event_id") % 100 == 0, F.col("value")))
    has = lambda r: F.count_if(F.array_contains("reasons", r))
    return feeds.quarter_hours(e, "user_id", "slot", "value").groupBy("user_id").agg(
        F.count("*").alias("n_rows"), F.count_if("structural").alias("structural_rows"), has("structural_value").alias("structural_values"), has("value_missing").alias("missing"),
        has("negative").alias("negative"), has("duplicate_time").alias("duplicates"),
    )


@query("""SELECT CASE o_orderstatus WHEN 'F' THEN 'definitive' WHEN 'O' THEN 'consolidated' END AS status, count(*) AS n FROM orders GROUP BY 1""")
def con_revision_status(spark, d):
    text = F.when(F.col("o_orderstatus") == "F", "Données Définitives").when(F.col("o_orderstatus") == "O", "CONSOLIDÉES").when(F.col("o_orderstatus") == "P", "Temps réel")
    return table(spark, d, "orders").groupBy(feeds.revision_status(text).alias("status")).agg(F.count("*").alias("n"))


@query("""WITH h AS (SELECT event_type, ts::DATE AS day, count(DISTINCT CASE WHEN event_id % 10 <> 0 THEN epoch_us(ts) // 1800000000 END) AS known FROM events GROUP BY ALL)
SELECT event_type, strftime(day, '%Y-%m-%d') AS day, 48::BIGINT AS slots, known, 48 - known AS empty FROM h""")
def con_fill_days(spark, d):
    e = table(spark, d, "events").withColumn("value", F.when(F.col("event_id") % 10 != 0, F.col("value")))
    out = feeds.fill_days(e, "event_type", "ts", "value").groupBy("event_type", F.col("day").cast("string").alias("day"))
    return out.agg(F.count("*").alias("slots"), F.count("value").alias("known"), (F.count("*") - F.count("value")).alias("empty"))


@query("""WITH e AS (SELECT user_id, epoch_us(ts) // 1800000000 AS s, CASE WHEN event_type = 'error' THEN NULL ELSE value - 3 END AS wh, CASE WHEN event_id % 30 = 0 THEN 0.5 ELSE event_id % 9 END AS points FROM events),
c AS (SELECT *, count(*) OVER (PARTITION BY user_id, s) = 1 AND coalesce(wh >= 0, true) AND points = floor(points) AS ok FROM e),
g AS (SELECT *, s - lag(s) OVER (PARTITION BY user_id ORDER BY s) AS step FROM c WHERE ok)
SELECT user_id, count(*) AS n_rows, count_if(coalesce(step <> 1, false))::BIGINT AS broken_steps, count_if(wh IS NULL)::BIGINT AS missing_energy, round(avg(wh * 2), 6) AS mean_power_w FROM g GROUP BY 1""")
def con_energy(spark, d):
    e = slotted(table(spark, d, "events"), 1800)
    e = e.withColumn("wh", F.when(F.col("event_type") != "error", F.col("value") - 3)).withColumn("points", F.when(F.col("event_id") % 30 == 0, 0.5).otherwise(F.col("event_id") % 9))
    good = feeds.energy(e, "user_id", "slot", "wh", "points").where(F.size("reasons") == 0)
    known = good.groupBy("user_id").agg(F.count_if(F.col("wh").isNull()).alias("missing_energy"), F.avg("mean_power_w").alias("mean_power_w"))
    return rounded(feeds.steps(good, "user_id", "slot", 1800).join(known, "user_id"))


@query("""WITH m AS (SELECT user_id, event_type, event_id, value, CASE WHEN event_id % 40 <> 0 THEN date_trunc('minute', ts) END AS t FROM events),
e AS (SELECT *, t IS NOT NULL AND count(*) OVER (PARTITION BY user_id, t) > 1 AS twice, epoch_us(t) - max(epoch_us(t)) OVER (PARTITION BY user_id ORDER BY epoch_us(t) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS step FROM m)
SELECT event_type, concat_ws(',', CASE WHEN t IS NULL THEN 'time_not_readable' END, CASE WHEN value < 1 THEN 'power_not_valid' END, CASE WHEN event_id % 3 = 2 THEN 'flag_not_valid' END, CASE WHEN twice THEN 'time_repeated' END,
  CASE WHEN step <> 3600000000 THEN 'hour_gap' END) AS reasons, count(*) AS n FROM e GROUP BY ALL""")
def con_modelled_hours(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", (F.col("value") - 1).alias("power"), (F.col("event_id") % 3).alias("flag"), F.when(F.col("event_id") % 40 == 0, "20240230:xx").otherwise(F.date_format("ts", "yyyyMMdd:HHmm")).alias("time"))
    return feeds.modelled_hours(e, "time", ["power"], "flag", "user_id").groupBy("event_type", F.array_join("reasons", ",").alias("reasons")).agg(F.count("*").alias("n"))


@query("""WITH h AS (SELECT event_type, year(ts) AS year, epoch_us(ts) // 3600000000 AS hour, count(*) AS n, min(user_id % 1000 < 500) AS a, max(user_id % 1000 < 500) AS b, sum(value * 10000 / 3600) AS s, count(value) AS k FROM events GROUP BY ALL)
SELECT event_type, year::INT AS year, count(*) AS seen, count_if(n > 1)::BIGINT AS repeated, min(a) = max(b) AS one_name, round(sum(s) / sum(k), 6) AS mean_wm2,
  (CASE WHEN year % 4 = 0 AND (year % 100 <> 0 OR year % 400 = 0) THEN 8784 ELSE 8760 END)::BIGINT AS expected, count(*) = expected AND count_if(n > 1) = 0 AND min(a) = max(b) AS complete FROM h GROUP BY event_type, year""")
def con_station_years(spark, d):
    e = table(spark, d, "events").withColumn("name", (F.col("user_id") % 1000 < 500).cast("string"))
    return rounded(feeds.station_years(e, "event_type", "name", "ts", "value"))


@query("""WITH t AS (SELECT event_type, event_id % 97 = 0 AS a, event_type = 'click' AS b, ts::DATE AS day, user_id % 2 AS s FROM events), c AS (SELECT *, min(s) OVER (PARTITION BY day, event_type) <> max(s) OVER (PARTITION BY day, event_type) AS m FROM t)
SELECT event_type, count_if(a)::BIGINT AS equipment_differs, count_if(b)::BIGINT AS unit_differs, count_if(m)::BIGINT AS several_streams FROM c GROUP BY 1""")
def con_traces(spark, d):
    e = table(spark, d, "events").withColumn("equipment", F.col("user_id") + (F.col("event_id") % 97 == 0).cast("int")).withColumn("unit", F.when(F.col("event_type") == "click", "mm").otherwise("um"))
    e = e.withColumn("stream", F.col("user_id") % 2).withColumn("batch", F.struct(F.to_date("ts"), "event_type"))
    has = lambda r: F.count_if(F.array_contains("reasons", r)).alias(r)
    return feeds.traces(e, "user_id", "equipment", "unit", "um", ["stream"], "batch").groupBy("event_type").agg(*map(has, ("equipment_differs", "unit_differs", "several_streams")))


@query("""WITH p AS (SELECT DISTINCT o_custkey, o_orderstatus FROM orders), m AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) > 1 AS shared FROM p)
SELECT o_orderstatus, count(*) AS n_groups, count_if(shared)::BIGINT AS shared_groups, false AS as_expected FROM m GROUP BY 1""")
def con_roles(spark, d):
    return feeds.roles(table(spark, d, "orders"), "o_custkey", "o_orderstatus", {"F": 1, "O": 1})


@query("""SELECT count(*) AS n_rows, count_if(l_quantity < 5 OR l_quantity > 45)::BIGINT AS bad_quantity, count_if(l_discount > 0.05)::BIGINT AS bad_discount FROM lineitem""")
def con_ranges(spark, d):
    out = feeds.with_reasons(table(spark, d, "lineitem"), feeds.range_rules({"l_quantity": (5, 45), "l_discount": (None, 0.05)}))
    has = lambda c: F.count_if(F.array_contains("reasons", f"{c}_not_valid"))
    return out.agg(F.count("*").alias("n_rows"), has("l_quantity").alias("bad_quantity"), has("l_discount").alias("bad_discount"))
