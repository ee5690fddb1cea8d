import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import feeds


def times(spark, text: list[str], **more):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "i int, t string").withColumn("ts", F.to_timestamp("t"))
    for name, value in more.items():
        df = df.withColumn(name, F.lit(value))
    return df


def test_power_names_ambiguous_times_and_keeps_nulls(spark):
    df = spark.createDataFrame([("a", "2024-03-31 02:30:00", 1.0), ("a", "2024-10-27 02:30:00", 1.0), ("a", "2024-06-01 12:00:00", None), ("a", "2024-06-01 13:00:00", float("inf")), ("a", "2024-06-01 14:00:00", 2500.0)], "k string, t string, w double")
    got = feeds.power(df.withColumn("ts", F.to_timestamp("t")), "k", "ts", "w", "Europe/Paris", "W").orderBy("t").collect()
    assert [r["reasons"] for r in got] == [["time_missing_or_ambiguous"], [], ["value_not_finite"], [], ["time_missing_or_ambiguous"]]
    assert got[1]["power_kw"] is None and got[3]["power_kw"] == 2.5 and str(got[3]["ts_utc"]) == "2024-06-01 12:00:00"


@pytest.mark.parametrize("day,drop,copy,accepted", [
    ("2024-06-01", 0, 0, True), ("2024-06-01", 1, 0, False), ("2024-03-31", 0, 4, True), ("2024-03-31", 0, 0, False), ("2024-10-27", 4, 0, True), ("2024-10-27", 0, 0, False),
])
def test_day_shape(spark, day, drop, copy, accepted):
    df = spark.range(96 - drop).select((F.to_timestamp(F.lit(day)) + F.make_dt_interval(mins=F.col("id").cast("int") * 15)).alias("ts"), F.lit(1.0).alias("x"))
    df = df.union(df.orderBy("ts").limit(copy)) if copy else df
    row = feeds.day_shape(df, "ts", "Europe/Paris", ["x"]).first()
    assert row["accepted"] is accepted and row["copies"] == copy and row["missing"] == drop
    if copy:
        assert feeds.day_shape(df.withColumn("x", F.rand(1)), "ts", "Europe/Paris", ["x"]).first()["accepted"] is False


def test_versions(spark):
    df = times(spark, ["2024-01-01 00:30:00", "2024-01-01 00:30:00", "2024-01-01 01:00:00"]).withColumn("up", F.col("ts") + F.make_dt_interval(hours=F.col("i"))).withColumn("x", F.lit(1.0)).withColumn("g", F.lit(0))
    checked = feeds.versioned_estimates(df, "g", "ts", "up", "x")
    assert checked.where(F.size("reasons") > 0).count() == 0
    assert feeds.revision_counts(checked, "g", "ts").first().asDict() == {"g": 0, "n_rows": 3, "intervals": 2, "revised_intervals": 1, "rows_beyond_first": 1}


def test_status_folding(spark):
    df = spark.createDataFrame([("Données Définitives",), ("CONSOLIDÉES",), ("autre",), (None,)], "t string")
    assert [r[0] for r in df.select(feeds.revision_status(F.col("t"))).collect()] == ["definitive", "consolidated", None, None]


def test_fill_days_prefers_the_latest_known_value(spark):
    df = times(spark, ["2024-01-01 00:00:00", "2024-01-01 00:10:00", "2024-01-01 00:20:00", "2024-01-01 23:30:00"], k="a").withColumn("x", F.when(F.col("i") != 2, F.col("i")))
    got = feeds.fill_days(df, "k", "ts", "x").orderBy("slot").collect()
    assert len(got) == 48 and got[0]["value"] == 1 and got[47]["value"] == 3 and sum(r["value"] is None for r in got) == 46


def test_empty_feeds(spark):
    df = spark.createDataFrame([], "k string, ts timestamp, x double, p double")
    assert feeds.energy(df, "k", "ts", "x", "p").count() == 0 and feeds.fill_days(df, "k", "ts", "x").count() == 0 and feeds.steps(df, "k", "ts", 1800).count() == 0
