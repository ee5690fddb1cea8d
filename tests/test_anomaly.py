import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import anomaly, evaluate, models
from gaugeworks.plans import registry, scoring


def rows(spark, n=600, odd=20):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (n, 3))
    x[:odd] += 6
    return spark.createDataFrame([(i, int(i < odd), *map(float, r)) for i, r in enumerate(x)], "id int, label int, a double, b double, c double")


def test_isolation_forest_finds_odd_rows_and_repeats(spark):
    df = rows(spark)
    train = df.where("label = 0")
    out = anomaly.isolation_forest(train, df, ["a", "b", "c"], "id", trees=40, sample=64)
    assert evaluate.roc_auc(out).first()[0] > 0.99
    first, again = ({r["id"]: r["score"] for r in o.collect()} for o in (out, anomaly.isolation_forest(train.repartition(5), df, ["a", "b", "c"], "id", trees=40, sample=64)))
    assert first == again and all(0 < s < 1 for s in first.values())


def test_samples_are_full_and_trees_keep_every_row(spark):
    df = rows(spark)
    drawn = anomaly.samples(df, "id", 10, 64, 1)
    assert {r["count"] for r in drawn.groupBy("tree").count().collect()} == {64}
    leaves = anomaly.grow(drawn, ["a", "b", "c"], "id", 64, 1).where("feature < 0").groupBy("tree").agg(F.sum("size").alias("n")).collect()
    assert {r["n"] for r in leaves} == {64}


def test_missing_values_and_empty_tables(spark):
    df = rows(spark, 50, 0)
    holes = df.withColumn("a", F.when(F.col("id") % 2 == 0, F.col("a"))).withColumn("b", F.when(F.col("id") == 1, float("nan")).otherwise(F.col("b")))
    assert anomaly.isolation_forest(holes, holes, ["a", "b"], "id", trees=5, sample=16).where("score is null or isnan(score)").count() == 0
    assert anomaly.isolation_forest(df, df.limit(0), ["a"], "id", trees=5, sample=16).count() == 0
    with pytest.raises(ValueError):
        anomaly.isolation_forest(df.limit(0), df, ["a"], "id")


def test_stability_evidence_and_priority(spark):
    imp = spark.createDataFrame([(0, "a", 3.0, 1.0), (0, "b", 2.0, -1.0), (1, "b", 5.0, 1.0), (1, "a", 1.0, 1.0), (1, "c", 0.5, None)], "fold int, feature string, importance double, signed double")
    got = {r["feature"]: r for r in models.stability(imp, 2, first=2).collect()}
    assert set(got) == {"a", "b"} and got["a"]["median_rank"] == 1.5 and got["b"]["positive_sign_rate"] == 0.5 and got["a"]["top_rate"] == 1.0
    df = spark.createDataFrame([("x", 0.5, 1.0, -3.0, None), ("y", 0.5, 0.0, 1.0, 9.0), ("z", 0.9, 1.0, 1.0, 1.0)], "id string, score double, a double, b double, c double")
    assert models.evidence(df, {"a": 2.0, "b": 1.0, "c": 1.0}, 2).where("id = 'x'").first()["suggested"] == ["b", "a"]
    assert [(r["id"], r["rank"], r["prediction"]) for r in models.priority_table(df, "id", 0.6).orderBy("rank").collect()] == [("z", 1, 1), ("x", 2, 0), ("y", 3, 0)]


def vectors(spark, tmp_path):
    """64 components; only the last tells class 3, and rows 0 and 1 differ in it alone."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (400, 64))
    x[:, 63] += 12 * (np.arange(400) % 4 == 3)
    x[0], x[1] = x[2], x[2]
    x[1, 63] = 40
    rows = [(i, i % 4, [float(v) for v in r]) for i, r in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def test_isolation_uses_all_components(spark, tmp_path):
    got = {r["vec_id"]: r["score"] for r in scoring.mod_isolation(spark, vectors(spark, tmp_path)).collect()}
    assert len(got) == 400 and got[0] == got[2] and got[1] > got[2]


def test_logistic_scores_use_all_components_and_all_rows(spark, tmp_path):
    out = registry.mod_logistic_scores(spark, vectors(spark, tmp_path)).cache()
    assert out.count() == 400 and 0 < out.where("held_out").count() < 150
    assert evaluate.average_precision(out.where("held_out")).first()[0] > 0.95
