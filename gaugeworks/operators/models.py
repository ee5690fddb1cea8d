"""Risk models over pyspark.ml: candidates, selection by cross-validated average precision, walk-forward, calibration."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.ranking import global_rank, saved
from gaugeworks.operators import splits
from gaugeworks.operators.evaluate import average_precision, calibration, classification_metrics, hashed_uniform, poisson_interval, roc_auc, top_k
from gaugeworks.sources.sinks import guard_target, load_model, publish, rows_digest


def candidates(n: int, features: list[str]) -> dict[str, Pipeline]:
    """L1 logistic regression over a grid of C, and two forests; n: training rows."""
    base = dict(featuresCol="x", labelCol="label", weightCol="weight")
    found = {f"l1_C{c:g}": LogisticRegression(elasticNetParam=1.0, regParam=1 / (c * max(n, 1)), standardization=False, **base) for c in (0.01, 0.1, 1.0)}
    for depth, leaf in ((8, 4), (30, 8)):
        found[f"forest_d{depth}_l{leaf}"] = RandomForestClassifier(numTrees=120, maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy="sqrt", seed=20260822, **base)
    return {k: Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="x"), m]) for k, m in found.items()}


def balanced(df: DataFrame) -> DataFrame:
    """Adds weight: rows / (2 * rows of the label)."""
    n = {r["label"]: r["n"] for r in df.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(n.values())
    return df.withColumn("weight", F.when(F.col("label") == 1, total / (2 * max(1, n.get(1, 0)))).otherwise(total / (2 * max(1, n.get(0, 0)))))


def score(model: PipelineModel, df: DataFrame, id_col: str = "id", keep: list[str] | None = None) -> DataFrame:
    return model.transform(df).select(id_col, "label", *(keep or []), vector_to_array("probability")[1].alias("score"))


def cross_validate(df: DataFrame, features: list[str], names: list[str], folds: int = 3) -> list[tuple[str, int, float]]:
    """(candidate, fold, average precision); df has a fold column."""
    out = []
    for k in range(folds):
        train, test = balanced(df.where(F.col("fold") != k)).cache(), df.where(F.col("fold") == k)
        pipelines = candidates(train.count(), features)
        for name in names:
            out.append((name, k, average_precision(score(pipelines[name].fit(train), test)).first()[0]))
        train.unpersist()
    return out


def select(df: DataFrame, features: list[str], names: list[str], folds: int = 3) -> tuple[str, PipelineModel]:
    """The candidate of the highest mean average precision, a fold without one counting 0, and its fit on all rows. Of equal ones
    the first of names is taken, also where no fold has a positive."""
    found = cross_validate(df, features, names, folds)
    best = max(names, key=lambda n: sum(a or 0 for c, _, a in found if c == n))
    whole = balanced(df)
    return best, candidates(whole.count(), features)[best].fit(whole)


def platt(scores: DataFrame) -> PipelineModel:
    """Sigmoid calibration of a score column on held-back rows."""
    return Pipeline(stages=[VectorAssembler(inputCols=["score"], outputCol="s"), LogisticRegression(featuresCol="s", labelCol="label", regParam=0.0, probabilityCol="calibrated", rawPredictionCol="raw_c", predictionCol="pred_c")]).fit(scores)


def importance(model: PipelineModel, features: list[str]) -> list[tuple[str, float, float | None]]:
    """(feature, importance, signed value) of a fitted candidate, most important first; forests have no sign."""
    fitted = model.stages[-1]
    if hasattr(fitted, "coefficients"):
        rows = [(f, abs(float(c)), float(c)) for f, c in zip(features, fitted.coefficients.toArray(), strict=True)]
    else:
        rows = [(f, float(v), None) for f, v in zip(features, fitted.featureImportances.toArray(), strict=True)]
    return sorted(rows, key=lambda r: (-r[1], r[0]))


def stability(importances: DataFrame, folds: int, first: int = 20) -> DataFrame:
    """By feature over folds, from rows (fold, feature, importance, signed): how often it is among the first, median rank and
    its spread, median importance, share of positive signs."""
    w = Window.partitionBy("fold").orderBy(F.desc("importance"), "feature")  # a fold's features
    ranked = importances.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= first)
    half = lambda p: F.percentile("rank", F.lit(p))
    out = ranked.groupBy("feature").agg(
        F.count_distinct("fold").alias("top_frequency"), half(0.5).alias("median_rank"), (half(0.75) - half(0.25)).alias("rank_iqr"),
        F.percentile("importance", F.lit(0.5)).alias("median_importance"), F.avg((F.col("signed") > 0).cast("int")).alias("positive_sign_rate"),
    )
    return out.withColumn("top_rate", F.col("top_frequency") / folds)


def evidence(df: DataFrame, weights: dict[str, float], first: int = 5) -> DataFrame:
    """Adds suggested: the features with the largest absolute contribution (value times weight) to a row's linear score."""
    parts = F.array(*[F.struct((-F.abs(F.coalesce(F.col(c), F.lit(0.0)) * w)).alias("size"), F.lit(c).alias("feature")) for c, w in weights.items()])
    return df.withColumn("suggested", F.transform(F.slice(F.array_sort(parts), 1, first), lambda x: x["feature"]))


def priority_table(scored: DataFrame, id_col: str, threshold: float) -> DataFrame:
    """Adds rank (score descending, then id as text) and prediction."""
    named = scored.withColumn("_name", F.col(id_col).cast("string"))
    return global_rank(named, F.desc("score"), F.asc("_name")).drop("_name").withColumn("prediction", (F.col("score") >= threshold).cast("int"))


def walk_forward_scores(df: DataFrame, ts: str, features: list[str], names: list[str], folds: int = 4, inner: int = 3, initial: float = 0.55) -> tuple[DataFrame, DataFrame]:
    """(one row for each fold, scores of the folds that could be evaluated). df: id, label, ts, features without nulls.

    In each fold the candidate is selected by cross-validation within the rows before the block and fitted on them, and scores the block.
    A fold whose labels don't allow that is SKIPPED with its reason. Fitting errors are not hidden."""
    parts = splits.walk_forward(df, ts, initial, folds).persist()
    reasons = {r["fold"]: r["skip_reason"] for r in splits.skip_reasons(parts, least=inner).collect()}  # a row for each fold
    rows, scored = [], None
    for k in range(1, folds + 1):
        mine = parts.where(F.col("fold") == k)
        train, test = mine.where("role = 'train'").drop("fold", "role"), mine.where("role = 'test'").drop("fold", "role")
        c = mine.agg(F.count_if(F.col("role") == "train").alias("n"), F.count_if(F.col("role") == "test").alias("m"), F.sum(F.when(F.col("role") == "test", F.col("label"))).alias("fails"), F.min(F.when(F.col("role") == "test", F.col(ts))).alias("a"), F.max(F.when(F.col("role") == "test", F.col(ts))).alias("b")).first()
        row = {"fold": k, "status": "SKIPPED", "skip_reason": reasons.get(k), "candidate": None, "train_rows": c["n"], "test_rows": c["m"], "fails": int(c["fails"] or 0), "test_start": str(c["a"]), "test_end": str(c["b"]), "average_precision": None, "brier": None, "ece": None}
        if reasons.get(k) is None:
            folded = train.withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(inner)))
            best, model = select(folded, features, names, inner)
            s = score(model, test).withColumn("fold", F.lit(k))
            cal = calibration(s).first()
            row |= {"status": "EVALUATED", "candidate": best, "average_precision": average_precision(s).first()[0], "brier": cal["brier"], "ece": cal["ece"]}
            scored = s if scored is None else scored.unionByName(s)
        rows.append(row)
    schema = "fold int, status string, skip_reason string, candidate string, train_rows long, test_rows long, fails long, test_start string, test_end string, average_precision double, brier double, ece double"
    empty = df.select("id", "label", F.lit(0.0).alias("score"), F.lit(0).alias("fold")).limit(0)
    return df.sparkSession.createDataFrame(rows, schema), empty if scored is None else scored


def calibrated_scores(model: PipelineModel, held_back: DataFrame, df: DataFrame) -> DataFrame:
    """Scores of df with a further column `calibrated`, by a sigmoid fitted on the held-back rows' scores."""
    fitted = platt(score(model, held_back))
    return fitted.transform(score(model, df)).select("id", "label", "score", vector_to_array("calibrated")[1].alias("calibrated"))


def verify_selection(manifest: dict, train: DataFrame, features: list[str], known: list[str], id_col: str = "id", label: str = "label") -> None:
    """Raises unless a saved model's manifest names a known candidate, these features in this order, and these training rows."""
    now = train.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(label), F.lit(0)).cast("long").alias("positives"), rows_digest(id_col, label).alias("rows_digest")).first().asDict()
    wrong = [k for k, v in now.items() if manifest[k] != v]
    wrong += ["candidate"] * (manifest["candidate"] not in known) + ["features"] * (list(manifest["features"]) != list(features))
    if wrong:
        raise ValueError(f"the saved model was not made so: {sorted(wrong)} differ")


def refit_selected(manifest: dict, frozen: DataFrame, train: DataFrame, features: list[str], known: list[str], id_col: str = "id", label: str = "label", ts: str = "ts") -> PipelineModel:
    """The manifest's candidate fitted once more on the frozen split, after every row of `train` was found there with its label and time.
    frozen: (id, label, time) of the split, without repeats. Raises, before anything is fitted, if a row is lacking, added, repeated or
    changed, or if the manifest isn't that of these rows and features."""
    verify_selection(manifest, train, features, known, id_col, label)
    mine = train.groupBy(F.col(id_col).alias("_id")).agg(F.count("*").alias("_n"), F.first(label).alias("_label"), F.first(ts).alias("_ts"))
    j = frozen.select(F.col(id_col).alias("_id"), F.lit(1).alias("_known"), F.col(label).alias("_label_then"), F.col(ts).alias("_ts_then")).join(mine, "_id", "full")
    both = F.col("_known").isNotNull() & F.col("_n").isNotNull()
    counts = j.agg(
        F.count_if(F.col("_n").isNull()).alias("missing"), F.count_if(F.col("_known").isNull()).alias("unexpected"), F.count_if(F.col("_n") > 1).alias("repeated"),
        F.count_if(both & ~F.col("_label").eqNullSafe(F.col("_label_then"))).alias("label_changed"), F.count_if(both & ~F.col("_ts").eqNullSafe(F.col("_ts_then"))).alias("time_changed"),
    ).first().asDict()
    if wrong := {k: v for k, v in counts.items() if v}:
        raise ValueError(f"not the frozen split: {wrong}")
    whole = balanced(train.withColumnsRenamed({id_col: "id", label: "label"}))
    return candidates(whole.count(), features)[manifest["candidate"]].fit(whole)


APPROVED = ("features_sha256", "rows_digest", "n_rows", "approved_by", "approved_at")


def _approval_digest() -> Column:
    return F.sha2(F.to_json(F.struct(*APPROVED), {"ignoreNullFields": "false"}), 256)


def approval(manifest: dict, df: DataFrame, approved_by: str, approved_at: str, id_col: str = "id", label: str = "label") -> DataFrame:
    """One row: a data set and a model's features, who approved their evaluation and when, and the digest that binds all of it."""
    row = df.agg(F.count("*").alias("n_rows"), rows_digest(id_col, label).alias("rows_digest"))
    return row.select(F.lit(manifest["features_sha256"]).alias("features_sha256"), "rows_digest", "n_rows", F.lit(approved_by).alias("approved_by"), F.lit(approved_at).alias("approved_at")).withColumn("digest", _approval_digest())


def _declared(approved: DataFrame) -> tuple[dict, str]:
    rows = approved.withColumn("_now", _approval_digest()).limit(2).collect()
    if len(rows) != 1 or rows[0]["_now"] != rows[0]["digest"]:
        raise ValueError("the approval isn't one row that its digest binds")
    return {k: rows[0][k] for k in ("features_sha256", "rows_digest", "n_rows")}, rows[0]["digest"]


def locked_scores(path: str, df: DataFrame, declared: dict | DataFrame, target: str, fractions: list[float], id_col: str = "id", label: str = "label", replicates: int = 2000, seed: int = 20260905) -> dict[str, DataFrame]:
    """One evaluation with a saved model: nothing is fitted or tuned. declared: what was approved, as a table made by `approval` or as
    its values (features_sha256, rows_digest of the data set, n_rows). The target must be absent or empty. Tables, written when all are
    ready: predictions (ranked), metrics (with the approval's digest), budgets, and bootstrap (intervals of capture and precision)."""
    spark = df.sparkSession
    guard_target(spark, target)
    model, manifest = load_model(spark, path)
    features = list(manifest["features"])
    if lacking := sorted(set(features) - set(df.columns)):
        raise ValueError(f"features {lacking[:5]} are absent")
    declared, digest = (declared, None) if isinstance(declared, dict) else _declared(declared)
    actual = df.agg(F.count("*").alias("n_rows"), rows_digest(id_col, label).alias("rows_digest")).first().asDict() | {"features_sha256": manifest["features_sha256"]}
    if wrong := [k for k, v in declared.items() if actual.get(k) != v]:
        raise ValueError(f"not what was approved: {wrong} differ")
    s = saved(score(model, df.withColumnRenamed(id_col, "id").withColumnRenamed(label, "label")))
    if not s.where(~F.coalesce(F.col("score").between(0, 1), F.lit(False))).isEmpty():
        raise ValueError("a score is outside 0 to 1")
    ranked = priority_table(s, "id", 0.5)
    metrics = classification_metrics(s).join(average_precision(s), how="cross").join(roc_auc(s), how="cross").join(calibration(s), how="cross").withColumn("approval_digest", F.lit(digest).cast("string"))
    tables = {"predictions": ranked, "metrics": metrics, "budgets": top_k(s, fractions), "bootstrap": poisson_interval(s, fractions, replicates, uniform=hashed_uniform(seed))}
    publish(tables, target)
    return {k: spark.read.parquet(f"{target}/{k}") for k in tables}
