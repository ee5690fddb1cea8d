"""Comparison of saved score tables (id, label 0/1/null, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.ranking import top

CLASSES, MOVES = ("fail", "normal", "unknown"), ("newly_selected", "newly_removed", "jointly_selected", "jointly_unselected")


def _selected(df: DataFrame, k: int) -> DataFrame:
    return top(df.select(F.col("id"), "score", F.col("id").cast("string").alias("name")), k, F.desc("score"), F.asc("name")).select("id", F.lit(1).alias("chosen"))


def transitions(before: DataFrame, after: DataFrame, k: int) -> DataFrame:
    """Moves in and out of the first k by class of label; every class and move has a row. Ids must be the same in both."""
    both = before.select("id", "label").join(after.select("id", F.lit(1).alias("there")), "id", "full")
    if both.where("there is null or id is null").take(1) or before.count() != both.count():
        raise ValueError("the two tables don't hold the same ids")
    both = both.join(_selected(before, k).withColumnRenamed("chosen", "a"), "id", "left").join(_selected(after, k).withColumnRenamed("chosen", "b"), "id", "left")
    kind = F.when(F.col("label") == 1, "fail").when(F.col("label") == 0, "normal").otherwise("unknown")
    move = F.when(F.col("a").isNull() & F.col("b").isNotNull(), MOVES[0]).when(F.col("a").isNotNull() & F.col("b").isNull(), MOVES[1]).when(F.col("a").isNotNull(), MOVES[2]).otherwise(MOVES[3])
    counts = both.groupBy(kind.alias("label_class"), move.alias("move")).agg(F.count("*").alias("n"))
    cells = before.sparkSession.createDataFrame([(c, m) for c in CLASSES for m in MOVES], "label_class string, move string")
    return cells.join(counts, ["label_class", "move"], "left").select("label_class", "move", F.coalesce("n", F.lit(0)).alias("n"))


def tie_diagnostics(df: DataFrame, k: int) -> DataFrame:
    """What the tie at rank k allows: its size, how many of it are taken, least and most known failures captured."""
    edge = top(df.select("score"), k, F.desc("score")).agg(F.min("score").alias("edge")).first()["edge"]
    y, s = F.col("label"), F.col("score")
    c = df.agg(F.count_if(s > edge).alias("above"), F.count_if(s == edge).alias("tied"), F.count_if((s > edge) & (y == 1)).alias("fixed"), F.count_if((s == edge) & (y == 1)).alias("tied_fail"), F.count_distinct("score").alias("distinct_scores"), F.count_if(y.isNull()).alias("unknown"))
    taken = F.lit(k) - F.col("above")
    return c.select("distinct_scores", "tied", taken.alias("taken"), (F.col("fixed") + F.greatest(F.lit(0), taken - (F.col("tied") - F.col("tied_fail")))).alias("min_captured"), (F.col("fixed") + F.least(taken, F.col("tied_fail"))).alias("max_captured"), (F.col("distinct_scores") == 1).alias("constant_scores"), (taken < F.col("tied")).alias("order_matters"), (F.col("unknown") > 0).alias("labels_incomplete"))


def table_diff(before: DataFrame, after: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Counts of ids in one table only and of scores that moved by more than the tolerance."""
    j = before.select("id", F.col("score").alias("a"), F.lit(1).alias("l")).join(after.select("id", F.col("score").alias("b"), F.lit(1).alias("r")), "id", "full")
    return j.agg(F.count_if(F.col("r").isNull()).alias("removed"), F.count_if(F.col("l").isNull()).alias("added"), F.count_if(F.abs(F.col("a") - F.col("b")) > tolerance).alias("moved"), F.max(F.abs(F.col("a") - F.col("b"))).alias("largest_move"))


def priority_changes(before: DataFrame, after: DataFrame, k: int, tolerance: float = 1e-9) -> DataFrame:
    """Rows (id, changes) for ids whose score (beyond the tolerance), rank, prediction or place among the first k differs between two
    saved priority tables (id, rank, score, prediction), and for ids of one table only. changes: array of (field, before, after)."""
    side = lambda df, n: df.select("id", F.struct(F.col("score").cast("double").alias("score"), F.col("rank").cast("double").alias("rank"), F.col("prediction").cast("double").alias("prediction"), (F.col("rank") <= k).cast("double").alias("selected")).alias(n))
    j = side(before, "a").join(side(after, "b"), "id", "full")
    differs = lambda f: ~(F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))) & ~F.coalesce(F.abs(F.col(f"a.{f}") - F.col(f"b.{f}")) <= (tolerance if f == "score" else 0.0), F.lit(False))
    found = F.array_compact(F.array(*[F.when(differs(f), F.struct(F.lit(f).alias("field"), F.col(f"a.{f}").alias("before"), F.col(f"b.{f}").alias("after"))) for f in ("score", "rank", "prediction", "selected")]))
    return j.select("id", found.alias("changes")).where(F.size("changes") > 0)


def rank_permutation(df: DataFrame) -> DataFrame:
    """One row: whether the ranks of a saved table are 1 .. n, each once."""
    out = df.agg(F.count("*").alias("n_rows"), F.min("rank").alias("least"), F.max("rank").alias("largest"), F.count_distinct("rank").alias("different"))
    return out.withColumn("is_permutation", (F.col("n_rows") == 0) | F.coalesce((F.col("least") == 1) & (F.col("largest") == F.col("n_rows")) & (F.col("different") == F.col("n_rows")), F.lit(False)))


def budget_gate(original: DataFrame, eligible: DataFrame, held: DataFrame, id_col: str, declared_k: int, count: int | None = None, numerator: int = 1, denominator: int = 10, basis: str = "eligible") -> DataFrame:
    """cohort_gate and the budget: k by a fixed count, or the least whole number not below a fraction of the basis (original or eligible).
    Adds expected_k and the first reason against the declaration (null: none)."""
    sizes = original.select(id_col).distinct().agg(F.count("*").alias("original_count")).join(eligible.select(id_col).distinct().agg(F.count("*").alias("eligible_count")), how="cross")
    n = F.col(f"{basis}_count")
    k = F.lit(count).cast("long") if count is not None else F.expr(f"({basis}_count * {numerator} + {denominator - 1}) div {denominator}")
    out = cohort_gate(original, eligible, held, id_col).join(sizes, how="cross").withColumn("expected_k", F.when(n.isNotNull(), k))
    reason = (
        F.when(F.col("in_both") > 0, "eligible_and_held_overlap").when(F.col("in_neither") + F.col("foreign") > 0, "original_not_parted").when(F.lit(count is None and numerator > denominator), "fraction_exceeds_one")
        .when(F.col("expected_k") != declared_k, "declared_k_differs").when(F.col("expected_k") > F.col("eligible_count"), "budget_exceeds_eligible")
    )
    return out.withColumn("reason", reason)


def cohort_gate(original: DataFrame, eligible: DataFrame, held: DataFrame, id_col: str) -> DataFrame:
    """Whether eligible and held part the original: what is in both, in neither, and not of it."""
    j = original.select(id_col, F.lit(1).alias("o")).join(eligible.select(id_col, F.lit(1).alias("e")), id_col, "full").join(held.select(id_col, F.lit(1).alias("h")), id_col, "full")
    return j.agg(F.count_if(F.col("e").isNotNull() & F.col("h").isNotNull()).alias("in_both"), F.count_if(F.col("o").isNotNull() & F.col("e").isNull() & F.col("h").isNull()).alias("in_neither"), F.count_if(F.col("o").isNull()).alias("foreign"))


def score_contract(df: DataFrame, k: int, cutoff: Column) -> DataFrame:
    """One row: rows, repeated ids, scores outside 0 to 1, labels other than 0, 1 and null, rows after the cutoff, and whether k may be taken."""
    s = F.col("score")
    out = df.agg(
        F.count("*").alias("n_rows"), (F.count("*") - F.count_distinct("id")).alias("repeated_ids"), F.count_if(~F.coalesce(s.between(0, 1), F.lit(False))).alias("bad_scores"),
        F.count_if(~F.col("label").isin(0, 1)).alias("bad_labels"), F.count_if(F.col("ts") > cutoff).alias("after_cutoff"),
    )
    return out.withColumn("accepted", (F.col("repeated_ids") + F.col("bad_scores") + F.col("bad_labels") + F.col("after_cutoff") == 0) & (F.col("n_rows") >= k))


def windows_disjoint(df: DataFrame, window: str, id_col: str, ts: str) -> DataFrame:
    """By window: rows, ids that other windows have too, and whether it begins after all earlier windows end."""
    shared = df.groupBy(id_col).agg((F.count_distinct(window) > 1).alias("shared"))
    each = df.join(shared, id_col).groupBy(window).agg(F.count("*").alias("n_rows"), F.count_if("shared").alias("shared_rows"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    before = F.max("last").over(Window.orderBy(window).rowsBetween(Window.unboundedPreceding, -1))  # a row for each window
    return each.select(window, "n_rows", "shared_rows", F.coalesce(F.col("first") > before, F.lit(True)).alias("later"))


def lineage_match(audits: DataFrame, reports: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """By data set: whether audit and report both exist and agree in all fields."""
    j = audits.select(key, F.struct(*fields).alias("a")).join(reports.select(key, F.struct(*fields).alias("b")), key, "full")
    state = F.when(F.col("a").isNull(), "no_audit").when(F.col("b").isNull(), "no_report").when(F.col("a").eqNullSafe(F.col("b")), "match").otherwise("differs")
    return j.select(key, state.alias("state"))


def selection_summary(moves: DataFrame) -> DataFrame:
    """From transitions: selected before and after, known failures among them, and their share (null without known labels)."""
    n = F.col("n")
    was, now = F.col("move").isin("newly_removed", "jointly_selected"), F.col("move").isin("newly_selected", "jointly_selected")
    side = lambda name, at: F.struct(F.lit(name).alias("side"), F.sum(F.when(at, n).otherwise(0)).alias("selected"), F.sum(F.when(at & (F.col("label_class") == "fail"), n).otherwise(0)).alias("fails"), F.sum(F.when(at & (F.col("label_class") != "unknown"), n).otherwise(0)).alias("labelled")).alias(name)
    out = moves.agg(side("before", was), side("after", now)).select(F.inline(F.array("before", "after")))
    return out.withColumn("fail_share", F.try_divide("fails", "labelled"))
