"""Ranking and evaluation of score tables (id, label 0/1, score). Ties in score go by id as text."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.ranking import exact_quantiles, global_rank, group_rank, running_sums, saved


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def classification_metrics(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    hit, y = F.col("score") >= threshold, F.col("label") == 1
    c = df.agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    recall, spec = ratio(tp, tp + fn), ratio(tn, tn + fp)
    return c.select("tp", "fp", "fn", "tn", recall.alias("recall"), ratio(tp, tp + fp).alias("precision"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ((recall + spec) / 2).alias("balanced_accuracy"), ratio(fp, fp + tn).alias("false_alarm_rate"), ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def pr_points(df: DataFrame) -> DataFrame:
    """By distinct score, highest first: positives and rows so far. Equal scores come together."""
    by = df.groupBy("score").agg(F.count("*").alias("n"), F.sum("label").alias("pos"))
    return running_sums(by, [F.desc("score")], {"seen": "n", "captured": "pos"})


def average_precision(df: DataFrame) -> DataFrame:
    p = pr_points(df)
    return p.agg((F.sum(F.col("pos") * F.col("captured") / F.col("seen")) / F.sum("pos")).alias("average_precision"))


def roc_auc(df: DataFrame) -> DataFrame:
    """Null without positives or without negatives."""
    neg, above = F.col("n") - F.col("pos"), F.col("seen") - F.col("captured")
    c = pr_points(df).agg(F.sum(F.col("pos") * (neg / 2 - above)).alias("a"), F.sum("pos").alias("p"), F.sum(neg).alias("q"))
    return c.select(F.try_divide(F.col("a") + F.col("p") * F.col("q"), F.col("p") * F.col("q")).alias("roc_auc"))


def top_k(df: DataFrame, fractions: list[float], cost: float = 1.0, missed_cost: float = 20.0) -> DataFrame:
    """Capture of positives within budgets, and what inspection and misses would cost. Ranks come from sorted ranges."""
    n, total = df.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    budgets = {f: math.ceil(n * f) for f in fractions}
    ranked = global_rank(df.select("label", F.col("id").cast("string").alias("id"), "score"), F.desc("score"), F.asc("id"))
    hits = ranked.agg(F.lit(1).alias("one"), *[F.coalesce(F.sum(F.when(F.col("rank") <= k, F.col("label"))), F.lit(0)).alias(f"h{i}") for i, k in enumerate(budgets.values())])
    rows = hits.select(F.explode(F.array(*[F.struct(F.lit(f).alias("fraction"), F.lit(k).cast("long").alias("inspected"), F.col(f"h{i}").alias("captured")) for i, (f, k) in enumerate(budgets.items())])).alias("r")).select("r.*")
    precision, missed = ratio(F.col("captured"), F.col("inspected")), F.lit(total) - F.col("captured")
    return rows.select(
        "fraction", "inspected", "captured", ratio(F.col("captured"), F.lit(total)).alias("capture_rate"), (F.col("inspected") - F.col("captured")).alias("false_inspections"), precision.alias("precision"),
        ratio(F.col("inspected"), F.lit(n)).alias("burden"), ratio(precision, ratio(F.lit(total), F.lit(n))).alias("lift"), (F.col("inspected") * cost + missed * missed_cost).alias("cost"), F.lit(total * missed_cost).alias("cost_without"),
    )


def calibration(df: DataFrame, bins: int = 10) -> DataFrame:
    """Brier score and expected calibration error over equal bins."""
    at = F.least(F.floor(F.round(F.col("score") * bins, 9)), F.lit(bins - 1))
    by = df.withColumn("bin", at).groupBy("bin").agg(F.count("*").alias("n"), F.avg("score").alias("p"), F.avg("label").alias("y"), F.sum(F.pow(F.col("score") - F.col("label"), 2)).alias("sq"))
    n = F.sum("n")
    return by.agg((F.sum("sq") / n).alias("brier"), (F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / n).alias("ece"), F.count("*").alias("populated_bins"))


def psi(reference: DataFrame, current: DataFrame, value: str, by: str | None = None, bins: int = 10) -> DataFrame:
    """Population stability by group: bins from the reference's quantiles, one more for missing values (null or NaN), shares of at
    least 1e-6. A constant or an all-missing reference gives 0 if the current values are the same, else infinity. Null where a
    group has no rows on one side."""
    by = by or "_all"
    x = F.col(value).cast("double")
    ref, cur = ((d if by in d.columns else d.withColumn(by, F.lit(1))).select(by, F.when(~F.isnan(x), x).alias("x")) for d in (reference, current))
    inner = F.array_distinct("quantiles")
    inner = F.slice(inner, 2, F.greatest(F.size(inner) - 2, F.lit(0)))
    edges = exact_quantiles(ref, by, "x", [i / bins for i in range(bins + 1)]).select(by, inner.alias("edges"))
    # Equal values are counted first. The distinct ones are laid out in ranges, and a group's edges are handed to each range it has values in.
    both = ref.withColumn("w", F.lit(0)).unionByName(cur.withColumn("w", F.lit(1))).groupBy(by, "x").agg(F.count_if(F.col("w") == 0).alias("r"), F.count_if(F.col("w") == 1).alias("c"))
    both = saved(both.repartitionByRange(by, "x").withColumn("_part", F.spark_partition_id()))
    both = both.join(both.select(by, "_part").distinct().join(edges, by, "left"), [by, "_part"])
    place = F.when(F.col("x").isNull(), -1).otherwise(F.size(F.filter(F.coalesce("edges", F.array().cast("array<double>")), lambda e: e <= F.col("x"))))
    side = lambda f, k: f(F.when(F.col(k) > 0, F.col("x")))
    counts = both.groupBy(by, place.alias("bin")).agg(F.sum("r").alias("r"), F.sum("c").alias("c"), side(F.min, "r").alias("r0"), side(F.max, "r").alias("r1"), side(F.min, "c").alias("c0"), side(F.max, "c").alias("c1"))
    sums = counts.groupBy(by).agg(F.sum("r").alias("rn"), F.sum("c").alias("cn"), F.min("r0").alias("r_low"), F.max("r1").alias("r_high"), F.min("c0").alias("c_low"), F.max("c1").alias("c_high"))
    share = lambda n, of: F.greatest(F.try_divide(n, of), F.lit(1e-6))
    r, c = share("r", "rn"), share("c", "cn")
    keys = [by, "rn", "cn", "r_low", "r_high", "c_low", "c_high"]
    found = counts.join(sums, by).groupBy(*keys).agg(F.sum((c - r) * F.log(c / r)).alias("varying"))
    same = F.coalesce((F.col("c_low") == F.col("r_low")) & (F.col("c_high") == F.col("r_low")), F.col("c_low").isNull())
    flat = F.col("r_low").isNull() | (F.col("r_low") == F.col("r_high"))
    out = F.when((F.col("rn") > 0) & (F.col("cn") > 0), F.when(flat, F.when(same, 0.0).otherwise(math.inf)).otherwise(F.col("varying")))
    return found.select(by, out.alias("psi"))


def sign_flip(differences: DataFrame, value: str = "d", most: int = 16) -> DataFrame:
    """Exact two-sided sign-flip test of at most `most` paired differences."""
    d = [r[0] for r in differences.select(value).limit(most + 1).collect()]
    if len(d) > most:
        raise ValueError(f"at most {most} differences")
    signs = differences.sparkSession.range(1 << len(d))
    total = sum([F.when(F.shiftright("id", i).bitwiseAND(F.lit(1)) == 1, F.lit(x)).otherwise(F.lit(-x)) for i, x in enumerate(d)], F.lit(0.0))
    return signs.agg(F.avg((F.abs(total) >= abs(sum(d)) - 1e-15).cast("double")).alias("p_value"), F.lit(float(sum(d) / max(1, len(d)))).alias("mean_difference"))


def grouped_counts(df: DataFrame, protocol: str, domain: str) -> DataFrame:
    """Evaluation counts by domain and over all domains of a protocol."""
    return df.groupingSets([[protocol, domain], [protocol]], protocol, domain).agg(F.count("*").alias("n"), F.sum("label").alias("positives"), F.avg("score").alias("mean_score"))


def by_domain(df: DataFrame, protocol: str, domain: str, fraction: float = 0.1, threshold: float = 0.5) -> DataFrame:
    """Metrics by protocol and domain, and over all domains of a protocol (domain null): rows, positives, average precision, ROC AUC
    (null without both labels), recall and false alarms at the threshold, and captures within a budget of a share of the rows.
    Equal scores come together in the curves and go by id as text in the budget."""
    rows = df.select(protocol, domain, F.lit(0).alias("whole"), F.col("id").cast("string").alias("id"), "label", "score")
    rows = rows.unionByName(rows.withColumn(domain, F.lit(None).cast(df.schema[domain].dataType)).withColumn("whole", F.lit(1)))
    keys = [protocol, "whole", domain]
    hit, y = F.col("score") >= threshold, F.col("label") == 1
    ranked = group_rank(rows, keys, F.desc("score"), F.asc("id"))
    flat = ranked.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum("label").alias("positives"), ratio(F.count_if(hit & y), F.count_if(y)).alias("recall"), ratio(F.count_if(hit & ~y), F.count_if(~y)).alias("false_alarm_rate"),
        F.coalesce(F.sum(F.when(F.col("rank") <= F.ceil(F.col("_n") * fraction), F.col("label"))), F.lit(0)).alias("captured"),
    )
    curve = rows.groupBy(*keys, "score").agg(F.count("*").alias("m"), F.sum("label").alias("pos"))
    curve = running_sums(curve, [*[F.asc(k) for k in keys], F.desc("score")], {"seen": "m", "hits": "pos"})
    start = curve.groupBy(*keys).agg(F.min(F.col("seen") - F.col("m")).alias("_seen"), F.min(F.col("hits") - F.col("pos")).alias("_hits")).toDF(*[f"_{k}" for k in keys], "_seen", "_hits")
    curve = curve.join(start, [curve[k].eqNullSafe(start[f"_{k}"]) for k in keys]).withColumn("seen", F.col("seen") - F.col("_seen")).withColumn("hits", F.col("hits") - F.col("_hits"))
    neg = F.col("m") - F.col("pos")
    area = curve.groupBy(*keys).agg(F.sum(F.col("pos") * F.col("hits") / F.col("seen")).alias("a"), F.sum(F.col("pos") * (neg / 2 - (F.col("seen") - F.col("hits")))).alias("u"), F.sum("pos").alias("p"), F.sum(neg).alias("q"))
    pq = F.col("p") * F.col("q")
    area = area.select(*keys, F.try_divide("a", "p").alias("average_precision"), F.try_divide(F.col("u") + pq, pq).alias("roc_auc"))
    same = [flat[k].eqNullSafe(area[k]) for k in keys]
    return flat.join(area, same).select(flat[protocol], flat[domain], "n", "positives", "average_precision", "roc_auc", "recall", "false_alarm_rate", "captured")


def cost_choices(costs: DataFrame, near: float = 0.1) -> DataFrame:
    """Two rows of a cost table: that with the least cost (ties: the smaller fraction), and that whose fraction is nearest to `near`."""
    best, close = F.min_by(F.struct("*"), F.struct("cost", "fraction")), F.min_by(F.struct("*"), F.struct(F.abs(F.col("fraction") - near), F.col("fraction")))
    return costs.agg(F.array(F.struct(F.lit("least_cost").alias("choice"), best.alias("row")), F.struct(F.lit("nearest").alias("choice"), close.alias("row"))).alias("a")).select(F.inline("a")).select("choice", "row.*")


def cv_summary(metrics: DataFrame, value: str = "average_precision") -> DataFrame:
    """By candidate over folds: mean, sample deviation, least, largest."""
    return metrics.groupBy("candidate", "family").agg(F.count("*").alias("folds"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("largest"))


def paired_repeats(metrics: DataFrame, reference: str, challenger: str, value: str = "average_precision") -> DataFrame:
    """One row by repeat: means of the best candidate of either family over its splits, and their difference.

    Best is the highest mean over all folds (ties: the first name). Both must have the same repeats with equally many splits.
    """
    means = metrics.where(F.col("family").isin(reference, challenger)).groupBy("family", "candidate").agg(F.avg(value).alias("m"))
    best = means.groupBy("family").agg(F.min_by("candidate", F.struct(-F.col("m"), "candidate")).alias("candidate"))
    rows = metrics.join(best, ["family", "candidate"]).groupBy("repeat").pivot("family", [reference, challenger]).agg(F.avg(value).alias("mean"), F.count_distinct("split").alias("splits"))
    a, b = (F.col(f"{f}_mean") for f in (reference, challenger))
    uneven = rows.agg(F.count_if(a.isNull() | b.isNull()) > 0, F.count_distinct(f"{reference}_splits") > 1, F.count_if(F.col(f"{reference}_splits") != F.col(f"{challenger}_splits")) > 0).first()
    if any(uneven):
        raise ValueError("candidates don't share a complete structure of repeats and splits")
    return rows.select("repeat", a.alias("reference_mean"), b.alias("challenger_mean"), (b - a).alias("d"))


def paired_summary(pairs: DataFrame) -> DataFrame:
    """One row on paired repeats: means, mean and median difference, repeats won by the challenger."""
    return pairs.agg(
        F.count("*").alias("repeats"), F.avg("reference_mean").alias("reference_mean"), F.avg("challenger_mean").alias("challenger_mean"), F.avg("d").alias("mean_difference"),
        F.percentile("d", F.lit(0.5)).alias("median_difference"), F.count_if(F.col("d") > 0).alias("challenger_wins"),
    )


def stored_check(computed: DataFrame, stored: DataFrame, keys: list[str], values: list[str], relative: float = 1e-9, absolute: float = 1e-12) -> DataFrame:
    """Rows (keys, field, computed, stored, agrees) for all values of both tables; what one side lacks doesn't agree."""
    tall = lambda df, name: df.select(*keys, F.inline(F.array(*[F.struct(F.lit(v).alias("field"), F.col(v).cast("double").alias(name)) for v in values])))
    j = tall(computed, "computed").join(tall(stored, "stored"), [*keys, "field"], "full")
    a, b = F.col("computed"), F.col("stored")
    close = F.abs(a - b) <= F.greatest(F.greatest(F.abs(a), F.abs(b)) * relative, F.lit(absolute))
    return j.withColumn("agrees", F.coalesce(close, a.isNull() & b.isNull()))


def budget_view(ranked: DataFrame, budgets: list[int]) -> DataFrame:
    """Captures within budgets of a saved ranked list (rank, score, label), and whether its scores follow its ranks there."""
    most = max(budgets)
    short = ranked.where(F.col("rank") <= most).withColumn("rises", F.col("score") > F.lag("score").over(Window.orderBy("rank")))  # at most the largest budget
    out = short.agg(*[F.struct(F.lit(b).cast("long").alias("budget"), F.count_if(F.col("rank") <= b).alias("listed"), F.coalesce(F.sum(F.when(F.col("rank") <= b, F.col("label"))), F.lit(0)).alias("captured"), F.count_if((F.col("rank") <= b) & F.col("rises")).alias("out_of_order")).alias(f"b{b}") for b in budgets])
    return out.select(F.inline(F.array(*[f"b{b}" for b in budgets])))


def contrasts(summary: DataFrame, family: str, mode: str, value: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """By family and pair of modes: the first mode's value less the second's."""
    wide = summary.groupBy(family).pivot(mode, sorted({m for p in pairs for m in p})).agg(F.first(value))
    return wide.select(family, F.inline(F.array(*[F.struct(F.lit(f"{a}-{b}").alias("contrast"), (F.col(a) - F.col(b)).alias("difference")) for a, b in pairs])))


def disagreement(summary: DataFrame, family: str, mode: str, curve: str, capture: str, pairs: list[tuple[str, str]], least: float = 1e-3) -> DataFrame:
    """By family and pair of modes: both values' differences, and whether the curve moves by more than `least` one way and the captures the other."""
    a, b = (contrasts(summary, family, mode, v, pairs).withColumnRenamed("difference", f"{v}_difference") for v in (curve, capture))
    x, y = F.col(f"{curve}_difference"), F.col(f"{capture}_difference")
    return a.join(b, [family, "contrast"]).withColumn("disagree", F.coalesce((F.abs(x) > least) & (x * y < 0), F.lit(False)))


def _intervals(caught: DataFrame, confidence: float) -> DataFrame:
    """By fraction: means and percentile intervals of capture and precision over rows (fraction, cut, captured, total), one for each
    replicate. Those without a positive are left out."""
    tail = (1 - confidence) / 2
    rates = {"": F.when(F.col("total") > 0, F.col("captured") / F.col("total")), "precision_": F.when(F.col("total") > 0, F.col("captured") / F.col("cut"))}
    parts = [f.alias(f"{n}{k}") for n, v in rates.items() for k, f in (("mean", F.avg(v)), ("low", F.percentile(v, F.lit(tail))), ("high", F.percentile(v, F.lit(1 - tail))))]
    return caught.groupBy("fraction").agg(F.count_if(F.col("total") > 0).alias("replicates"), *parts)


def _of_fractions(fractions: list[float]) -> Column:
    return F.explode(F.array(*[F.lit(float(f)) for f in fractions])).alias("fraction")


def capture_interval(draws: DataFrame, scored: DataFrame, fractions: list[float], confidence: float = 0.95) -> DataFrame:
    """By fraction: percentile intervals of capture and precision over replicates (rows rep, i, id of bootstrap draws). Exact, and as
    large as all draws together; see poisson_interval for large tables."""
    rows = draws.join(scored.select("id", "score", "label", F.col("id").cast("string").alias("_name")), "id")
    rows = group_rank(rows, ["rep"], F.desc("score"), F.asc("_name"), F.asc("i"))
    hits = [F.coalesce(F.sum(F.when(F.col("rank") <= F.ceil(F.col("_n") * F.lit(float(f))), F.col("label"))), F.lit(0)) for f in fractions]
    each = [F.struct(F.lit(float(f)).alias("fraction"), F.ceil(F.max("_n") * F.lit(float(f))).alias("cut"), h.alias("captured")) for f, h in zip(fractions, hits, strict=True)]
    caught = rows.groupBy("rep").agg(F.sum("label").alias("total"), F.array(*each).alias("each")).select("total", F.inline("each"))
    found = _intervals(caught, confidence)
    return scored.sparkSession.range(1).select(_of_fractions(fractions)).join(F.broadcast(found), "fraction", "left").fillna(0, ["replicates"])


def hashed_uniform(seed: int = 1) -> Callable[[Column, Column], Column]:
    """A number from 0 to below 1 for each replicate and id."""
    return lambda rep, name: F.shiftrightunsigned(F.xxhash64(F.lit(seed), rep, name), 11) / float(1 << 53)


def poisson_thresholds(most: int = 17) -> list[float]:
    """The shares of a Poisson distribution of mean 1 at or below 0, 1, 2, ..."""
    out, term, total = [], math.exp(-1), 0.0
    for k in range(1, most + 1):
        total += term
        out.append(total)
        term /= k
    return out


def poisson_interval(scored: DataFrame, fractions: list[float], replicates: int = 2000, confidence: float = 0.95, groups: int = 1024, uniform: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Like capture_interval for large tables: in each replicate a row counts as often as a Poisson number of mean 1 says, drawn by hash of
    the replicate and the row's id.

    The weights are summed by replicate and range of scores where the rows are, so what is shuffled is replicates x groups rows. Running
    sums over the ranges tell in which one a replicate's cut lies; the rows of this one range alone are then summed by score, and
    running sums over sorted ranges of (replicate, score) find the cut. Rows with equal scores come together: of the group at the cut,
    its share of positives counts. Nothing holds a replicate's rows in one task."""
    uniform = uniform or hashed_uniform()
    rows = scored.select(F.col("id"), F.col("score").cast("double").alias("score"), F.col("label").cast("long").alias("label"))
    shares = [i / groups for i in range(1, groups)]
    cuts = sorted({c for c in rows.approxQuantile("score", shares, 0.25 / groups) if math.isfinite(c)}) if shares else []
    if cuts:
        rows = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="score", outputCol="range", handleInvalid="keep").transform(rows)
    else:
        rows = rows.withColumn("range", F.lit(0.0))

    def weighed(df: DataFrame) -> DataFrame:
        u, w = F.col("u"), F.lit(0)
        for k, at in reversed(list(enumerate(poisson_thresholds()))):
            w = F.when(u < at, k).otherwise(w if k < 16 else 17)
        return df.withColumn("u", uniform(F.col("rep"), F.col("id"))).withColumn("w", w.cast("long")).where("w > 0")

    sums = weighed(rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))).groupBy("rep", "range").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("label")).alias("p"))
    whole = Window.partitionBy("rep")  # a row for each range
    before = whole.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("w", "p")], F.sum("w").over(whole).alias("n"), F.sum("p").over(whole).alias("total"))
    edge = sums.select("*", _of_fractions(fractions)).withColumn("cut", F.ceil(F.col("n") * F.col("fraction")))
    edge = saved(edge.where("w0 < cut and cut <= w0 + w").select("rep", "range", "fraction", "cut", "total", "p0", (F.col("cut") - F.col("w0")).alias("need")))
    # replicates x fractions rows
    near = weighed(rows.join(F.broadcast(edge.select("rep", "range", "fraction")), "range")).groupBy("rep", "fraction", "score").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("label")).alias("p"))
    run = saved(running_sums(near, [F.asc("rep"), F.asc("fraction"), F.desc("score")], {"seen": "w", "hits": "p"}))
    start = run.groupBy("rep", "fraction").agg(F.min(F.col("seen") - F.col("w")).alias("s0"), F.min(F.col("hits") - F.col("p")).alias("h0"))
    run = run.join(start, ["rep", "fraction"]).join(edge, ["rep", "fraction"])
    last = F.col("seen") - F.col("s0") - F.col("w")  # draws before the group, within the range
    at_cut = run.where((last < F.col("need")) & (F.col("need") <= last + F.col("w")))
    captured = F.col("p0") + F.col("hits") - F.col("h0") - F.col("p") + F.col("p") * (F.col("need") - last) / F.col("w")
    found = _intervals(at_cut.select("fraction", "cut", "total", captured.alias("captured")), confidence)
    return scored.sparkSession.range(1).select(_of_fractions(fractions)).join(F.broadcast(found), "fraction", "left").fillna(0, ["replicates"])
