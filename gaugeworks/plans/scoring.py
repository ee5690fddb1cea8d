"""Registered queries on models, repeated evaluation, saved score tables and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.operators import anomaly, compare, evaluate, models, profile
from gaugeworks.plans.registry import SCORES, components, known, query, rounded, scores, table

# Models


@query()
def mod_isolation(spark, d):
    """Isolation of embeddings by a forest grown on the rows of other classes than 3."""
    e, names = components(table(spark, d, "embeddings"), "embedding")
    e = e.select("vec_id", "label", *names)
    return anomaly.isolation_forest(e.where("label <> 3"), e, names, "vec_id").select("vec_id", "label", "score")


@query("""WITH m AS (SELECT l_suppkey % 5 AS fold, l_partkey % 40 AS feature, round(avg(l_discount), 9) AS i, round(avg(l_tax), 9) - 0.04::DOUBLE AS s FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY i DESC, feature::VARCHAR) AS rk FROM m)
SELECT feature::VARCHAR AS feature, count(DISTINCT fold) AS top_frequency, quantile_cont(rk::DOUBLE, 0.5) AS median_rank, quantile_cont(rk::DOUBLE, 0.75) - quantile_cont(rk::DOUBLE, 0.25) AS rank_iqr, round(quantile_cont(i, 0.5), 6) AS median_importance,
  round(avg((s > 0)::INT), 6) AS positive_sign_rate, count(DISTINCT fold) / 5 AS top_rate FROM r WHERE rk <= 20 GROUP BY 1""")
def mod_stability(spark, d):
    m = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("fold"), (F.col("l_partkey") % 40).cast("string").alias("feature"))
    return rounded(models.stability(m.agg(F.round(F.avg("l_discount"), 9).alias("importance"), (F.round(F.avg("l_tax"), 9) - 0.04).alias("signed")), 5))


@query("""WITH e AS (SELECT list_sort([{'s': -abs(l_quantity * 0.5::DOUBLE), 'f': 'l_quantity'}, {'s': -abs(l_extendedprice * 0.0005::DOUBLE), 'f': 'l_extendedprice'}, {'s': -abs(l_discount * 200::DOUBLE), 'f': 'l_discount'}, {'s': -abs(l_tax * -300::DOUBLE), 'f': 'l_tax'}]) AS p FROM lineitem)
SELECT p[1].f || ',' || p[2].f AS suggested, count(*) AS n FROM e GROUP BY 1""")
def mod_evidence(spark, d):
    weights = {"l_quantity": 0.5, "l_extendedprice": 0.0005, "l_discount": 200.0, "l_tax": -300.0}
    return models.evidence(table(spark, d, "lineitem"), weights, 2).groupBy(F.array_join("suggested", ",").alias("suggested")).agg(F.count("*").alias("n"))


@query(f"WITH {SCORES} SELECT id, score, row_number() OVER (ORDER BY score DESC, id::VARCHAR) AS rank, (score >= 0.5)::INT AS prediction FROM scores")
def mod_priority(spark, d):
    return models.priority_table(scores(spark, d), "id", 0.5).select("id", "score", F.col("rank").cast("long").alias("rank"), "prediction")


# Repeated evaluation

METRICS = """m AS (SELECT l_linenumber::VARCHAR AS candidate, CASE WHEN l_linenumber <= 3 THEN 'logistic' ELSE 'forest' END AS family, l_suppkey % 5 AS repeat, l_partkey % 5 AS split, round(avg(l_discount), 9) AS ap FROM lineitem GROUP BY ALL)"""


def metrics(spark, d):
    by = [F.col("l_linenumber").cast("string").alias("candidate"), F.when(F.col("l_linenumber") <= 3, "logistic").otherwise("forest").alias("family"), (F.col("l_suppkey") % 5).alias("repeat"), (F.col("l_partkey") % 5).alias("split")]
    return table(spark, d, "lineitem").groupBy(*by).agg(F.round(F.avg("l_discount"), 9).alias("average_precision"))


@query(f"WITH {METRICS} SELECT candidate, family, count(*) AS folds, round(avg(ap), 6) AS mean, round(stddev_samp(ap), 6) AS std, round(min(ap), 6) AS least, round(max(ap), 6) AS largest FROM m GROUP BY ALL")
def eval_cv_summary(spark, d):
    return rounded(evaluate.cv_summary(metrics(spark, d)))


@query(f"""WITH {METRICS}, v AS (SELECT family, candidate, avg(ap) AS mean FROM m GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY mean DESC, candidate) AS rk FROM v),
p AS (SELECT repeat, avg(ap) FILTER (family = 'logistic') AS a, avg(ap) FILTER (family = 'forest') AS c FROM m JOIN b USING (family, candidate) WHERE rk = 1 GROUP BY 1)
SELECT count(*) AS repeats, round(avg(a), 6) AS reference_mean, round(avg(c), 6) AS challenger_mean, round(avg(c - a), 6) AS mean_difference, round(quantile_cont(c - a, 0.5), 6) AS median_difference, count_if(c > a)::BIGINT AS challenger_wins FROM p""")
def eval_paired_repeats(spark, d):
    return rounded(evaluate.paired_summary(evaluate.paired_repeats(metrics(spark, d), "logistic", "forest")))


@query("""SELECT field, agrees, count(*) AS n FROM (SELECT unnest(['sum_qty', 'avg_price']) AS field, unnest([l_suppkey % 10 <> 0, true]) AS agrees FROM (SELECT DISTINCT l_suppkey FROM lineitem)) GROUP BY ALL""")
def eval_stored_check(spark, d):
    t = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("sum_qty"), F.avg("l_extendedprice").alias("avg_price"))
    stored = t.withColumn("sum_qty", F.col("sum_qty") + (F.col("l_suppkey") % 10 == 0).cast("int"))
    return evaluate.stored_check(t, stored, ["l_suppkey"], ["sum_qty", "avg_price"]).groupBy("field", "agrees").agg(F.count("*").alias("n"))


@query(f"""WITH {SCORES}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id::VARCHAR) AS rk FROM known)
SELECT b::BIGINT AS budget, count_if(rk <= b)::BIGINT AS listed, coalesce(sum(label) FILTER (rk <= b), 0)::BIGINT AS captured, 0::BIGINT AS out_of_order FROM r, (VALUES (20), (40), (50)) t(b) GROUP BY b""")
def eval_budget_view(spark, d):
    return evaluate.budget_view(models.priority_table(known(spark, d), "id", 0.5), [20, 40, 50])


@query("""WITH s AS (SELECT o_orderstatus AS f, left(o_orderpriority, 1) AS m, avg(o_totalprice) AS v FROM orders GROUP BY ALL)
SELECT a.f AS o_orderstatus, a.m || '-' || b.m AS contrast, round(a.v - b.v, 4) AS difference FROM s a JOIN s b ON a.f = b.f AND ((a.m = '1' AND b.m = '5') OR (a.m = '2' AND b.m = '3'))""")
def eval_contrasts(spark, d):
    s = table(spark, d, "orders").groupBy("o_orderstatus", F.substring("o_orderpriority", 1, 1).alias("mode")).agg(F.avg("o_totalprice").alias("v"))
    return rounded(evaluate.contrasts(s, "o_orderstatus", "mode", "v", [("1", "5"), ("2", "3")]), 4)


# Saved score tables


@query(f"""WITH {SCORES}, c AS (SELECT count(*) AS n_rows, (count(*) - count(DISTINCT id)) AS repeated_ids, count_if(id % 50 = 0)::BIGINT AS bad_scores, 0::BIGINT AS bad_labels, count_if(id % 7 = 0)::BIGINT AS after_cutoff FROM scores)
SELECT *, repeated_ids + bad_scores + bad_labels + after_cutoff = 0 AND n_rows >= 50 AS accepted FROM c""")
def cmp_score_contract(spark, d):
    s = scores(spark, d).withColumn("score", F.when(F.col("id") % 50 == 0, F.col("score") + 2).otherwise(F.col("score"))).withColumn("ts", F.when(F.col("id") % 7 == 0, 2).otherwise(1))
    return compare.score_contract(s, 50, F.lit(1))


@query("""WITH e AS (SELECT strftime(ts, '%Y-%m') || CASE WHEN event_id % 500 = 0 THEN 'x' ELSE '' END AS w, user_id, ts FROM events), s AS (SELECT user_id, count(DISTINCT w) > 1 AS shared FROM e GROUP BY 1),
a AS (SELECT w, count(*) AS n, count_if(shared) AS sh, min(ts) AS f, max(ts) AS l FROM e JOIN s USING (user_id) GROUP BY 1)
SELECT w AS month, n AS n_rows, sh::BIGINT AS shared_rows, coalesce(f > max(l) OVER (ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS later FROM a""")
def cmp_windows(spark, d):
    e = table(spark, d, "events").withColumn("month", F.concat(F.date_format("ts", "yyyy-MM"), F.when(F.col("event_id") % 500 == 0, "x").otherwise("")))
    return compare.windows_disjoint(e, "month", "user_id", "ts")


@query(f"""WITH {SCORES}, a AS (SELECT 'before' AS side, label FROM (SELECT * FROM scores ORDER BY score DESC, id::VARCHAR LIMIT 50) UNION ALL SELECT 'after', label FROM (SELECT * FROM scores ORDER BY score2 DESC, id::VARCHAR LIMIT 50))
SELECT side, count(*) AS selected, count_if(coalesce(label = 1, false))::BIGINT AS fails, count(label) AS labelled, round(count_if(coalesce(label = 1, false)) / nullif(count(label), 0), 6) AS fail_share FROM a GROUP BY 1""")
def cmp_selection_summary(spark, d):
    return rounded(compare.selection_summary(compare.transitions(scores(spark, d), scores(spark, d, 104729), 50)))


@query("""WITH a AS (SELECT l_orderkey AS k, count(*) AS n, max(l_linenumber) AS m FROM lineitem WHERE l_orderkey % 7 <> 0 GROUP BY 1), b AS (SELECT l_orderkey AS k, count(*) FILTER (l_linenumber < 7) AS n, max(l_linenumber) AS m FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY 1)
SELECT CASE WHEN a.k IS NULL THEN 'no_audit' WHEN b.k IS NULL THEN 'no_report' WHEN a.n = b.n AND a.m = b.m THEN 'match' ELSE 'differs' END AS state, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1""")
def cmp_lineage(spark, d):
    side = lambda n, where: table(spark, d, "lineitem").where(where).groupBy("l_orderkey").agg(n.alias("n"), F.max("l_linenumber").alias("m"))
    found = compare.lineage_match(side(F.count("*"), "l_orderkey % 7 <> 0"), side(F.count_if(F.col("l_linenumber") < 7), "l_orderkey % 5 <> 0"), "l_orderkey", ["n", "m"])
    return found.groupBy("state").agg(F.count("*").alias("n"))


# Logs and audits


@query("""WITH s AS (SELECT user_id, event_type = 'error' AS gone, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS step, event_id % 50 < lag(event_id % 50) OVER w AS fall FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, count(*) AS records, count_if(gone)::BIGINT AS without_value, count_if(coalesce(step > 86400000000, false))::BIGINT AS gaps, count_if(coalesce(fall, false))::BIGINT AS counter_falls, count_if(coalesce(step = 0, false))::BIGINT AS repeats,
  quantile_cont(step::DOUBLE, 0.5) AS median_step_us, min(step) AS least_step_us, max(step) AS largest_step_us FROM s GROUP BY 1""")
def prf_log_audit(spark, d):
    e = table(spark, d, "events").withColumn("value", F.when(F.col("event_type") != "error", F.col("value"))).withColumn("cycle", F.col("event_id") % 50)
    return profile.log_audit(e, "user_id", ["ts", "event_id"], "ts", "value", "cycle", 86_400)


@query("""WITH k AS (SELECT CASE WHEN l_orderkey % 100 <> 0 THEN l_orderkey END AS k, l_linenumber AS c FROM lineitem), a AS (SELECT k, count(*) AS n, count(*) - count(DISTINCT c) AS again FROM k WHERE k IS NOT NULL GROUP BY 1)
SELECT n AS rows_of_key, count(*) AS keys, sum(again)::BIGINT AS repeated_coordinates FROM a GROUP BY 1 UNION ALL SELECT 0, count(*), 0 FROM k WHERE k IS NULL HAVING count(*) > 0""")
def prf_key_audit(spark, d):
    t = table(spark, d, "lineitem").withColumn("k", F.when(F.col("l_orderkey") % 100 != 0, F.col("l_orderkey")))
    return profile.key_audit(t, "k", ["l_linenumber"])


@query("""SELECT o_orderkey // 1000 AS lot, count(*) AS inserted, count_if(o_orderstatus = 'F')::BIGINT AS completed, count_if(o_orderstatus = 'O')::BIGINT AS bad, count_if(o_orderstatus = 'P')::BIGINT AS missing FROM orders GROUP BY 1""")
def prf_lots(spark, d):
    state = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "bad")
    return profile.lots(table(spark, d, "orders").withColumn("state", state), "o_orderkey", "state", 1000)


@query("""SELECT count_if(o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 7 <> 0)::BIGINT AS found, count_if(o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0)::BIGINT AS absent, count_if(o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 7 = 0)::BIGINT AS changed,
  count_if(o_orderkey % 5 = 0 AND o_orderkey % 3 <> 0)::BIGINT AS unknown FROM orders""")
def prf_manifest(spark, d):
    o = table(spark, d, "orders")
    listed = o.where("o_orderkey % 5 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise(F.col("o_orderstatus")))
    return profile.manifest_match(o.where("o_orderkey % 3 <> 0"), listed, "o_orderkey", ["o_orderstatus", "o_orderdate"])


@query("""WITH t AS (SELECT l_shipdate < TIMESTAMP '1996-01-01' AS old, CASE WHEN l_quantity <= 40 THEN l_quantity END AS q, l_tax AS x FROM lineitem),
l AS (SELECT old, 'q' AS feature, q AS x FROM t UNION ALL SELECT old, 'l_tax', x FROM t),
e AS (SELECT feature, list_distinct(quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS edges FROM l WHERE old GROUP BY 1), i AS (SELECT feature, list_sort(edges)[2:len(edges) - 1] AS inner_edges FROM e),
b AS (SELECT feature, old, CASE WHEN x IS NULL THEN -1 ELSE len(list_filter(inner_edges, lambda z: z <= x)) END AS bin FROM l JOIN i USING (feature)),
n AS (SELECT feature, bin, count_if(old) AS rn, count_if(NOT old) AS cn FROM b GROUP BY ALL),
s AS (SELECT feature, bin, rn / sum(rn) OVER w AS r0, cn / sum(cn) OVER w AS c0 FROM n WINDOW w AS (PARTITION BY feature))
SELECT feature, round(coalesce(sum(r0) FILTER (bin = -1), 0), 6) AS reference_missing, round(coalesce(sum(c0) FILTER (bin = -1), 0), 6) AS current_missing,
  round(sum((greatest(c0, 1e-6) - greatest(r0, 1e-6)) * ln(greatest(c0, 1e-6) / greatest(r0, 1e-6))), 6) AS psi, round(coalesce(sum(c0 - r0) FILTER (bin = -1), 0), 6) AS missing_change FROM s GROUP BY 1""")
def prf_drift(spark, d):
    t = table(spark, d, "lineitem").withColumn("q", F.when(F.col("l_quantity") <= 40, F.col("l_quantity")))
    old = F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz")
    return rounded(profile.drift(t.where(old), t.where(~old), ["q", "l_tax"]))
