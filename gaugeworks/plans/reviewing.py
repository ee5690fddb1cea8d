"""Registered queries on context reviews, saved queues, budgets, domains, audits and segments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugeworks.operators import compare, contracts, evaluate, features, feeds, profile, review, spc, splits
from gaugeworks.plans.registry import LIMITS, SCORES, known, query, rounded, scores, table

# Context reviews

CONTEXT = """rw AS (SELECT user_id, event_id, ts, CASE WHEN event_id % 13 <> 0 THEN value END AS value FROM events WHERE event_type <> 'error'),
ch AS (SELECT user_id, event_id, ts AS at FROM events WHERE event_type = 'error' AND event_id % 5 = 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM rw),
bs AS (SELECT user_id, min(ts) AS a, max(ts) AS b, user_id % 9 = 0 AS flagged FROM rk WHERE rn <= 10 AND user_id % 17 <> 0 GROUP BY user_id),
sp AS (SELECT user_id, min(ts) AS f, max(ts) AS l FROM rw GROUP BY 1),
cv AS (SELECT user_id, f AS s, CASE WHEN user_id % 6 = 0 THEN f ELSE l END AS e, user_id % 4 <> 0 AS complete FROM sp WHERE user_id % 19 <> 0)"""


def context(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    rows = e.where("event_type <> 'error'").withColumn("value", F.when(F.col("event_id") % 13 != 0, F.col("value"))).drop("event_type")
    changes = e.where("event_type = 'error' and event_id % 5 = 0").select("user_id", "event_id", F.col("ts").alias("effective_at"))
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("rn <= 10")
    base = first.where("user_id % 17 <> 0").groupBy("user_id").agg(F.min("ts").alias("baseline_start"), F.max("ts").alias("baseline_end")).withColumn("flagged", F.col("user_id") % 9 == 0)
    spans = rows.groupBy("user_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    coverage = spans.where("user_id % 19 <> 0").select("user_id", F.col("first").alias("start"), F.when(F.col("user_id") % 6 == 0, F.col("first")).otherwise(F.col("last")).alias("end"), (F.col("user_id") % 4 != 0).alias("complete"))
    return rows, changes, base, spans, coverage


@query(f"""WITH {CONTEXT}, n AS (SELECT r.user_id, r.event_id, count(*) FILTER (c.at BETWEEN b.a AND b.b) AS i, count(*) FILTER (c.at > b.b AND c.at <= r.ts) AS p, any_value(r.value) AS value, any_value(b.b) AS base, coalesce(any_value(b.flagged), false) AS flagged,
  coalesce(string_agg(c.event_id::VARCHAR, ',' ORDER BY c.at, c.event_id) FILTER (c.at BETWEEN b.a AND b.b OR (c.at > b.b AND c.at <= r.ts)), '') AS related,
  coalesce(any_value(v.complete) AND any_value(v.s) <= any_value(s.f) AND any_value(v.e) >= any_value(s.l), false) AS covered
  FROM rw r JOIN sp s ON s.user_id = r.user_id LEFT JOIN bs b ON b.user_id = r.user_id LEFT JOIN cv v ON v.user_id = r.user_id LEFT JOIN ch c ON c.user_id = r.user_id GROUP BY ALL)
SELECT event_id, i AS changes_inside, p AS changes_after, related AS related_changes, array_to_string(list_filter([CASE WHEN NOT covered THEN 'history_coverage_unverified' END, CASE WHEN base IS NULL THEN 'baseline_absent' END, CASE WHEN i > 0 THEN 'change_inside_baseline' END,
  CASE WHEN p > 0 THEN 'change_after_baseline' END, CASE WHEN value IS NULL THEN 'measurement_missing' END, CASE WHEN flagged THEN 'statistical_baseline_requires_review' END], lambda y: y IS NOT NULL), ',') AS hold_reasons FROM n""")
def rev_context_review(spark, d):
    rows, changes, base, _, coverage = context(spark, d)
    out = review.context_holds(rows, changes, base, "user_id", coverage=coverage, change_id="event_id")
    return out.select("event_id", "changes_inside", "changes_after", F.array_join(F.transform("related_changes", lambda x: x.cast("string")), ",").alias("related_changes"), F.array_join("hold_reasons", ",").alias("hold_reasons"))


@query(f"""WITH {CONTEXT} SELECT CASE WHEN b.user_id IS NULL THEN 'other_stream' WHEN c.at < s.f THEN 'before_baseline' WHEN c.at <= b.b THEN 'baseline' WHEN c.at <= s.l THEN 'monitoring' ELSE 'scheduled' END AS period, count(*) AS n
FROM ch c LEFT JOIN bs b ON b.user_id = c.user_id LEFT JOIN sp s ON s.user_id = c.user_id GROUP BY 1""")
def rev_timeline(spark, d):
    _, changes, base, spans, _ = context(spark, d)
    mine, other = review.change_timeline(changes, spans.join(base.select("user_id", "baseline_end"), "user_id"), "user_id")
    return mine.select("period").union(other.select(F.lit("other_stream"))).groupBy("period").agg(F.count("*").alias("n"))


@query(f"""WITH {CONTEXT}, cut AS (SELECT quantile_disc(ts, 0.9) AS t FROM rw), h AS (SELECT user_id, CASE WHEN user_id % 8 = 0 THEN t + INTERVAL 1 DAY ELSE t END AS pub, s, e FROM cv, cut),
r AS (SELECT user_id, 'measurement_after_cutoff' AS reason FROM rw, cut WHERE ts > t UNION ALL SELECT user_id, 'history_unavailable_at_cutoff' FROM h, cut WHERE pub > t UNION ALL SELECT user_id, 'coverage_dates_invalid' FROM h WHERE s > e OR e > pub
  UNION ALL SELECT c.user_id, 'change_postdates_history' FROM ch c LEFT JOIN h USING (user_id) WHERE coalesce(c.at > pub, true)) SELECT user_id, reason, count(*) AS n FROM r GROUP BY ALL""")
def rev_knowledge_cutoff(spark, d):
    rows, changes, _, _, coverage = context(spark, d)
    at = rows.agg(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY unix_micros(cast(ts AS timestamp)))")).first()[0] or 0
    as_of = F.timestamp_micros(F.lit(int(at))).cast("timestamp_ntz")
    history = coverage.withColumn("available_at", F.when(F.col("user_id") % 8 == 0, as_of + F.expr("interval 1 day")).otherwise(as_of))
    return review.knowledge_cutoff(rows, history, changes.withColumnRenamed("effective_at", "available_at"), "user_id", as_of)


@query("""SELECT CASE WHEN event_id % 4 = 0 THEN 'evidence_digest_differs' ELSE '' END || CASE WHEN event_id % 12 = 0 THEN ',' ELSE '' END || CASE WHEN event_id % 3 = 0 THEN 'review_id_not_of_source' ELSE '' END AS reasons, count(*) AS n
FROM events WHERE event_id % 4 = 0 OR event_id % 3 = 0 GROUP BY 1""")
def rev_queue_integrity(spark, d):
    q = table(spark, d, "events").select(F.col("event_id").alias("sample_id"), F.col("ts").alias("event_time"), "value", F.lit("pressure").alias("measurement"), F.sha2(F.col("user_id").cast("string"), 256).alias("source_sha256"))
    names = ["sample_id", "event_time", "measurement", "value"]
    q = q.withColumn("evidence_sha256", review.evidence_digest(names)).withColumn("review_id", review.review_identity(F.col("source_sha256"), F.col("sample_id"), F.col("measurement")))
    q = q.withColumn("value", F.when(F.col("sample_id") % 4 == 0, F.col("value") + 1).otherwise(F.col("value"))).withColumn("review_id", F.when(F.col("sample_id") % 3 == 0, F.reverse("review_id")).otherwise(F.col("review_id")))
    return review.queue_integrity(q, names).groupBy(F.array_join("reasons", ",").alias("reasons")).agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT l_orderkey AS r, l_linenumber AS k, count(*) AS n FROM lineitem WHERE l_linenumber <> 2 OR l_orderkey % 3 <> 0 GROUP BY ALL UNION ALL SELECT l_orderkey, 99, 1 FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey % 11 = 0)),
o AS (SELECT DISTINCT l_orderkey AS r, l_linenumber AS k FROM lineitem), j AS (SELECT coalesce(o.r, g.r) AS r, o.k IS NULL OR coalesce(g.n, 0) > 1 AS odd, g.k IS NULL AS lacks FROM o FULL JOIN g ON o.r = g.r AND o.k = g.k), s AS (SELECT r, bool_or(odd) AS odd, bool_or(lacks) AS lacks FROM j GROUP BY 1)
SELECT CASE WHEN odd THEN 'SUBSTITUTED' WHEN lacks THEN 'MISSING' ELSE 'MATCH' END AS state, count(*) AS n FROM s GROUP BY 1""")
def rev_receipt_sets(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    foreign = li.where("l_orderkey % 11 = 0").select("l_orderkey", F.lit(99).alias("l_linenumber"))
    got = li.where("l_linenumber <> 2 or l_orderkey % 3 <> 0").unionByName(foreign.withColumn("l_linenumber", F.col("l_linenumber").cast(li.schema["l_linenumber"].dataType)))
    return review.receipt_sets(li, got, "l_orderkey", "l_linenumber").groupBy("state").agg(F.count("*").alias("n"))


# Score tables


@query(f"""WITH {SCORES}, a AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id::VARCHAR) AS rank FROM scores), b0 AS (SELECT id, CASE WHEN id % 20 = 0 THEN score2 ELSE score END AS score FROM scores WHERE id % 31 <> 0),
b AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id::VARCHAR) AS rank FROM b0), j AS (SELECT coalesce(a.id, b.id) AS id, a.score AS s, b.score AS t, a.rank AS r, b.rank AS q FROM a FULL JOIN b ON a.id = b.id)
SELECT count_if(t IS NULL OR abs(s - t) > 1e-9) AS score, count_if(r IS DISTINCT FROM q) AS rank, count_if((s >= 0.5) IS DISTINCT FROM (t >= 0.5)) AS prediction, count_if((r <= 50) IS DISTINCT FROM (q <= 50)) AS selected FROM j""")
def cmp_priority_changes(spark, d):
    from gaugeworks.operators.models import priority_table

    s, t = scores(spark, d), scores(spark, d, 104729).select("id", F.col("score").alias("score2"))
    after = s.join(t, "id").where("id % 31 <> 0").select("id", "label", F.when(F.col("id") % 20 == 0, F.col("score2")).otherwise(F.col("score")).alias("score"))
    found = compare.priority_changes(priority_table(s, "id", 0.5), priority_table(after, "id", 0.5), 50)
    return found.agg(*[F.count_if(F.exists("changes", lambda c: c["field"] == f)).alias(f) for f in ("score", "rank", "prediction", "selected")])


@query("""WITH c AS (SELECT count(*) AS n, count_if(o_orderkey % 3 <> 0) AS e, count_if(o_orderkey % 30 = 0) AS twice, count_if(o_orderkey % 21 = 0) AS lost, count_if(o_orderkey % 50 = 0) AS other FROM orders),
g AS (SELECT 'parted' AS gate, 0::BIGINT AS in_both, 0::BIGINT AS in_neither, 0::BIGINT AS "foreign", n AS original_count, e AS eligible_count FROM c UNION ALL SELECT 'overlap', twice, 0, 0, n, e + twice FROM c UNION ALL SELECT 'not_parted', 0, lost, other, n, e FROM c)
SELECT *, (eligible_count * 7 + 99) // 100 AS expected_k, CASE WHEN in_both > 0 THEN 'eligible_and_held_overlap' WHEN in_neither + "foreign" > 0 THEN 'original_not_parted' WHEN (eligible_count * 7 + 99) // 100 <> 50 THEN 'declared_k_differs' END AS reason FROM g""")
def cmp_budget_gate(spark, d):
    """Three gates over all orders: parted as declared; some orders on both sides; some on neither, and some that aren't orders."""
    o = table(spark, d, "orders").select("o_orderkey")
    eligible, held = o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 3 = 0")
    sides = {
        "parted": (eligible, held), "overlap": (eligible.unionByName(o.where("o_orderkey % 30 = 0")), held),
        "not_parted": (eligible, held.where("o_orderkey % 21 <> 0").unionByName(o.where("o_orderkey % 50 = 0").select((-1 - F.col("o_orderkey")).alias("o_orderkey")))),
    }
    found = [compare.budget_gate(o, a, b, "o_orderkey", 50, numerator=7, denominator=100).withColumn("gate", F.lit(name)) for name, (a, b) in sides.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(f"""WITH {SCORES}, k AS (SELECT d.lang, d.source, s.id, s.label, s.score FROM known s JOIN documents d ON d.doc_id = s.id), r AS (SELECT lang AS protocol, source AS domain, id, label, score FROM k UNION ALL SELECT lang, NULL, id, label, score FROM k),
q AS (SELECT *, row_number() OVER (PARTITION BY protocol, domain ORDER BY score DESC, id::VARCHAR) AS rk, count(*) OVER (PARTITION BY protocol, domain) AS n FROM r),
g AS (SELECT protocol, domain, score, count(*) AS m, sum(label) AS pos FROM r GROUP BY ALL), c AS (SELECT *, sum(m) OVER w AS seen, sum(pos) OVER w AS hits FROM g WINDOW w AS (PARTITION BY protocol, domain ORDER BY score DESC)),
u AS (SELECT protocol, domain, sum(pos * hits / seen) / nullif(sum(pos), 0) AS ap, (sum(pos * ((m - pos) / 2 - (seen - hits))) + sum(pos) * sum(m - pos)) / nullif(sum(pos) * sum(m - pos), 0) AS auc FROM c GROUP BY ALL),
f AS (SELECT protocol, domain, count(*) AS n, sum(label)::BIGINT AS positives, coalesce(count_if(score >= 0.5 AND label = 1) / nullif(count_if(label = 1), 0), 0) AS recall, coalesce(count_if(score >= 0.5 AND label <> 1) / nullif(count_if(label <> 1), 0), 0) AS fa, coalesce(sum(label) FILTER (rk <= ceil(n * 0.1::DOUBLE)), 0)::BIGINT AS captured FROM q GROUP BY ALL)
SELECT f.protocol, f.domain, n, positives, round(ap, 6) AS average_precision, round(auc, 6) AS roc_auc, round(recall, 6) AS recall, round(fa, 6) AS false_alarm_rate, captured FROM f JOIN u ON f.protocol = u.protocol AND f.domain IS NOT DISTINCT FROM u.domain""")
def eval_domain_metrics(spark, d):
    df = known(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("protocol"), F.col("source").alias("domain")), "id")
    return rounded(evaluate.by_domain(df, "protocol", "domain"))


@query(f"""WITH {SCORES}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id::VARCHAR) AS rk FROM known), t AS (SELECT count(*) AS n, sum(label) AS total FROM known),
b AS (SELECT f::DOUBLE AS fraction, ceil((SELECT n FROM t) * f::DOUBLE)::BIGINT AS k FROM (VALUES (0.05), (0.12), (0.2), (0.5)) v(f)), h0 AS (SELECT fraction, k, coalesce(sum(label), 0) AS c FROM b JOIN r ON rk <= k GROUP BY fraction, k), h AS (SELECT fraction, k, k + (total - c) * 20 AS cost FROM h0, t)
SELECT * FROM (SELECT 'least_cost' AS choice, fraction, k AS inspected, cost::DOUBLE AS cost FROM h ORDER BY cost, fraction LIMIT 1) UNION ALL SELECT * FROM (SELECT 'nearest', fraction, k, cost::DOUBLE FROM h ORDER BY abs(fraction - 0.1), fraction LIMIT 1)""")
def eval_cost_choices(spark, d):
    return evaluate.cost_choices(evaluate.top_k(known(spark, d), [0.05, 0.12, 0.2, 0.5])).select("choice", "fraction", "inspected", "cost")


@query("""WITH s AS (SELECT o_orderstatus AS f, left(o_orderpriority, 1) AS m, avg(o_totalprice) AS v, count(*) AS c FROM orders GROUP BY ALL)
SELECT a.f AS o_orderstatus, a.m || '-' || b.m AS contrast, round(a.v - b.v, 4) AS v_difference, a.c - b.c AS c_difference, abs(a.v - b.v) > 1e-3 AND (a.v - b.v) * (a.c - b.c) < 0 AS disagree FROM s a JOIN s b ON a.f = b.f AND ((a.m = '1' AND b.m = '5') OR (a.m = '2' AND b.m = '3'))""")
def eval_disagreement(spark, d):
    s = table(spark, d, "orders").groupBy("o_orderstatus", F.substring("o_orderpriority", 1, 1).alias("mode")).agg(F.avg("o_totalprice").alias("v"), F.count("*").alias("c"))
    return rounded(evaluate.disagreement(s, "o_orderstatus", "mode", "v", "c", [("1", "5"), ("2", "3")]), 4)


# Audits

LABELLED = "ev AS (SELECT *, (user_id % 5 = 0)::INT AS label FROM events)"


def labelled(spark, d):
    return table(spark, d, "events").withColumn("label", (F.col("user_id") % 5 == 0).cast("int"))


@query(f"""WITH {LABELLED}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type, label ORDER BY value DESC, event_id) AS rk, max(value) OVER (PARTITION BY event_type, label) AS top FROM ev)
SELECT event_type, label, max(CASE WHEN rk = 1 THEN event_id END) AS excluded_id, round(max(value), 6) AS largest, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count_if(value = top) AS ties, round(avg(value) FILTER (rk > 1), 6) AS mean_without_max, round(stddev_samp(value) FILTER (rk > 1), 6) AS std_without_max
FROM r GROUP BY ALL""")
def prf_maximum_sensitivity(spark, d):
    return rounded(profile.without_maximum(labelled(spark, d), "event_type", "label", "value", "event_id"))


@query(f"""WITH {LABELLED}, s AS (SELECT event_type, strftime(ts, '%Y-%m') AS month, label, count(*) AS n, count(value) AS observed, avg(value) AS mean, stddev_samp(value) AS std, quantile_cont(value, [0.05, 0.25, 0.5, 0.75, 0.95]) AS q FROM ev GROUP BY ALL)
SELECT event_type, month, label, n, observed, round(1 - observed / n, 6) AS missing_rate, round(mean, 6) AS mean, round(std, 6) AS std, round(q[1], 6) AS q5, round(q[2], 6) AS q25, round(q[3], 6) AS q50, round(q[4], 6) AS q75, round(q[5], 6) AS q95 FROM s""")
def prf_summary_by_month(spark, d):
    return rounded(profile.group_summary_by_month(labelled(spark, d), "event_type", "label", "value", "ts"))


@query("""SELECT count(*) AS readings, count(DISTINCT user_id) AS assets, min(ts) AS event_time_min, max(ts) AS event_time_max, count_if(event_type = 'error') + count_if(event_id % 3 = 0) AS missing_cells, round((count_if(event_type = 'error') + count_if(event_id % 3 = 0)) / (count(*) * 2), 6) AS missing_rate FROM events""")
def prf_quality_report(spark, d):
    e = table(spark, d, "events").withColumn("measurement__a", F.when(F.col("event_type") != "error", F.col("value"))).withColumn("measurement__b", F.when(F.col("event_id") % 3 != 0, F.col("value")))
    return rounded(profile.quality_report(e, "user_id", "ts", ["measurement__a", "measurement__b"]))


@query("""WITH r AS (SELECT ts, lag(ts) OVER (ORDER BY user_id * 1000000 + event_id) AS last FROM events WHERE event_id % 50 <> 0)
SELECT (SELECT count(*) FROM events WHERE event_id % 50 = 0) AS time_failures, (SELECT min(ts) FROM r) AS time_min, (SELECT max(ts) FROM r) AS time_max, (SELECT count(ts) - count(DISTINCT ts) FROM r) AS repeated_time_rows, 1::BIGINT AS all_missing, (SELECT count_if(ts < last) FROM r) AS time_reversals, 1::BIGINT AS duplicate_features""")
def prf_audit_order(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") * 1_000_000 + F.col("event_id")).alias("position"), F.when(F.col("event_id") % 50 != 0, F.col("ts")).alias("ts"), F.col("value").alias("a"), F.col("value").alias("b"), (F.col("value") + 1).alias("c"), F.lit(None).cast("double").alias("e"))
    return profile.audit_order(e, ["a", "b", "c", "e"], "ts", "position")


# Segments, maps and exports


@query("""WITH s AS (SELECT user_id, event_type, value, value - lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS step FROM events WHERE event_type IN ('click', 'view')),
c AS (SELECT user_id, event_type, avg(value) AS mean, sqrt(avg(step * step)) AS d FROM s GROUP BY ALL) SELECT u.user_id, round(max(mean) FILTER (event_type = 'click'), 6) AS click_mean, round(max(d) FILTER (event_type = 'click'), 6) AS click_diff_rms, round(max(mean) FILTER (event_type = 'view'), 6) AS view_mean
FROM (SELECT DISTINCT user_id FROM events WHERE event_type IN ('click', 'view')) u LEFT JOIN c ON c.user_id = u.user_id GROUP BY 1""")
def fea_segments(spark, d):
    e = table(spark, d, "events").where("event_type in ('click', 'view')")
    out = features.segment_features(e, "user_id", "event_type", ["ts", "event_id"], "value", ["click", "view"])
    return rounded(out.select("user_id", "click_mean", "click_diff_rms", "view_mean"))


@query("""SELECT 'line_' || (user_id % 7) || '_dataLog_x' AS recording_group, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1 UNION ALL SELECT 'plain_' || (user_id % 3), count(*) FROM events WHERE event_id % 2 = 1 GROUP BY 1""")
def fea_recording_group(spark, d):
    twice = F.concat(F.lit("line_"), F.col("user_id") % 7, F.lit("_dataLog_x_dataLog_"), F.col("event_id"))
    name = F.when(F.col("event_id") % 2 == 0, twice).otherwise(F.concat(F.lit("plain_"), F.col("user_id") % 3))
    return table(spark, d, "events").groupBy(features.recording_group(name).alias("recording_group")).agg(F.count("*").alias("n"))


@query("""SELECT user_id, round(sum(value) FILTER (event_type = 'click'), 4) AS measurement__click, round(sum(value) FILTER (event_type = 'error'), 4) AS measurement__error, round(sum(value) FILTER (event_type = 'purchase'), 4) AS measurement__purchase, round(sum(value) FILTER (event_type = 'signup'), 4) AS measurement__signup, round(sum(value) FILTER (event_type = 'view'), 4) AS measurement__view
FROM events GROUP BY 1""")
def fea_measurement_columns(spark, d):
    m = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 4).alias("v")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("reading"))
    return features.measurement_columns(m, "reading", ["click", "error", "purchase", "signup", "view"])


@query("""WITH m AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'train' ELSE 'test' END AS split, o_orderstatus AS label, o_orderkey AS a, o_orderkey + CASE WHEN o_orderkey % 100 = 0 THEN 1 ELSE 100000000 END AS b FROM orders),
f AS (SELECT split, a AS x FROM m UNION ALL SELECT split, b FROM m), g AS (SELECT x, count(*) AS n, count(DISTINCT split) AS s FROM f GROUP BY 1 HAVING count(*) > 1)
SELECT CASE WHEN s > 1 THEN 'file_across_splits' ELSE 'file_within_split' END AS kind, count(*) AS findings, sum(n)::BIGINT AS n FROM g GROUP BY 1 UNION ALL SELECT 'count', count(*), sum(n)::BIGINT FROM (SELECT split, label, count(*) AS n FROM m WHERE label <> 'F' GROUP BY ALL)""")
def con_split_mapping(spark, d):
    o = table(spark, d, "orders")
    m = o.select(F.when(F.col("o_orderkey") % 2 == 0, "train").otherwise("test").alias("split"), F.col("o_orderstatus").alias("label"), F.col("o_orderkey").alias("a"), (F.col("o_orderkey") + F.when(F.col("o_orderkey") % 100 == 0, 1).otherwise(100_000_000)).alias("b"))
    expected = m.groupBy("split", "label").agg(F.count("*").alias("n")).withColumn("n", F.when(F.col("label") == "F", F.col("n")).otherwise(F.col("n") + 1))
    return contracts.split_mapping(m, ["a", "b"], "label", expected).groupBy("kind").agg(F.count("*").alias("findings"), F.sum("n").alias("n"))


@query("""WITH r AS (SELECT user_id, event_id, ts, CASE WHEN event_id % 10 = 0 THEN 'bad' WHEN event_id % 10 = 1 THEN 'neg' WHEN event_id % 10 = 2 THEN 'zone' ELSE '' END AS k, event_id % 10 = 2 AS nozone FROM events),
l AS (SELECT *, lag(nozone) OVER w AS last_nozone, lag(date_trunc('second', ts)) OVER w AS last_s, lag(event_id) OVER w AS last_id FROM r WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
z AS (SELECT k, nozone, coalesce(NOT nozone AND NOT last_nozone AND (date_trunc('second', ts) < last_s OR (date_trunc('second', ts) = last_s AND false)), false) AS back FROM l)
SELECT array_to_string(list_filter([CASE WHEN nozone THEN 'time_not_zoned' END, CASE WHEN back THEN 'time_not_increasing' END, CASE WHEN k = 'bad' THEN 'value_not_numeric' END, CASE WHEN k = 'neg' THEN 'value_negative' END], lambda y: y IS NOT NULL), ',') AS reasons, count(*) AS n FROM z GROUP BY 1""")
def con_screening_input(spark, d):
    """Within a second, times differ by a fraction of twelve digits, beyond what a timestamp holds."""
    second = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.concat(second, F.lit("."), F.lpad(F.col("event_id").cast("string"), 12, "0"), F.when(F.col("event_id") % 10 != 2, F.lit("+00:00")).otherwise(F.lit("")))
    value = F.when(F.col("event_id") % 10 == 0, "1,5").when(F.col("event_id") % 10 == 1, "-0.5").otherwise(F.col("value").cast("string"))
    e = table(spark, d, "events").select("user_id", "event_id", text.alias("time"), value.alias("reading"))
    out = contracts.screening_input(e, ["user_id"], "event_id", "time", "reading")
    return out.groupBy(F.array_join("reasons", ",").alias("reasons")).agg(F.count("*").alias("n"))


@query(f"""WITH {LIMITS}, q AS (SELECT user_id, event_id, ts, status, CASE status WHEN 'above_limit' THEN (value - ucl) / (ucl - center) WHEN 'below_limit' THEN (lcl - value) / (center - lcl) END AS severity, CASE status WHEN 'baseline_review_required' THEN 0 ELSE 1 END AS tier,
  left(sha256(concat_ws(':', sha256('events'), event_id::VARCHAR, 'pressure')), 24) AS review_id FROM chart WHERE status <> 'within_limits')
SELECT event_id, review_id, row_number() OVER (ORDER BY tier, -coalesce(severity, 0), ts, review_id) AS place FROM q""")
def spc_review_package(spark, d):
    chart = spc.individuals_chart(table(spark, d, "events"), "user_id", ["ts", "event_id"])
    return spc.review_package(chart, "user_id", "event_id", "pressure", F.sha2(F.lit("events").cast("binary"), 256)).select("event_id", "review_id", F.col("place").cast("long").alias("place"))


@query("""WITH bad AS (SELECT DISTINCT user_id FROM events WHERE event_id % 400 = 0), g AS (SELECT * FROM events WHERE user_id NOT IN (SELECT user_id FROM bad)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS total FROM g), base AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)) AS mr FROM ranked WHERE rn <= 10),
lim AS (SELECT user_id, avg(value) - 3 * avg(mr) / 1.128 AS lcl, avg(value) + 3 * avg(mr) / 1.128 AS ucl, min(value) AS low, max(value) AS high FROM base GROUP BY 1 HAVING count(*) = 10 AND avg(mr) > 0)
SELECT status, count(*) AS n FROM (SELECT CASE WHEN low < lcl OR high > ucl THEN 'baseline_review_required' WHEN value < lcl THEN 'below_limit' WHEN value > ucl THEN 'above_limit' END AS status FROM ranked JOIN lim USING (user_id) WHERE total > 10) WHERE status IS NOT NULL GROUP BY 1
UNION ALL SELECT 'refused', count(*) FROM events WHERE event_id % 400 = 0""")
def spc_screen(spark, d):
    """The position stands in for the time, whose text is made of it so that it rises."""
    time = F.concat(F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id")), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    e = table(spark, d, "events").select("user_id", "event_id", time.alias("time"), F.when(F.col("event_id") % 400 == 0, "oops").otherwise(F.col("value").cast("string")).alias("reading"))
    pending, refused = spc.screen(e, ["user_id"], "event_id", "time", "reading")
    return pending.groupBy("status").agg(F.count("*").alias("n")).unionByName(refused.agg(F.lit("refused").alias("status"), F.count("*").alias("n")))


@query("""WITH s AS (SELECT DISTINCT user_id, epoch_us(ts) // 900000000 * 15 AS m, max(value) OVER (PARTITION BY user_id, epoch_us(ts) // 900000000) AS v FROM events), f AS (SELECT *, m % 60 IN (15, 45) AS st FROM s),
c AS (SELECT *, max(CASE WHEN NOT st THEN m END) OVER (PARTITION BY user_id ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM f)
SELECT array_to_string(list_filter([CASE WHEN st THEN 'structural_value' END, CASE WHEN NOT st AND m - last <> 30 THEN 'not_continuous' END, CASE WHEN user_id % 3 = 0 THEN 'status_not_expected' END], lambda y: y IS NOT NULL), ',') AS reasons, count(*) AS n FROM c GROUP BY 1""")
def con_half_hours(spark, d):
    slot = F.timestamp_seconds(F.floor(feeds.micros("ts") / 900_000_000) * 900)
    e = table(spark, d, "events").groupBy("user_id", slot.alias("slot")).agg(F.max("value").alias("value")).withColumn("nature", F.when(F.col("user_id") % 3 == 0, "Données consolidées").otherwise("Données définitives"))
    good, bad = feeds.half_hours(e, "user_id", "slot", "value", "nature", "definitive")
    return good.select(F.lit("").alias("reasons")).unionByName(bad.select(F.array_join("reasons", ",").alias("reasons"))).groupBy("reasons").agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN event_id % 5 = 0 THEN 'clear_missing' ELSE '' END || CASE WHEN event_id % 5 = 0 AND value > 50 THEN ',' ELSE '' END || CASE WHEN value > 50 THEN 'score_not_valid' ELSE '' END || CASE WHEN value > 50 AND event_id % 7 = 0 AND event_id % 5 <> 0 THEN ',' ELSE '' END
 || CASE WHEN event_id % 7 = 0 AND event_id % 5 <> 0 THEN 'clear_not_boolean' ELSE '' END AS reasons, count(*) AS n FROM events GROUP BY 1""")
def con_reports(spark, d):
    e = table(spark, d, "events")
    full = F.create_map(F.lit("score"), F.col("value").cast("string"), F.lit("clear"), F.when(F.col("event_id") % 7 == 0, "perhaps").otherwise("True"))
    m = e.select(F.when(F.col("event_id") % 5 == 0, F.map_filter(full, lambda k, _: k != "clear")).otherwise(full).alias("report"))
    return contracts.with_reasons(m, feeds.report_rules("report", {"score": (0, 50)}, ["clear"])).groupBy(F.array_join("reasons", ",").alias("reasons")).agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT user_id, ts, count(*) AS c, count_if(event_type = 'click') AS k, count_if(event_id % 17 = 0) AS bad FROM events GROUP BY ALL), r AS (SELECT user_id, ts, k, bad, 1 AS n FROM g UNION ALL SELECT user_id, ts, k, bad, 2 FROM g WHERE user_id % 9 = 0)
SELECT array_to_string(list_filter([CASE WHEN user_id % 13 = 0 THEN 'asset_missing' END, CASE WHEN user_id % 11 = 0 THEN 'time_not_valid' END, CASE WHEN bad > 0 THEN 'value_not_finite' END, CASE WHEN user_id % 9 = 0 AND user_id % 11 <> 0 OR (user_id % 13 = 0 AND user_id % 11 <> 0 AND twice) THEN 'duplicate' END,
  CASE WHEN k = 0 THEN 'click_absent' END], lambda y: y IS NOT NULL), ',') AS reasons, count(*) AS n FROM (SELECT *, user_id % 13 = 0 AND count(*) OVER (PARTITION BY user_id % 13 = 0, ts) > 1 AS twice FROM r) GROUP BY 1""")
def con_open_readings(spark, d):
    e = table(spark, d, "events").withColumn("value", F.when(F.col("event_id") % 17 == 0, float("nan")).otherwise(F.col("value")))
    m = e.groupBy("user_id", "ts").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("event_type", "value")))).alias("reading"))
    asset = F.when(F.col("user_id") % 13 == 0, " ").otherwise(F.concat(F.lit("a"), F.col("user_id")))
    text = F.when(F.col("user_id") % 11 == 0, "1700000000").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    r = m.select(asset.alias("asset_code"), F.lit(None).cast("string").alias("user_ts"), text.alias("ts"), "reading", "user_id")
    r = r.unionByName(r.where("user_id % 9 = 0"))
    return contracts.open_readings(r, ("click",)).groupBy(F.array_join("reasons", ",").alias("reasons")).agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN l_orderkey % 10 = 7 THEN -1 ELSE l_orderkey END, l_linenumber % 2 ORDER BY l_orderkey * 10 + l_linenumber) > 1 AS later FROM lineitem)
SELECT array_to_string(list_filter([CASE WHEN l_orderkey % 10 = 7 THEN 'id_missing' END, CASE WHEN l_linenumber = 2 OR l_linenumber = 4 AND l_orderkey % 10 = 3 THEN 'value_not_valid' END, CASE WHEN later THEN 'board_and_pad_repeated' END], lambda y: y IS NOT NULL), ',') AS reasons, count(*) AS n FROM l GROUP BY 1""")
def con_board_rows(spark, d):
    li = table(spark, d, "lineitem")
    board = F.when(F.col("l_orderkey") % 10 == 7, "  ").otherwise(F.col("l_orderkey").cast("string"))
    value = F.col("l_quantity").cast("string")
    value = F.when(F.col("l_linenumber") == 2, F.concat(F.lit("-"), value)).when((F.col("l_linenumber") == 4) & (F.col("l_orderkey") % 10 == 3), F.concat(value, F.lit("mm"))).otherwise(value)
    rows = li.select(board.alias("board"), (F.col("l_linenumber") % 2).alias("pad"), value.alias("v"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return contracts.board_rows(rows, "board", "pad", "v", "at").groupBy(F.array_join("reasons", ",").alias("reasons")).agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'train' ELSE 'test' END AS split, count(*) AS n, sum((event_type = 'error')::INT)::BIGINT AS fails, round(avg((event_type = 'error')::INT), 6) AS fail_rate, min(ts) AS time_min, max(ts) AS time_max FROM events GROUP BY 1""")
def prf_split_summary(spark, d):
    e = table(spark, d, "events").withColumn("fail", (F.col("event_type") == "error").cast("int")).withColumn("split", F.when(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"), "train").otherwise("test"))
    return rounded(profile.split_summary(e, "split", "fail", "ts"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE user_id IN (3, 7) AND event_id <= CASE user_id WHEN 3 THEN 7000 ELSE 5000 END)
SELECT user_id, event_id, ts, value, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) > 43200000000, false) AS break_before FROM r WHERE rn <= 20""")
def prf_trace(spark, d):
    return profile.trace(table(spark, d, "events"), "user_id", "event_id", "ts", "value", {3: 7000, 7: 5000}, 20, 43_200)


@query("""WITH s AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, (event_id % 9 = 0)::INT + (event_type = 'error')::INT AS odd FROM events)
SELECT user_id, count(*) AS n_rows, quantile_cont(step::DOUBLE, 0.5) AS median_step_us, max(step) AS largest_step_us, count_if(coalesce(step <= 0, false)) AS not_increasing, count_if(coalesce(step > 43200000000, false)) AS long_steps, sum(odd)::BIGINT AS nonfinite_cells FROM s GROUP BY 1""")
def prf_process_cadence(spark, d):
    e = table(spark, d, "events").withColumn("a", F.when(F.col("event_id") % 9 != 0, F.col("value"))).withColumn("b", F.when(F.col("event_type") == "error", float("inf")).otherwise(F.col("value")))
    return profile.process_cadence(e, "user_id", ["ts", "event_id"], "ts", ["a", "b"], 43_200)


@query(f"""WITH {SCORES}, n AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS p, count(*) OVER () AS c FROM known), m AS (SELECT max(c) AS c FROM n), dr AS (SELECT r.i // c AS rep, r.i % c AS i, c FROM m, range(30 * c) r(i)),
j AS (SELECT rep, i, dr.c, score, label, row_number() OVER (PARTITION BY rep ORDER BY score DESC, id::VARCHAR, i) AS rk FROM dr JOIN n ON ('0x' || substr(md5('1:' || rep || ':' || i), 1, 15))::BIGINT % dr.c = p),
k AS (SELECT rep, f::DOUBLE AS fraction, any_value(ceil(c * f::DOUBLE)) AS cut, sum(label) AS total, coalesce(sum(label) FILTER (rk <= ceil(c * f::DOUBLE)), 0) AS hit FROM j, (VALUES (0.1), (0.3)) v(f) GROUP BY ALL HAVING sum(label) > 0)
SELECT fraction, count(*) AS replicates, round(avg(hit / total), 6) AS mean, round(quantile_cont(hit / total, 0.025), 6) AS low, round(quantile_cont(hit / total, 0.975), 6) AS high,
  round(avg(hit / cut), 6) AS precision_mean, round(quantile_cont(hit / cut, 0.025), 6) AS precision_low, round(quantile_cont(hit / cut, 0.975), 6) AS precision_high FROM k GROUP BY 1""")
def eval_capture_interval(spark, d):
    k = known(spark, d)
    return rounded(evaluate.capture_interval(splits.bootstrap_draws(k.select("id"), "id", 30), k, [0.1, 0.3]))


def md5_uniform(rep, name):
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("1"), rep.cast("string"), name.cast("string")).cast("binary")), 1, 13), 16, 10).cast("long") / float(1 << 52)


@query(f"""WITH {SCORES}, u AS (SELECT r.i AS rep, id, round(score, 2) AS score, label, ('0x' || substr(md5('1:' || r.i || ':' || id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM known, range(40) r(i)),
w AS (SELECT *, CASE {" ".join(f"WHEN u < {t!r}::DOUBLE THEN {i}" for i, t in enumerate(evaluate.poisson_thresholds()))} ELSE 17 END AS w FROM u),
g AS (SELECT rep, score, sum(w) AS w, sum(w * label) AS p FROM w WHERE w > 0 GROUP BY ALL), r AS (SELECT *, sum(w) OVER (PARTITION BY rep ORDER BY score DESC) - w AS b, sum(p) OVER (PARTITION BY rep ORDER BY score DESC) - p AS h, sum(w) OVER (PARTITION BY rep) AS n, sum(p) OVER (PARTITION BY rep) AS total FROM g),
k AS (SELECT rep, f::DOUBLE AS fraction, ceil(n * f::DOUBLE) AS cut, total, h + p * (ceil(n * f::DOUBLE) - b) / w AS hit FROM r, (VALUES (0.1), (0.3)) v(f) WHERE b < ceil(n * f::DOUBLE) AND ceil(n * f::DOUBLE) <= b + w AND total > 0)
SELECT fraction, count(*) AS replicates, round(avg(hit / total), 6) AS mean, round(quantile_cont(hit / total, 0.025), 6) AS low, round(quantile_cont(hit / total, 0.975), 6) AS high,
  round(avg(hit / cut), 6) AS precision_mean, round(quantile_cont(hit / cut, 0.025), 6) AS precision_low, round(quantile_cont(hit / cut, 0.975), 6) AS precision_high FROM k GROUP BY 1""")
def eval_poisson_interval(spark, d):
    k = known(spark, d).withColumn("score", F.round("score", 2))
    return rounded(evaluate.poisson_interval(k, [0.1, 0.3], 40, groups=16, uniform=md5_uniform))


@query("""WITH q AS (SELECT o_orderkey AS r FROM orders WHERE o_orderkey % 3 <> 0), dc AS (SELECT l_orderkey AS r, l_linenumber AS n, l_shipdate AS d_at, count(*) OVER (PARTITION BY l_orderkey) AS c FROM lineitem WHERE l_linenumber IN (1, 5) AND l_orderkey % 5 <> 0),
w AS (SELECT dc.*, CASE WHEN q.r IS NULL THEN 'unknown_review' WHEN c > 1 THEN 'decided_twice' WHEN d_at > TIMESTAMP '1998-01-01' THEN 'decided_after_recording' WHEN n = 5 THEN 'outcome_not_allowed' END AS reason FROM dc LEFT JOIN q ON q.r = dc.r)
SELECT coalesce(reason, 'decided') AS state, count(*) AS n FROM w GROUP BY 1 UNION ALL SELECT 'pending', count(*) FROM q WHERE r NOT IN (SELECT r FROM w WHERE reason IS NULL)""")
def rev_decisions(spark, d):
    queue = table(spark, d, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("review_id"))
    li = table(spark, d, "lineitem").where("l_linenumber in (1, 5) and l_orderkey % 5 <> 0")
    decisions = li.select(F.col("l_orderkey").alias("review_id"), F.col("l_shipdate").alias("decided_at"), F.lit("1998-01-01").cast("timestamp_ntz").alias("recorded_at"), F.when(F.col("l_linenumber") == 1, "false_alarm").otherwise("other").alias("outcome"), F.lit("release").alias("action"))
    bound, rejected = review.bind_decisions(queue, decisions)
    return bound.select("state").unionByName(rejected.select(F.col("reason").alias("state"))).groupBy("state").agg(F.count("*").alias("n"))
