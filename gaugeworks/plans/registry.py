"""All registered queries: operators bound to the driver's tables, each with its SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators import compare, contracts, evaluate, features, profile, review, spc, splits
from gaugeworks.operators.contracts import Rule
from gaugeworks.streaming import readings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def components(df: DataFrame, vector: str) -> tuple[DataFrame, list[str]]:
    """df with a double column for each component of the longest vector, and their names; shorter vectors have nulls."""
    size = df.agg(F.max(F.size(vector))).first()[0] or 0
    names = [f"feature_{i:03d}" for i in range(size)]
    return df.select("*", *[F.get(vector, F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)]), names


def events(spark: SparkSession, d: str) -> DataFrame:
    """Error readings count as missing."""
    return table(spark, d, "events").withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))


def scores(spark: SparkSession, d: str, factor: int = 7919) -> DataFrame:
    s = F.round((F.col("doc_id") * factor % 1000) / 1000.0, 3)
    return table(spark, d, "documents").select("doc_id", s.alias("score")).join(table(spark, d, "labels"), "doc_id", "left").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"), "score")


def known(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).where("label is not null")


EVENTS = "ev AS (SELECT event_id, ts, user_id, event_type, CASE WHEN event_type <> 'error' THEN value END AS value FROM events)"
SCORES = """scores AS (SELECT d.doc_id AS id, l.toxic AS label, round((d.doc_id * 7919 % 1000) / 1000.0, 3)::DOUBLE AS score,
  round((d.doc_id * 104729 % 1000) / 1000.0, 3)::DOUBLE AS score2 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
known AS (SELECT * FROM scores WHERE label IS NOT NULL)"""
LIMITS = """ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
base AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS mr FROM ranked WHERE rn <= 10),
lim AS (SELECT user_id, avg(value) AS center, avg(value) - 3 * avg(mr) / 1.128 AS lcl, avg(value) + 3 * avg(mr) / 1.128 AS ucl, min(value) AS low, max(value) AS high, avg(mr) AS mr
  FROM base GROUP BY 1 HAVING count(*) = 10),
chart AS (SELECT r.event_id, r.user_id, r.ts, r.value, l.center, l.lcl, l.ucl,
  CASE WHEN l.low < l.lcl OR l.high > l.ucl THEN 'baseline_review_required' WHEN r.value < l.lcl THEN 'below_limit' WHEN r.value > l.ucl THEN 'above_limit' ELSE 'within_limits' END AS status
  FROM ranked r JOIN lim l USING (user_id) WHERE l.mr > 0 AND (SELECT count(*) FROM ranked x WHERE x.user_id = r.user_id) > 10)"""


# Statistical process control


@query(f"WITH {LIMITS} SELECT user_id, round(center, 6) AS center, round(lcl, 6) AS lcl, round(ucl, 6) AS ucl, (low < lcl OR high > ucl) AS suspect FROM lim")
def spc_limits(spark, d):
    return rounded(spc.individuals_limits(table(spark, d, "events"), "user_id", ["ts", "event_id"]).where("baseline_state <> 'baseline_too_short'").drop("baseline_state"))


@query(f"WITH {LIMITS} SELECT user_id, status, count(*) AS n FROM chart GROUP BY ALL")
def spc_status_counts(spark, d):
    return spc.individuals_chart(table(spark, d, "events"), "user_id", ["ts", "event_id"]).groupBy("user_id", "status").agg(F.count("*").alias("n"))


@query(f"""WITH {LIMITS} SELECT user_id, event_id, ts, value, status,
  round(CASE status WHEN 'above_limit' THEN (value - ucl) / (ucl - center) WHEN 'below_limit' THEN (lcl - value) / (center - lcl) END, 6) AS severity,
  CASE status WHEN 'baseline_review_required' THEN 0 ELSE 1 END AS tier, CASE status WHEN 'baseline_review_required' THEN 'BLOCKED_BASELINE' ELSE 'P1_LIMIT_SIGNAL' END AS priority,
  left(sha256(concat_ws(':', 'events', event_id::VARCHAR, user_id::VARCHAR)), 24) AS review_id FROM chart WHERE status <> 'within_limits'""")
def spc_review_queue(spark, d):
    chart = spc.individuals_chart(table(spark, d, "events"), "user_id", ["ts", "event_id"])
    return rounded(spc.review_queue(chart, "user_id", "event_id"))


@query("""SELECT event_id, event_type, value, CASE WHEN event_type NOT IN ('click', 'view') THEN 'waiting' WHEN value BETWEEN lo AND hi THEN 'within' ELSE 'outside' END AS state,
CASE WHEN event_type NOT IN ('click', 'view') THEN 0.0 ELSE round(greatest(lo - value, value - hi, 0), 2) END AS distance
FROM (SELECT *, CASE event_type WHEN 'click' THEN 20.0 ELSE 10.0 END AS lo, CASE event_type WHEN 'click' THEN 80.0 ELSE 60.0 END AS hi FROM events)""")
def spc_spec_range(spark, d):
    ranges = spark.createDataFrame([("click", 20.0, 80.0), ("view", 10.0, 60.0)], "event_type string, low double, high double")
    return spc.against_range(table(spark, d, "events"), ranges, "event_type", "value").select("event_id", "event_type", "value", "state", "distance")


# Ranking and evaluation


@query(f"""WITH {SCORES}, c AS (SELECT count_if(score >= 0.5 AND label = 1) AS tp, count_if(score >= 0.5 AND label = 0) AS fp, count_if(score < 0.5 AND label = 1) AS fn, count_if(score < 0.5 AND label = 0) AS tn FROM known)
SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round(tp / (tp + fn), 6) AS recall, round(tp / (tp + fp), 6) AS precision, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round(fp / (fp + tn), 6) AS false_alarm_rate, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM c""")
def eval_classification(spark, d):
    return rounded(evaluate.classification_metrics(known(spark, d)))


POINTS = """g AS (SELECT score, count(*) AS n, sum(label) AS pos FROM known GROUP BY 1),
p AS (SELECT *, sum(n) OVER (ORDER BY score DESC) AS seen, sum(pos) OVER (ORDER BY score DESC) AS captured, coalesce(sum(n - pos) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)"""


@query(f"WITH {SCORES}, {POINTS} SELECT round(sum(pos * captured / seen) / sum(pos), 6) AS average_precision FROM p")
def eval_average_precision(spark, d):
    return rounded(evaluate.average_precision(known(spark, d)))


@query(f"WITH {SCORES}, {POINTS} SELECT score, n, pos::BIGINT AS pos, seen::BIGINT AS seen, captured::BIGINT AS captured FROM p")
def eval_pr_points(spark, d):
    return evaluate.pr_points(known(spark, d))


@query(f"WITH {SCORES}, {POINTS} SELECT round(sum(pos * (below + (n - pos) / 2)) / (sum(pos) * sum(n - pos)), 6) AS roc_auc FROM p")
def eval_roc_auc(spark, d):
    return rounded(evaluate.roc_auc(known(spark, d)))


@query(f"""WITH {SCORES}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id::VARCHAR) AS rk FROM known), t AS (SELECT count(*) AS n, sum(label) AS total FROM known),
b AS (SELECT f::DOUBLE AS fraction, ceil((SELECT n FROM t) * f::DOUBLE)::BIGINT AS k FROM (VALUES (0.05), (0.1), (0.2)) v(f)),
h AS (SELECT fraction, k, coalesce(sum(label), 0) AS c FROM b JOIN r ON rk <= k GROUP BY ALL)
SELECT fraction, k AS inspected, c::BIGINT AS captured, round(c / total, 6) AS capture_rate, (k - c)::BIGINT AS false_inspections, round(c / k, 6) AS precision, round(k / n, 6) AS burden,
round((c / k) / (total / n), 6) AS lift, (k + (total - c) * 20)::DOUBLE AS cost, (total * 20)::DOUBLE AS cost_without FROM h, t""")
def eval_top_k(spark, d):
    return rounded(evaluate.top_k(known(spark, d), [0.05, 0.1, 0.2]))


@query(f"""WITH {SCORES}, b AS (SELECT least(floor(round(score * 10, 9)), 9) AS bin, count(*) AS n, avg(score) AS p, avg(label) AS y, sum((score - label) ** 2) AS sq FROM known GROUP BY 1)
SELECT round(sum(sq) / sum(n), 6) AS brier, round(sum(n * abs(p - y)) / sum(n), 6) AS ece, count(*) AS populated_bins FROM b""")
def eval_calibration(spark, d):
    return rounded(evaluate.calibration(known(spark, d)))


@query("""WITH r AS (SELECT event_type, value AS x FROM events WHERE event_id % 2 = 0), c AS (SELECT event_type, value AS x FROM events WHERE event_id % 2 = 1),
e AS (SELECT event_type, list_distinct(quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS edges FROM r GROUP BY 1),
i AS (SELECT event_type, list_sort(edges)[2:len(edges) - 1] AS inner_edges FROM e),
b AS (SELECT event_type, len(list_filter(inner_edges, lambda z: z <= x)) AS bin, w FROM (SELECT *, 0 AS w FROM r UNION ALL SELECT *, 1 FROM c) JOIN i USING (event_type)),
n AS (SELECT event_type, bin, count_if(w = 0) AS rn, count_if(w = 1) AS cn FROM b GROUP BY ALL),
s AS (SELECT event_type, greatest(rn / sum(rn) OVER (PARTITION BY event_type), 1e-6) AS rs, greatest(cn / sum(cn) OVER (PARTITION BY event_type), 1e-6) AS cs FROM n)
SELECT event_type, round(sum((cs - rs) * ln(cs / rs)), 6) AS psi FROM s GROUP BY 1""")
def eval_psi(spark, d):
    e = table(spark, d, "events")
    return rounded(evaluate.psi(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "value", "event_type"))


def _crc32(x: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    step = "list_reduce(list_prepend(xor(c, a::UBIGINT), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::UBIGINT) ELSE r >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({x}, ''), lambda y: ord(y)::UBIGINT)), lambda c, a: {step}), 4294967295::UBIGINT)"


@query(f"""WITH {SCORES}, m AS (SELECT {_crc32("id::VARCHAR")} % 16 AS g, round(avg(score - score2), 9) AS d FROM scores GROUP BY 1),
l AS (SELECT list(d ORDER BY g) AS ds FROM m), v AS (SELECT i, list_sum([CASE WHEN (i >> (j - 1)) & 1 = 1 THEN ds[j] ELSE -ds[j] END FOR j IN range(1, len(ds) + 1)]) AS t, list_sum(ds) AS o, len(ds) AS n FROM l, range(65536) r(i))
SELECT round(avg(CASE WHEN abs(t) >= abs(o) - 1e-12 THEN 1.0 ELSE 0.0 END), 4) AS p_value, round(min(o / n), 6) AS mean_difference FROM v""")
def eval_sign_flip(spark, d):
    """Paired over 16 hashed repeats that cover all rows."""
    both = scores(spark, d).join(scores(spark, d, 104729).select("id", F.col("score").alias("score2")), "id")
    means = both.groupBy((F.crc32(F.col("id").cast("string").cast("binary")) % 16).alias("repeat")).agg(F.round(F.avg(F.col("score") - F.col("score2")), 9).alias("d"))
    return evaluate.sign_flip(means).select(F.round("p_value", 4).alias("p_value"), F.round("mean_difference", 6).alias("mean_difference"))


@query(f"""WITH {SCORES} SELECT d.lang AS protocol, d.source AS domain, count(*) AS n, sum(k.label)::BIGINT AS positives, round(avg(k.score), 6) AS mean_score
FROM known k JOIN documents d ON d.doc_id = k.id GROUP BY GROUPING SETS ((d.lang, d.source), (d.lang))""")
def eval_by_domain(spark, d):
    df = known(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("protocol"), F.col("source").alias("domain")), "id")
    return rounded(evaluate.grouped_counts(df, "protocol", "domain"))


# Splits


@query("""WITH o AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS p FROM events), b AS (SELECT ts AS t FROM o WHERE p = 6000)
SELECT CASE WHEN ts < (SELECT t FROM b) THEN 'train' ELSE 'test' END AS split, count(*) AS n FROM events GROUP BY 1""")
def split_time_holdout(spark, d):
    return splits.time_holdout(table(spark, d, "events"), "ts", 6000).groupBy("split").agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS p, count(*) OVER () AS n FROM events),
c AS (SELECT i + 1 AS fold, (SELECT min(ts) FROM o WHERE p = floor(floor(n * 0.55) + (n - floor(n * 0.55)) * i / 4)::BIGINT) AS t FROM range(4) r(i), (SELECT max(n) AS n FROM o)),
f AS (SELECT fold, t, lead(t) OVER (ORDER BY fold) AS u FROM c)
SELECT fold::INT AS fold, CASE WHEN ts < t THEN 'train' ELSE 'test' END AS role, count(*) AS n FROM f JOIN events ON u IS NULL OR ts < u GROUP BY ALL""")
def split_walk_forward(spark, d):
    return splits.walk_forward(table(spark, d, "events").select("ts"), "ts").groupBy("fold", "role").agg(F.count("*").alias("n"))


@query(f"""WITH {SCORES}, f AS (SELECT id, label, r.i::INT AS repeat, (row_number() OVER (PARTITION BY r.i, label ORDER BY md5('20260822:' || r.i || ':' || id), id) - 1) % 5 AS fold FROM known, range(1, 6) r(i))
SELECT repeat, fold::INT AS fold, label, count(*) AS n, sum(id)::BIGINT AS id_sum FROM f GROUP BY ALL""")
def split_stratified_folds(spark, d):
    return splits.stratified_folds(known(spark, d), "id", "label").groupBy("repeat", "fold", "label").agg(F.count("*").alias("n"), F.sum("id").alias("id_sum"))


@query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01') GROUP BY 1")
def split_group_disjoint(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_shipdate")
    train, test = li.where("l_shipdate < timestamp_ntz'1998-01-01'"), li.where("l_shipdate >= timestamp_ntz'1998-01-01'")
    return splits.group_disjoint(train, test, "l_orderkey").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01') GROUP BY 1")
def split_overlap(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_shipdate")
    return splits.overlap(li.where("l_shipdate < timestamp_ntz'1998-01-01'"), li.where("l_shipdate >= timestamp_ntz'1998-01-01'"), "l_orderkey", "l_returnflag")


@query("""WITH n AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) - 1 AS p, count(*) OVER () AS c FROM (SELECT DISTINCT doc_id FROM labels)), m AS (SELECT max(c) AS c FROM n),
dr AS (SELECT r.i // c AS rep, r.i % c AS i, c FROM m, range(20 * c) r(i))
SELECT rep, count(DISTINCT id) AS different, sum(id)::BIGINT AS id_sum FROM dr JOIN n ON ('0x' || substr(md5('1:' || rep || ':' || i), 1, 15))::BIGINT % dr.c = p GROUP BY 1""")
def split_bootstrap(spark, d):
    draws = splits.bootstrap_draws(table(spark, d, "labels").select("doc_id").distinct(), "doc_id", 20)
    return draws.groupBy("rep").agg(F.count_distinct("doc_id").alias("different"), F.sum("doc_id").alias("id_sum"))


WALK = """o AS (SELECT ts, event_type = 'error' AND event_id % 7 = 0 AS y, row_number() OVER (ORDER BY ts) - 1 AS p, count(*) OVER () AS n FROM events),
c AS (SELECT i + 1 AS fold, (SELECT min(ts) FROM o WHERE p = floor(floor(n * 0.55) + (n - floor(n * 0.55)) * i / 4)::BIGINT) AS t FROM range(4) r(i), (SELECT max(n) AS n FROM o)),
f AS (SELECT fold, t, lead(t) OVER (ORDER BY fold) AS u FROM c)"""


@query(f"""WITH {WALK}, k AS (SELECT fold, count_if(ts < t AND NOT y) AS n0, count_if(ts < t AND y) AS n1, count_if(ts >= t AND y) AS t1 FROM f JOIN o ON u IS NULL OR ts < u GROUP BY 1)
SELECT fold::INT AS fold, CASE WHEN least(n0, n1) = 0 THEN 'TRAIN_SINGLE_CLASS' WHEN least(n0, n1) < 100 THEN 'TRAIN_CLASS_SUPPORT_BELOW_CV_SPLITS' WHEN t1 = 0 THEN 'VALIDATION_NO_FAIL' END AS skip_reason FROM k""")
def split_skip_reasons(spark, d):
    e = table(spark, d, "events").select("ts", ((F.col("event_type") == "error") & (F.col("event_id") % 7 == 0)).cast("int").alias("label"))
    return splits.skip_reasons(splits.walk_forward(e, "ts"), least=100)


@query("""WITH o AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS p, count(*) OVER () AS n FROM events), b AS (SELECT min(ts) AS t FROM o WHERE p = floor(n * 0.8)::BIGINT)
SELECT CASE WHEN ts < t THEN 'fit' ELSE 'calibrate' END AS part, count(*) AS n FROM events, b GROUP BY 1""")
def split_inner(spark, d):
    return splits.inner_split(table(spark, d, "events"), "ts").groupBy("part").agg(F.count("*").alias("n"))


# Comparison of score tables


@query(f"""WITH {SCORES}, a AS (SELECT id FROM scores ORDER BY score DESC, id::VARCHAR LIMIT 50), b AS (SELECT id FROM scores ORDER BY score2 DESC, id::VARCHAR LIMIT 50),
m AS (SELECT CASE label WHEN 1 THEN 'fail' WHEN 0 THEN 'normal' ELSE 'unknown' END AS label_class, CASE WHEN a.id IS NULL AND b.id IS NOT NULL THEN 'newly_selected' WHEN a.id IS NOT NULL AND b.id IS NULL THEN 'newly_removed'
  WHEN a.id IS NOT NULL THEN 'jointly_selected' ELSE 'jointly_unselected' END AS move FROM scores s LEFT JOIN a ON a.id = s.id LEFT JOIN b ON b.id = s.id)
SELECT c AS label_class, v AS move, (SELECT count(*) FROM m WHERE label_class = c AND move = v) AS n FROM (VALUES ('fail'), ('normal'), ('unknown')) x(c), (VALUES ('newly_selected'), ('newly_removed'), ('jointly_selected'), ('jointly_unselected')) y(v)""")
def cmp_transitions(spark, d):
    return compare.transitions(scores(spark, d), scores(spark, d, 104729), 50)


@query(f"""WITH {SCORES}, e AS (SELECT min(score) AS edge FROM (SELECT score FROM scores ORDER BY score DESC LIMIT 50)),
c AS (SELECT count_if(score > edge) AS above, count_if(score = edge) AS tied, count_if(score > edge AND label = 1) AS fixed, count_if(score = edge AND label = 1) AS tf, count(DISTINCT score) AS ds, count_if(label IS NULL) AS unknown FROM scores, e)
SELECT ds AS distinct_scores, tied::BIGINT AS tied, (50 - above)::BIGINT AS taken, (fixed + greatest(0, 50 - above - (tied - tf)))::BIGINT AS min_captured, (fixed + least(50 - above, tf))::BIGINT AS max_captured, ds = 1 AS constant_scores, 50 - above < tied AS order_matters, unknown > 0 AS labels_incomplete FROM c""")
def cmp_tie_diagnostics(spark, d):
    return compare.tie_diagnostics(scores(spark, d), 50)


@query(f"WITH {SCORES} SELECT count_if(id % 11 = 0)::BIGINT AS removed, 0::BIGINT AS added, count_if(id % 11 <> 0 AND abs(score - score2) > 1e-9)::BIGINT AS moved, round(max(CASE WHEN id % 11 <> 0 THEN abs(score - score2) END), 6) AS largest_move FROM scores")
def cmp_table_diff(spark, d):
    return rounded(compare.table_diff(scores(spark, d), scores(spark, d, 104729).where("id % 11 <> 0")))


@query("SELECT count_if(o_orderkey % 6 = 0)::BIGINT AS in_both, count_if(o_orderkey % 2 <> 0 AND o_orderkey % 3 <> 0)::BIGINT AS in_neither, 0::BIGINT AS foreign FROM orders")
def cmp_cohort_gate(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return compare.cohort_gate(o, o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 = 0"), "o_orderkey")


# Profiles

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("""WITH t AS (SELECT CASE WHEN l_quantity > 40 THEN NULL ELSE l_quantity END AS q, l_extendedprice AS p, l_discount AS c, l_tax AS x, (l_returnflag = 'R')::INT AS label, l_shipdate FROM lineitem)
SELECT count(*) AS n_rows, sum(label)::BIGINT AS fails, count(DISTINCT l_shipdate) AS unique_times, count(*) - (SELECT count(*) FROM (SELECT DISTINCT q, p, c, x FROM t)) AS duplicate_rows, count(*) * 4 AS cells,
count_if(q IS NULL)::BIGINT AS missing_cells, 1::BIGINT AS features_with_missing, 0::BIGINT AS features_mostly_missing, 0::BIGINT AS uninformative FROM t""")
def prf_audit(spark, d):
    li = table(spark, d, "lineitem").withColumn("l_quantity", F.when(F.col("l_quantity") <= 40, F.col("l_quantity"))).withColumn("label", (F.col("l_returnflag") == "R").cast("int"))
    return profile.audit(li, FEATURES, "label", "l_shipdate")


SUMMARY = """s AS (SELECT event_type, (user_id % 5 = 0)::INT AS label, count(*) AS n, count(value) AS observed, avg(value) AS mean, stddev_samp(value) AS std, quantile_cont(value, [0.05, 0.25, 0.5, 0.75, 0.95]) AS q FROM events GROUP BY ALL)"""


def labelled_events(spark, d):
    return table(spark, d, "events").withColumn("label", (F.col("user_id") % 5 == 0).cast("int"))


@query(f"WITH {SUMMARY} SELECT event_type, label, n, observed, round(1 - observed / n, 6) AS missing_rate, round(mean, 6) AS mean, round(std, 6) AS std, round(q[1], 6) AS q5, round(q[2], 6) AS q25, round(q[3], 6) AS q50, round(q[4], 6) AS q75, round(q[5], 6) AS q95 FROM s")
def prf_group_summary(spark, d):
    return rounded(profile.group_summary(labelled_events(spark, d), "event_type", "label", "value"))


@query(f"""WITH {SUMMARY}, p AS (SELECT a.event_type, a.mean - b.mean AS difference, sqrt(((a.observed - 1) * a.std ** 2 + (b.observed - 1) * b.std ** 2) / (a.observed + b.observed - 2)) AS pooled FROM s a JOIN s b ON a.event_type = b.event_type AND a.label = 1 AND b.label = 0)
SELECT event_type, round(difference, 6) AS difference, round(difference / pooled, 6) AS standardised, NULL::VARCHAR AS reason FROM p""")
def prf_standardised_difference(spark, d):
    return rounded(profile.standardised_difference(profile.group_summary(labelled_events(spark, d), "event_type", "label", "value"), "event_type", "label"))


@query("SELECT event_type, (user_id % 5 = 0)::INT AS label, round(avg(value), 6) AS mean, round((sum(value) - max(value)) / (count(value) - 1), 6) AS mean_without_max FROM events GROUP BY ALL")
def prf_without_maximum(spark, d):
    return rounded(profile.without_maximum(labelled_events(spark, d), "event_type", "label", "value", "event_id").select("event_type", "label", "mean", "mean_without_max"))


@query("SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n, sum((l_returnflag = 'R')::INT)::BIGINT AS fails FROM lineitem GROUP BY 1")
def prf_monthly(spark, d):
    return profile.monthly(table(spark, d, "lineitem").withColumn("fail", (F.col("l_returnflag") == "R").cast("int")), "l_shipdate", "fail")


@query("""SELECT user_id, event_id, min(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_match FROM events""")
def prf_next_record(spark, d):
    return profile.next_record(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", "event_id").select("user_id", "event_id", "next_match")


@query("""SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS trail_mean,
coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 43200000000, false) AS break_before FROM events""")
def prf_trailing(spark, d):
    return rounded(profile.trailing(table(spark, d, "events"), "user_id", ["ts", "event_id"], "ts", "value", 20, 43_200).select("user_id", "event_id", "trail_mean", "break_before"))


@query("""WITH c AS (SELECT DISTINCT c_custkey AS k FROM customer), o AS (SELECT DISTINCT o_custkey AS k FROM orders)
SELECT count_if(c.k IS NOT NULL AND o.k IS NOT NULL)::BIGINT AS matched, count_if(o.k IS NULL)::BIGINT AS left_only, count_if(c.k IS NULL)::BIGINT AS right_only FROM c FULL JOIN o ON c.k = o.k""")
def prf_key_match(spark, d):
    return profile.both_ways(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k")), ["k"])


# Contracts


@query("""WITH r AS (SELECT event_id, user_id, ts, value FROM events UNION ALL SELECT event_id, user_id, ts, value FROM events WHERE event_id % 97 = 0),
c AS (SELECT *, count(*) OVER (PARTITION BY user_id, ts) > 1 AS twice FROM r) SELECT CASE WHEN twice THEN 'duplicate' ELSE '' END AS reasons, count(*) AS n, round(sum(value), 2) AS total FROM c GROUP BY 1""")
def con_readings(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    checked = contracts.with_reasons(e.union(e.where("event_id % 97 = 0")), contracts.reading_rules("user_id", "ts", "value"))
    return checked.groupBy(F.array_join("reasons", ",").alias("reasons")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, date_trunc('month', o_orderdate) ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, o_orderdate, o_orderkey, o_totalprice FROM r WHERE rn = 1""")
def con_latest_revision(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderdate", "o_orderkey", "o_totalprice")
    return contracts.latest(o, ["o_custkey", "month"], "o_orderdate", "o_orderkey")


@query("""WITH e AS (SELECT event_type, epoch_us(ts) AS us, value FROM events), s AS (SELECT *, round_even(us / 300000000.0, 0)::BIGINT * 300 AS slot FROM e),
k AS (SELECT *, abs(us - slot * 1000000) AS away FROM s WHERE abs(us - slot * 1000000) <= 60000000),
g AS (SELECT event_type, slot, arg_min(value, (value IS NULL, away > 0, us)) AS value, count(*) AS readings, max(value) - min(value) AS spread FROM k GROUP BY ALL)
SELECT event_type, slot, value, readings, greatest(value, 0) AS clipped FROM g WHERE spread IS NULL OR spread <= 1e-9""")
def con_regularise(spark, d):
    return contracts.regularise(table(spark, d, "events"), "event_type", "ts", "value", 300, 60)[0].select("event_type", "slot", "value", "readings", "clipped")


SLOTS = """s0 AS (SELECT event_type, epoch_us(ts) AS us, CASE WHEN event_id % 9 <> 0 THEN round(value - 50, 6) END AS value FROM events),
s1 AS (SELECT *, round_even(us / 21600000000.0, 0)::BIGINT * 21600 AS slot FROM s0), s2 AS (SELECT *, abs(us - slot * 1000000) AS away FROM s1), near AS (SELECT * FROM s2 WHERE away <= 600000000),
g0 AS (SELECT event_type, slot, arg_min(coalesce(value, 'NaN'::DOUBLE), (value IS NULL, away > 0, us)) AS v, min(away > 0) AS x, count(*) AS readings, count_if(value IS NULL) AS nulls, coalesce(max(value) - min(value), 0) <= 1e-9 AS agrees, arg_min(away > 0, (value IS NULL, away > 0, us)) AS adjusted FROM near GROUP BY ALL)"""


def slots(spark, d):
    e = table(spark, d, "events").withColumn("value", F.when(F.col("event_id") % 9 != 0, F.round(F.col("value") - 50, 6)))
    return contracts.regularise(e, "event_type", "ts", "value", 21_600, 600)


@query(f"""WITH {SLOTS}, r AS (SELECT event_type, 'clock_skew' AS reason FROM s2 WHERE away > 600000000 UNION ALL SELECT n.event_type, 'slot_conflict' FROM near n JOIN g0 USING (event_type, slot) WHERE NOT agrees)
SELECT event_type, reason, count(*) AS n FROM r GROUP BY ALL""")
def con_regularise_rejected(spark, d):
    return slots(spark, d)[1].groupBy("event_type", "reason").agg(F.count("*").alias("n"))


@query(f"""WITH {SLOTS}, good AS (SELECT * FROM g0 WHERE agrees), lim AS (SELECT min(slot) AS a, max(slot) AS b FROM good), grid AS (SELECT event_type, unnest(range(a, b + 1, 21600)) AS slot FROM (SELECT DISTINCT event_type FROM good), lim),
f AS (SELECT g.event_type, readings, nulls, adjusted, CASE WHEN isnan(v) THEN NULL ELSE v END AS value FROM grid g LEFT JOIN good o ON o.event_type = g.event_type AND o.slot = g.slot)
SELECT event_type, count(*) AS normalized_rows, count_if(readings IS NULL) AS missing_slots, count_if(coalesce(adjusted, false)) AS rounded, count_if(coalesce(readings > 1, false)) AS collisions, count_if(coalesce(readings - nulls = 1 AND nulls > 0, false)) AS value_over_null,
  count_if(value IS NULL) AS missing_values, count_if(coalesce(value < 0, false)) AS clipped_negatives FROM f GROUP BY 1""")
def con_grid_audit(spark, d):
    good = slots(spark, d)[0]
    low, high = good.agg(F.min("slot"), F.max("slot")).first()
    return contracts.grid_audit(contracts.on_grid(good, "event_type", low or 0, (high or 0) + 1, 21_600), "event_type")


@query("""WITH h AS (SELECT event_type, epoch_us(ts) // 3600000000 AS h, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT DISTINCT event_type FROM h),
r AS (SELECT unnest(range((SELECT min(h) FROM h), (SELECT max(h) FROM h) + 1)) AS h), g AS (SELECT event_type, h FROM t, r)
SELECT count_if(h.n IS NULL)::BIGINT AS missing, 0::BIGINT AS unexpected, count_if(h.n > 1)::BIGINT AS repeated FROM g LEFT JOIN h ON g.event_type = h.event_type AND g.h = h.h""")
def con_coverage(spark, d):
    e = table(spark, d, "events").select("event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3_600_000_000)).alias("h"))
    low, high = e.agg(F.min("h"), F.max("h")).first()
    hours = spark.range(low or 0, (high if high is not None else -1) + 1).withColumnRenamed("id", "h")
    grid = e.select("event_type").distinct().withColumn("h", F.explode(F.sequence(F.lit(low), F.lit(high)))) if low is not None else hours.withColumn("event_type", F.lit(""))
    return contracts.coverage(e, grid, ["event_type", "h"])


@query("""WITH s AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events)
SELECT user_id, count(*) AS n_rows, count_if(step <= 0)::BIGINT AS not_increasing, quantile_cont(step::DOUBLE, 0.5) AS median_step, min(step) AS min_step, max(step) AS max_step FROM s GROUP BY 1""")
def con_cadence(spark, d):
    return contracts.cadence(table(spark, d, "events"), "user_id", "ts", "event_id")


@query("""SELECT count(*) AS n_rows, count(*) - count(DISTINCT l_orderkey * 10 + l_linenumber) AS repeated_ids, 0::BIGINT AS missing_times, count_if(l_returnflag = 'R')::BIGINT AS positives, 0::BIGINT AS other_labels, 0::BIGINT AS bad_cells, 0::BIGINT AS missing_cells,
CASE WHEN count(*) = count(DISTINCT l_orderkey * 10 + l_linenumber) THEN 'locked_model_candidate' ELSE 'schema_only' END AS eligibility FROM lineitem""")
def con_dataset(spark, d):
    li = table(spark, d, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber")).withColumn("label", (F.col("l_returnflag") == "R").cast("int"))
    return contracts.inspect_dataset(li, "id", "l_shipdate", "label", FEATURES)


@query("""SELECT CASE WHEN l_quantity > 45 AND l_discount > 0.08 THEN 'quantity_too_large,discount_too_large' WHEN l_quantity > 45 THEN 'quantity_too_large' WHEN l_discount > 0.08 THEN 'discount_too_large' ELSE '' END AS reasons, count(*) AS n FROM lineitem GROUP BY 1""")
def con_quarantine(spark, d):
    rules = [Rule("quantity_too_large", F.col("l_quantity") > 45), Rule("discount_too_large", F.col("l_discount") > 0.08)]
    return contracts.with_reasons(table(spark, d, "lineitem"), rules).groupBy(F.array_join("reasons", ",").alias("reasons")).agg(F.count("*").alias("n"))


# Features


@query("""SELECT user_id, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(sqrt(avg(value * value)), 6) AS rms, round(quantile_cont(abs(value), 0.95), 6) AS abs_p95, round(sqrt(avg(step * step)), 6) AS diff_rms, round(count(value) / count(*), 6) AS valid_fraction
FROM (SELECT user_id, value, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events) GROUP BY 1""")
def fea_channel(spark, d):
    return rounded(features.channel_features(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value"))


@query("""WITH t AS (SELECT *, CASE WHEN l_quantity > 40 THEN NULL ELSE l_quantity END AS q FROM lineitem), tr AS (SELECT * FROM t WHERE l_shipdate < TIMESTAMP '1998-01-01'), m AS (SELECT quantile_cont(q, 0.5) AS mq FROM tr),
s AS (SELECT avg(coalesce(q, mq)) AS aq, stddev_pop(coalesce(q, mq)) AS sq, avg(l_tax) AS ax, stddev_pop(l_tax) AS sx FROM tr, m)
SELECT l_returnflag, count(*) AS n, sum((q IS NULL)::INT)::BIGINT AS missing, round(avg((coalesce(q, mq) - aq) / sq), 6) AS mean_q, round(avg((l_tax - ax) / sx), 6) AS mean_tax FROM t, m, s GROUP BY 1""")
def fea_impute_scale(spark, d):
    li = table(spark, d, "lineitem").withColumn("l_quantity", F.when(F.col("l_quantity") <= 40, F.col("l_quantity")))
    out = features.impute_and_scale(li.where("l_shipdate < timestamp_ntz'1998-01-01'"), li, ["l_quantity", "l_tax"])
    return rounded(out.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity_missing").alias("missing"), F.avg("l_quantity").alias("mean_q"), F.avg("l_tax").alias("mean_tax")))


# Review and lineage


@query("""WITH ch AS (SELECT user_id, ts FROM events WHERE event_type = 'error' AND event_id % 5 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type <> 'error'),
b AS (SELECT user_id, min(ts) AS s, max(ts) AS e FROM r WHERE rn <= 10 GROUP BY 1)
SELECT r.event_id, (SELECT count(*) FROM ch WHERE ch.user_id = r.user_id AND ch.ts BETWEEN b.s AND b.e) AS changes_inside, (SELECT count(*) FROM ch WHERE ch.user_id = r.user_id AND ch.ts > b.e AND ch.ts <= r.ts) AS changes_after FROM r JOIN b USING (user_id)""")
def rev_context_holds(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    rows = e.where("event_type <> 'error'")
    changes = e.where("event_type = 'error' and event_id % 5 = 0").select("user_id", F.col("ts").alias("effective_at"))
    from pyspark.sql import Window

    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("rn <= 10")
    baseline = first.groupBy("user_id").agg(F.min("ts").alias("baseline_start"), F.max("ts").alias("baseline_end"))
    return review.context_holds(rows, changes, baseline, "user_id").select("event_id", "changes_inside", "changes_after")


@query("""WITH a AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
SELECT count_if(o.o_orderkey IS NULL)::BIGINT AS "unexpected", count_if(a.k IS NULL)::BIGINT AS "missing", count_if(a.n > 1)::BIGINT AS "duplicate", 0::BIGINT AS time_changed, 0::BIGINT AS digest_changed FROM (SELECT * FROM orders WHERE o_orderkey % 7 <> 0) o FULL JOIN a ON a.k = o.o_orderkey""")
def rev_reconcile(spark, d):
    o = table(spark, d, "orders").where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("k"), F.lit(1).alias("t"), F.lit("x").alias("h"))
    a = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.lit(1).alias("t"), F.lit("x").alias("h"))
    return review.reconcile(o, a, "k", "t", "h")


@query("""WITH r AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1)
SELECT CASE WHEN o.o_orderkey IS NULL OR r.n > 1 THEN 'SUBSTITUTED' WHEN r.n IS NULL THEN 'MISSING' ELSE 'MATCH' END AS state, count(*) AS n FROM orders o FULL JOIN r ON r.k = o.o_orderkey GROUP BY 1""")
def rev_roster(spark, d):
    return review.roster_state(table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), table(spark, d, "lineitem").where("l_linenumber <= 2").select(F.col("l_orderkey").alias("k")), "k")


@query("""WITH r AS (SELECT l_orderkey, count_if(l_shipdate <= TIMESTAMP '1998-01-01') AS i, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_custkey, count(*) AS listed, count_if(i > 0)::BIGINT AS admitted, count_if(i = 0)::BIGINT AS late_only, count_if(n IS NULL)::BIGINT AS lost, count_if(i > 0 AND o_orderkey % 11 <> 0)::BIGINT AS scored,
  CASE WHEN count_if(i > 0) < count(*) THEN 'BLOCKED' WHEN count_if(i > 0 AND o_orderkey % 11 = 0) > 0 THEN 'MISSING' ELSE 'MATCH' END AS verdict FROM orders LEFT JOIN r ON l_orderkey = o_orderkey GROUP BY 1""")
def rev_receipts(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_shipdate").alias("received_at"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey")
    return review.receipt_audit(o, li, F.lit("1998-01-01").cast("timestamp_ntz"), "k", "o_custkey", scored=o.where("k % 11 <> 0"))


# Readings


@query("""WITH r AS (SELECT event_id AS seq, user_id, ts, value, 0 AS again FROM events UNION ALL SELECT event_id + 1000000000, user_id, ts, value, 1 FROM events WHERE event_id % 50 = 0),
c AS (SELECT *, epoch_us(ts) + CASE WHEN seq % 31 = 0 THEN 900000000 WHEN seq % 37 = 0 THEN -60000000 ELSE 1000000 END AS o FROM r),
d AS (SELECT *, coalesce(bool_or(o - epoch_us(ts) BETWEEN -5000000 AND 300000000) OVER (PARTITION BY user_id, ts ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS known FROM c)
SELECT coalesce(CASE WHEN known THEN 'duplicate' WHEN o - epoch_us(ts) < -5000000 THEN 'future' WHEN o - epoch_us(ts) > 300000000 THEN 'late' END, 'accepted') AS reason, count(*) AS n FROM d GROUP BY 1""")
def str_readings(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("asset"), F.col("ts").cast("timestamp").alias("ts"), "value")
    e = e.union(e.where("seq % 50 = 0").withColumn("seq", F.col("seq") + 1_000_000_000))
    shift = F.when(F.col("seq") % 31 == 0, 900).when(F.col("seq") % 37 == 0, -60).otherwise(1)
    e = e.withColumn("observed_at", F.timestamp_micros(F.unix_micros("ts") + shift * 1_000_000))
    return readings.batch(e).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT event_type, value AS x FROM events WHERE event_id % 2 = 0), c AS (SELECT event_type, value + 20 AS x FROM events WHERE event_id % 2 = 1 AND event_type <> 'view'),
e AS (SELECT event_type, list_distinct(quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS edges FROM r GROUP BY 1),
i AS (SELECT event_type, list_sort(edges)[2:len(edges) - 1] AS inner_edges FROM e),
b AS (SELECT event_type, len(list_filter(inner_edges, lambda z: z <= x)) AS bin, w FROM (SELECT *, 0 AS w FROM r UNION ALL SELECT *, 1 FROM c) JOIN i USING (event_type)),
n AS (SELECT event_type, bin, count_if(w = 0) AS rn, count_if(w = 1) AS cn FROM b GROUP BY ALL),
s AS (SELECT event_type, cn, greatest(rn / sum(rn) OVER (PARTITION BY event_type), 1e-6) AS rs, greatest(cn / sum(cn) OVER (PARTITION BY event_type), 1e-6) AS cs FROM n),
p AS (SELECT event_type, sum(cn)::BIGINT AS k, sum((cs - rs) * ln(cs / rs)) AS v FROM s GROUP BY 1)
SELECT event_type, k AS current_samples, CASE WHEN k >= 5 THEN round(v, 6) END AS psi, CASE WHEN k < 5 THEN 'drift_evidence_insufficient' WHEN v >= 0.2 THEN 'distribution_drift' END AS alert FROM p""")
def str_drift(spark, d):
    e = table(spark, d, "events")
    current = e.where("event_id % 2 = 1 and event_type <> 'view'").withColumn("value", F.col("value") + 20)
    return rounded(readings.drift_alerts(e.where("event_id % 2 = 0"), current, "event_type", "value"))


@query("SELECT event_type, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS k_sum, count(*) AS n FROM events GROUP BY 1")
def src_json_props(spark, d):
    e = table(spark, d, "events").select("event_type", F.from_json("props", "k bigint")["k"].alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("k_sum"), F.count("*").alias("n"))


@query("WITH l AS (SELECT avg(quality) AS p FROM labels) SELECT d.lang, count(*) AS n, round(min(p), 6) AS score FROM documents d, l GROUP BY 1")
def mod_prior(spark, d):
    p = table(spark, d, "labels").agg(F.avg("quality")).first()[0]
    return rounded(table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")).withColumn("score", F.lit(p)))


@query()
def mod_logistic_scores(spark, d):
    """L1 logistic regression of embeddings' class 3, C chosen by cross-validation in the rows that aren't held out; every row is scored."""
    from gaugeworks.operators import models

    e, names = components(table(spark, d, "embeddings").withColumnRenamed("vec_id", "id"), "embedding")
    place = F.crc32(F.col("id").cast("string").cast("binary"))
    e = e.select("id", (F.col("label") == 3).cast("int").alias("label"), (place % 5 == 0).alias("held_out"), *names)
    train = e.where(~F.col("held_out")).withColumn("fold", (place / 5).cast("long") % 3)
    _, model = models.select(train, names, ["l1_C0.01", "l1_C0.1", "l1_C1"])
    return models.score(model, e, keep=["held_out"])
