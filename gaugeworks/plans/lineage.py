"""Registered queries of the evidence checks, over orders and their lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugeworks.operators import lineage
from gaugeworks.plans.registry import query, rounded, table

def key():
    return F.col("o_orderkey")


def none():
    return F.array().cast("array<string>")


def every(n: int, remainder: int = 0):
    return key() % n == remainder


def day(text: str):
    return F.lit(text).cast("timestamp_ntz")


def shifted(column, days: int):
    return column + F.make_dt_interval(days=F.lit(days))


def reasons_of(df):
    return df.groupBy(F.array_join("reasons", ",").alias("reasons")).agg(F.count("*").alias("n"))


def bases(spark, d):
    o = table(spark, d, "orders").withColumn("review_id", key())
    reason = F.element_at(F.array(*[F.lit(x) for x in ("context_changed", "measurement_missing", "other", "operator_observation")]), (F.floor(key() / 3) % 4 + 1).cast("int"))
    observations = o.select("review_id", F.col("o_orderstatus").alias("digest"), F.array("o_orderpriority").alias("related"), F.when(F.col("o_orderstatus") == "F", F.array(F.lit("measurement_missing"))).otherwise(none()).alias("reasons"))
    basis = o.where(every(3) & ~every(30)).select(
        "review_id", reason.alias("reason_code"), F.lit("observed").alias("evidence_status"), F.when(every(7), shifted(F.col("o_orderdate"), -2)).otherwise(F.col("o_orderdate")).alias("captured_at"),
        F.when(every(11), "X").otherwise(F.col("o_orderstatus")).alias("digest"), F.when(every(13), F.array(F.lit("zz"))).when(every(2), F.array("o_orderpriority")).otherwise(none()).alias("refs"),
    )
    decisions = o.where(every(3)).select("review_id", shifted(F.col("o_orderdate"), 1).alias("decided_at"))
    return observations, lineage.decision_basis(decisions, basis, observations, shifted(F.col("decided_at"), -2))


BASES = """b AS (SELECT o_orderkey AS k, o_orderstatus AS s, concat_ws(',', CASE WHEN k % 30 = 0 THEN 'basis_missing' END, CASE WHEN k % 30 <> 0 AND k % 11 = 0 THEN 'observation_differs' END,
  CASE WHEN k % 30 <> 0 AND k % 7 = 0 THEN 'captured_out_of_time' END, CASE WHEN k % 30 <> 0 AND k % 13 = 0 THEN 'refs_not_related' END) AS reasons FROM orders WHERE o_orderkey % 3 = 0)"""


@query(f"WITH {BASES} SELECT reasons, count(*) AS n FROM b GROUP BY 1")
def rev_decision_basis(spark, d):
    return reasons_of(bases(spark, d)[1])


@query(f"""WITH {BASES}, g AS (SELECT *, k // 3 % 4 AS r FROM b WHERE reasons = ''), t AS (SELECT count(*) AS n, count_if(r = 2) AS other, count_if((r = 0 AND k % 2 <> 0) OR (r = 1 AND s <> 'F')) AS review,
  count_if((r = 0 AND k % 2 = 0) OR (r = 1 AND s = 'F')) AS fine, count_if(r > 1) AS open FROM g)
SELECT (SELECT count(*) FROM orders) AS observations, n AS decided, other::BIGINT AS other_reasons, review::BIGINT AS needs_human_review, fine::BIGINT AS no_structural_warning, open::BIGINT AS not_assessed,
  (SELECT count(*) FROM orders) - n AS pending, round(n / (SELECT count(*) FROM orders), 6) AS coverage, round(other / n, 6) AS other_share FROM t""")
def rev_basis_quality(spark, d):
    observations, found = bases(spark, d)
    return rounded(lineage.basis_quality(observations, lineage.basis_diagnostics(found.where(F.size("reasons") == 0))))


@query("""SELECT concat_ws(',', CASE WHEN o_orderkey % 17 = 0 THEN 'contract:left:bytes_mismatch' END, CASE WHEN o_orderkey % 10 = 0 THEN 'right:time_outside_contract' END, CASE WHEN o_orderkey % 5 = o_orderkey % 7 THEN 'sources:not_distinct' END,
  CASE WHEN o_orderkey % 9 = 0 THEN 'unit:mismatch' END) AS reasons, count(*) AS n FROM orders GROUP BY 1""")
def rev_mapping(spark, d):
    o = table(spark, d, "orders").withColumn("mapping_id", key()).withColumn("at", F.col("o_orderdate"))
    span = [shifted(F.col("at"), -1).alias("valid_from"), day("2030-01-01").alias("valid_until")]
    side = lambda n, unit, known: o.select("mapping_id", F.concat(F.lit("s"), key() % n).alias("source_id"), unit.alias("unit"), F.md5(F.col("mapping_id").cast("string")).alias("digest"), F.col("at").alias("observed_at"), known.alias("available_at"), *span)
    left = side(5, F.col("o_orderpriority"), shifted(F.col("at"), 1))
    right = side(7, F.when(every(9), "other").otherwise(F.col("o_orderpriority")), F.when(every(10), shifted(F.col("at"), -1)).otherwise(shifted(F.col("at"), 1)))
    own = F.md5(key().cast("string"))
    contracts = o.select("mapping_id", F.when(every(17), "x").otherwise(own).alias("left_digest"), own.alias("right_digest"), F.col("at").alias("declared_at"), *span)
    return reasons_of(lineage.mapping_diagnostics(left, right, contracts, ["unit"], day("2025-01-01")))


@query("SELECT count(DISTINCT o_custkey) AS declared, count(DISTINCT CASE WHEN o_orderkey % 50 = 0 THEN o_custkey END) AS differing, false AS open FROM orders")
def rev_binding_gate(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "name")
    count = lambda df: df.groupBy("name").agg(F.count("*").alias("value"))
    return lineage.binding_gate(count(o), count(o.where(~every(50))))


@query("""WITH r AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY 1)
SELECT CASE WHEN k IS NULL THEN 'MISSING' WHEN k % 5 = 0 THEN 'STALE_SOURCE' WHEN k % 3 = 0 THEN 'NOT_RUN' WHEN k % 3 = 1 THEN 'STATIC_EVIDENCE_LINKED' WHEN k % 4 = 0 THEN 'EXECUTION_SUCCESS_DECLARED' ELSE 'EXECUTION_FAILURE_DECLARED' END AS status, count(*) AS n
FROM customer LEFT JOIN r ON o_custkey = c_custkey GROUP BY 1""")
def rev_receipt_linkage(spark, d):
    r = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("o_orderkey"))
    mode = F.when(every(3), "not_run").when(every(3, 1), "static").otherwise("executed")
    r = r.select("c_custkey", mode.alias("mode"), (key() % 4).alias("exit_code"), F.when(every(5), "old").otherwise("new").alias("source"))
    return lineage.receipt_linkage(table(spark, d, "customer"), r, "c_custkey", F.lit("new")).groupBy("status").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT o_orderkey AS id, o_custkey AS c, o_orderkey % 4 AS after, lag(o_orderkey % 4) OVER w AS before, CASE WHEN o_orderkey % 20 = 0 THEN NULL WHEN o_orderkey % 23 = 0 THEN lag(o_orderkey, 2) OVER w ELSE lag(o_orderkey) OVER w END AS s,
  o_orderkey % 2 = 1 AS confirmed FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
ch AS (SELECT s, count(*) AS n FROM r WHERE s IS NOT NULL GROUP BY 1), ro AS (SELECT c, count(*) AS n FROM r WHERE s IS NULL GROUP BY 1),
j AS (SELECT r.*, p.after AS p_after, p.before AS p_before, p.confirmed AS pc, me.n AS children, sib.n AS siblings, ro.n AS roots FROM r LEFT JOIN r p ON p.id = r.s LEFT JOIN ch me ON me.s = r.id LEFT JOIN ch sib ON sib.s = r.s LEFT JOIN ro ON ro.c = r.c),
f AS (SELECT *, concat_ws(',', CASE WHEN before = after THEN 'no_change' END, CASE WHEN s IS NOT NULL AND before IS DISTINCT FROM p_after AND NOT (NOT pc AND confirmed AND before IS NOT DISTINCT FROM p_before AND after = p_after) THEN 'chain_broken' END,
  CASE WHEN siblings > 1 THEN 'forked' END, CASE WHEN s IS NULL AND roots > 1 THEN 'several_roots' END) AS reasons FROM j)
SELECT reasons, confirmed AND children IS NULL AND reasons = '' AS usable, count(*) AS n FROM f GROUP BY ALL""")
def rev_clarifications(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    parent = F.when(every(20), None).when(every(23), F.lag("o_orderkey", 2).over(w)).otherwise(F.lag("o_orderkey").over(w))
    r = table(spark, d, "orders").select(key().alias("id"), "o_custkey", parent.alias("supersedes"), (key() % 4).alias("after"), F.lag(key() % 4).over(w).alias("before"), F.col("o_orderdate").alias("recorded_at"), F.when(every(2, 1), "confirmed").otherwise("proposed").alias("status"))
    return lineage.clarification_chains(r, ["o_custkey"]).groupBy(F.array_join("reasons", ",").alias("reasons"), "usable").agg(F.count("*").alias("n"))


REVISIONS = """r AS (SELECT o_custkey, row_number() OVER w + CASE WHEN o_custkey % 50 = 0 THEN 1 ELSE 0 END AS revision, CASE WHEN o_orderkey % 40 = 0 THEN o_orderdate - INTERVAL 3650 DAY ELSE o_orderdate END AS seen, o_orderstatus, o_orderpriority
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""


def revisions(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    number = F.row_number().over(w) + F.when(F.col("o_custkey") % 50 == 0, 1).otherwise(0)
    r = table(spark, d, "orders").select("o_custkey", number.alias("revision"), F.when(every(40), shifted(F.col("o_orderdate"), -3650)).otherwise(F.col("o_orderdate")).alias("at"), "o_orderstatus", "o_orderpriority")
    return lineage.revision_changes(r, "o_custkey", "revision", "at", ["o_orderstatus", "o_orderpriority"])


@query(f"""WITH {REVISIONS}, b AS (SELECT *, row_number() OVER w AS i, lag(seen) OVER w AS last FROM r WINDOW w AS (PARTITION BY o_custkey ORDER BY revision))
SELECT o_custkey, count(*) AS revisions, count_if(i <> revision)::BIGINT AS wrong_numbers, count_if(coalesce(seen < last, false))::BIGINT AS times_back FROM b GROUP BY 1""")
def rev_revision_documents(spark, d):
    return revisions(spark, d)[0]


@query(f"""WITH {REVISIONS}, b AS (SELECT *, lag(o_orderstatus) OVER w AS s, lag(o_orderpriority) OVER w AS p FROM r WINDOW w AS (PARTITION BY o_custkey ORDER BY revision))
SELECT 'o_orderstatus' AS field, s AS before, o_orderstatus AS after, count(*) AS n FROM b WHERE s <> o_orderstatus GROUP BY ALL UNION ALL SELECT 'o_orderpriority', p, o_orderpriority, count(*) FROM b WHERE p <> o_orderpriority GROUP BY ALL""")
def rev_revision_changes(spark, d):
    return revisions(spark, d)[1].groupBy("field", "before", "after").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT DISTINCT o_orderkey AS k, i FROM orders, range(1, 8) t(i)), s AS (SELECT l_orderkey AS k, l_linenumber AS i, bool_or(l_returnflag <> 'R') AS present FROM lineitem GROUP BY ALL)
SELECT c.k AS o_orderkey, string_agg(c.i::VARCHAR, ',' ORDER BY c.i) AS unresolved FROM c LEFT JOIN s ON s.k = c.k AND s.i = c.i WHERE NOT coalesce(present, false) GROUP BY 1""")
def rev_unresolved(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("item"), F.when(F.col("l_returnflag") != "R", "declared_present").otherwise("requested").alias("state"))
    out = lineage.unresolved(table(spark, d, "orders"), rows, "o_orderkey", list(range(1, 8)))
    return out.withColumn("unresolved", F.array_join(F.transform("unresolved", lambda x: x.cast("string")), ","))


@query("""WITH j AS (SELECT o_orderkey AS k, o_orderstatus = 'F' AS f, k % 3 <> 0 AS has, o_orderdate AS m, CASE WHEN k % 7 = 0 THEN NULL WHEN k % 11 = 0 THEN o_orderdate - INTERVAL 1 DAY ELSE o_orderdate + INTERVAL 1 DAY END AS a FROM orders)
SELECT concat_ws(',', CASE WHEN f THEN 'measurement_missing' END, CASE WHEN NOT has OR k % 5 = 0 THEN 'signal_class_not_declared' END, CASE WHEN NOT has THEN 'measurement_time_not_declared' END, CASE WHEN has AND m > TIMESTAMP '2000-01-01' THEN 'measurement_after_review_cutoff' END,
  CASE WHEN NOT has OR a IS NULL THEN 'availability_time_not_declared' END, CASE WHEN has AND a < m THEN 'availability_before_measurement' END, CASE WHEN has AND a > TIMESTAMP '2000-01-01' THEN 'unavailable_at_review_cutoff' END,
  CASE WHEN has AND k % 4 = 0 THEN 'causal_effect_not_established' END) AS blockers, count(*) AS n FROM j GROUP BY 1""")
def rev_evidence_blockers(spark, d):
    o = table(spark, d, "orders")
    seen = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.array(F.lit("measurement_missing"))).alias("hold_reasons"))
    at = F.col("o_orderdate")
    notes = o.where(~every(3)).select(
        "o_orderkey", at.alias("measured_at"), F.when(every(7), None).when(every(11), shifted(at, -1)).otherwise(shifted(at, 1)).alias("available_at"),
        F.when(every(5), "unknown").otherwise("process").alias("signal_class"), F.when(every(4), "causal_effect").otherwise("association").alias("claim"),
    )
    out = lineage.evidence_blockers(seen, notes, "o_orderkey", day("2000-01-01"))
    return out.groupBy(F.array_join("blockers", ",").alias("blockers")).agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT *, o_orderdate <= lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS still FROM orders)
SELECT unnest(['repeated_ids', 'times_not_increasing', 'state_contradicts_reasons', 'queue_without_row', 'queue_differs']) AS finding, unnest([0, count_if(coalesce(still, false)), count_if(o_orderkey % 8 = 1), count_if(o_orderkey % 100 = 0), count_if(o_orderkey % 100 <> 0 AND o_orderkey % 10 = 0)]::BIGINT[]) AS n FROM w""")
def rev_package(spark, d):
    o = table(spark, d, "orders").withColumn("state", F.when(every(4), "withheld").otherwise("reviewable")).withColumn("hold_reasons", F.when(every(4) | every(8, 1), F.array(F.lit("x"))).otherwise(none()))
    queue = o.where(every(2)).withColumn("o_totalprice", F.col("o_totalprice") + every(10).cast("int")).withColumn("o_orderkey", F.when(every(100), -1 - key()).otherwise(key()))
    return lineage.package_findings(o, queue, "o_orderkey", "o_custkey", "o_orderdate", ["o_totalprice", "state"])


@query("""WITH j AS (SELECT o_orderkey AS k, k % 4 = 0 AS held, o_orderdate AS decided FROM orders WHERE o_orderkey % 3 = 0)
SELECT concat_ws(',', CASE WHEN k % 7 = 0 THEN 'row_unknown' END, CASE WHEN k % 7 <> 0 AND held AND k % 5 <> 0 THEN 'outcome_not_allowed_when_withheld' END, CASE WHEN k % 7 <> 0 AND held AND k % 8 = 0 THEN 'action_not_allowed_when_withheld' END,
  CASE WHEN decided < TIMESTAMP '1996-01-01' THEN 'decided_before_cutoff' END) AS reasons, count(*) AS n FROM j GROUP BY 1""")
def rev_withheld_decisions(spark, d):
    o = table(spark, d, "orders")
    context = o.where(~every(7)).select("o_orderkey", F.when(every(4), "withheld").otherwise("reviewable").alias("state"))
    decisions = o.where(every(3)).select("o_orderkey", F.when(every(5), "insufficient_evidence").otherwise("false_alarm").alias("outcome"), F.when(every(8), "release").otherwise("hold").alias("action"), F.col("o_orderdate").alias("decided_at"))
    return reasons_of(lineage.withheld_decisions(decisions, context, "o_orderkey", day("1996-01-01")))
