"""Registered queries on windowed control: each user's events are a file of daily windows. The SQL makes every window a row, empty ones too."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from gaugeworks.functions.ranking import saved
from gaugeworks.operators import protocol, windowed
from gaugeworks.operators.windowed import Config
from gaugeworks.plans.registry import query, rounded, table

DAY, HOUR = 86_400_000_000, 3_600_000_000
CONFIG = Config(width=DAY // 2, period=8 * HOUR, gap_factor=3.0, cadence=0.9, least=1, most=99.0, budget=0.05, grids={"shewhart": (1.0, 1.5, 2.0), "ewma": (1.0, 2.0, 3.0), "cusum": (2.0, 4.0, 6.0)})
RESET = Config(width=DAY // 2, period=8 * HOUR, gap_factor=3.0, cadence=0.9, least=1, most=99.0, reset_after_alarm=True, grids={"shewhart": (1.0,), "ewma": (1.0,), "cusum": (2.0,)})
CENTER, SCALE = 50.0, 20.0


def windows_sql(c):
    return f"""e0 AS (SELECT user_id, epoch_us(ts) AS us, value AS x, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM events),
f0 AS (SELECT user_id, count(*) AS n, min(us) AS t0, max(us) AS t1, CASE WHEN count(*) < 2 THEN 'shape_invalid' WHEN count_if(us <= last) > 0 THEN 'time_not_strictly_increasing'
  WHEN abs(quantile_cont(us - last, 0.5) - {c.period}) / {c.period} > {c.cadence} THEN 'cadence_mismatch' ELSE '' END AS why FROM e0 GROUP BY 1),
f AS (SELECT *, CASE WHEN why = '' THEN (t1 - t0) // {c.width} END AS complete FROM f0),
s AS (SELECT e0.*, (us - t0) // {c.width} AS k, t0, complete FROM e0 JOIN f USING (user_id) WHERE why = ''),
gap AS (SELECT user_id, (last + {c.period} - t0) // {c.width} AS lo, k AS hi FROM s WHERE us - last > {int(c.gap)}),
touched AS (SELECT DISTINCT user_id, unnest(range(lo, hi + 1)) AS k FROM gap),
grid AS (SELECT user_id, unnest(range(complete)) AS k FROM f WHERE why = ''),
full_w AS (SELECT user_id, k, count(*) AS n, sqrt(avg(CASE WHEN abs(x) <= {c.most} THEN x * x END)) AS rms, max((abs(x) > {c.most})::INT) = 1 AS over_most FROM s WHERE k < complete GROUP BY ALL),
w AS (SELECT g.user_id, g.k, coalesce(n, 0) AS n, t.k IS NOT NULL AS in_gap, coalesce(over_most, false) AS over_most, CASE WHEN t.k IS NULL AND n > 0 AND NOT over_most THEN rms END AS value,
  array_to_string(list_filter([CASE WHEN t.k IS NOT NULL THEN 'timestamp_gap' END, CASE WHEN n IS NULL THEN 'insufficient_samples' END, CASE WHEN over_most THEN 'value_out_of_range' END], lambda y: y IS NOT NULL), ',') AS reasons
  FROM grid g LEFT JOIN full_w u ON u.user_id = g.user_id AND u.k = g.k LEFT JOIN touched t ON t.user_id = g.user_id AND t.k = g.k)"""


ALL = windows_sql(CONFIG)
#: Files of days, whose gaps of more than a day and a half are told, whatever their cadence.
DAILY = Config(width=DAY, period=DAY, gap_factor=1.5, cadence=1e9, least=1, grids={"shewhart": (1.0, 1.5), "ewma": (1.0, 1.5), "cusum": (2.0, 4.0, 6.0, 8.0)})


def samples(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "value")


def run_table(spark, d, c=CONFIG, keep=False):
    """States, windows and runs. keep: windows are written first, where more than one table is made of them."""
    s = samples(spark, d)
    states = windowed.file_states(s, "user_id", ["ts", "event_id"], "t", c)
    states = saved(states) if keep else states
    placed = windowed.windows(s, states, "user_id", "t", ["value"], c)
    placed = saved(placed) if keep else placed
    return states, placed, windowed.runs(placed, "user_id", c)


@query(f"""WITH {ALL}, i AS (SELECT *, k - row_number() OVER (PARTITION BY user_id, n = 0, reasons ORDER BY k) AS island FROM w)
SELECT user_id, min(k) AS k, count(*) AS count, max(n) AS n, reasons, round(max(value), 6) AS value FROM i GROUP BY user_id, reasons, CASE WHEN n = 0 THEN island END, CASE WHEN n > 0 THEN k END""")
def spc_runs(spark, d):
    return rounded(run_table(spark, d)[2].withColumn("reasons", F.array_join("reasons", ",")))


@query(f"""WITH {ALL}, a AS (SELECT user_id, count(value) AS evaluable, count_if(in_gap) AS g, count_if(n = 0) AS i, count_if(over_most) AS o FROM w GROUP BY 1),
r AS (SELECT user_id, count(*) AS empty_runs FROM (SELECT DISTINCT user_id, reasons, island FROM (SELECT *, k - row_number() OVER (PARTITION BY user_id, n = 0, reasons ORDER BY k) AS island FROM w) WHERE n = 0) GROUP BY 1),
t AS (SELECT user_id, count_if(us - last > 86400000000) AS n_gaps, count_if(k >= complete) AS tail FROM s GROUP BY 1)
SELECT f.user_id, CASE WHEN why = '' THEN 'valid' ELSE 'invalid' END AS file_status, why AS file_reasons, complete, CASE WHEN why = '' THEN coalesce(evaluable, 0) END AS evaluable, CASE WHEN why = '' THEN t1 - t0 END AS duration,
  CASE WHEN why = '' THEN coalesce(evaluable, 0) * 43200000000 END AS evaluable_duration, round((complete - evaluable) / complete, 6) AS excluded_share, CASE WHEN why = '' THEN coalesce(g, 0) END AS timestamp_gap,
  CASE WHEN why = '' THEN coalesce(i, 0) END AS insufficient_samples, CASE WHEN why = '' THEN 0 END::BIGINT AS nonfinite_value, CASE WHEN why = '' THEN coalesce(o, 0) END AS value_out_of_range, CASE WHEN why = '' THEN coalesce(empty_runs, 0) END AS empty_runs,
  CASE WHEN why = '' THEN n_gaps END AS n_gaps, CASE WHEN why = '' THEN 0 END::BIGINT AS near_boundary, CASE WHEN why = '' THEN tail END AS tail_samples, CASE WHEN why = '' THEN t1 - t0 - complete * 43200000000 END AS tail_duration
FROM f LEFT JOIN a ON a.user_id = f.user_id LEFT JOIN r ON r.user_id = f.user_id LEFT JOIN t ON t.user_id = f.user_id""")
def spc_file_summary(spark, d):
    states, placed, runs = run_table(spark, d, keep=True)
    return rounded(windowed.file_summary(states, placed, runs, "user_id", CONFIG))


@query(f"""WITH {ALL} SELECT user_id, count(*) AS complete, count(value) AS evaluable, count_if(in_gap) AS timestamp_gap, count_if(n = 0) AS insufficient_samples, 0::BIGINT AS nonfinite_value, round(1 - count(value) / count(*), 6) AS excluded_share FROM w GROUP BY 1""")
def spc_exclusions(spark, d):
    states, placed, runs = run_table(spark, d, keep=True)
    out = windowed.file_summary(states, placed, runs, "user_id", CONFIG).where("complete > 0")
    return rounded(out.select("user_id", "complete", "evaluable", "timestamp_gap", "insufficient_samples", "nonfinite_value", "excluded_share"))


@query(f"""WITH {ALL}, b AS (SELECT user_id, k, (value IS NOT NULL)::INT AS bit FROM w), t AS (SELECT *, (bit IS DISTINCT FROM lag(bit) OVER (PARTITION BY user_id ORDER BY k))::INT AS turn FROM b),
r AS (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY k) AS run FROM t), g AS (SELECT user_id, run, min(bit) AS bit, count(*) AS n FROM r GROUP BY ALL)
SELECT user_id, count(*) AS runs, sha256(string_agg(bit || 'x' || n, ',' ORDER BY run)) AS mask_sha256 FROM g GROUP BY 1""")
def spc_mask(spark, d):
    return windowed.mask(run_table(spark, d)[2], "user_id").drop("mask")


@query(f"""WITH {ALL}, v AS (SELECT user_id, k, value FROM w WHERE value IS NOT NULL AND user_id % 4 = 0), m AS (SELECT count(*) AS n, avg(value) AS center, stddev_samp(value) AS scale FROM v),
p AS (SELECT value - center AS d, lag(value - center) OVER (ORDER BY user_id, k) AS last FROM v, m)
SELECT n, round(center, 6) AS center, round(scale, 6) AS scale, round((SELECT sum(d * last) / sum(d * d) FROM p), 6) AS lag1, 'fitted' AS state FROM m""")
def spc_autocorrelation(spark, d):
    return rounded(windowed.reference_fit(run_table(spark, d)[2].where("user_id % 4 = 0"), "user_id", CONFIG))


def statistics_sql(center, scale):
    return f"""z1 AS (SELECT user_id, k, (value - {center}) / {scale} AS z, sum((value IS NULL)::INT) OVER (PARTITION BY user_id ORDER BY k) AS segment FROM w),
z2 AS (SELECT *, sum(z - 0.5) OVER q AS up, sum(-z - 0.5) OVER q AS down, list(z) OVER q AS zs FROM z1 WHERE z IS NOT NULL WINDOW q AS (PARTITION BY user_id, segment ORDER BY k)),
stats AS (SELECT user_id, k, abs(z) AS shewhart, abs(list_reduce(list_prepend(0.0::DOUBLE, zs), lambda e, x: 0.2 * x + 0.8 * e)) / sqrt(0.2 / 1.8) AS ewma, greatest(up - least(0, min(up) OVER q), down - least(0, min(down) OVER q)) AS cusum
  FROM z2 WINDOW q AS (PARTITION BY user_id, segment ORDER BY k))"""


STATS = statistics_sql(CENTER, SCALE)


@query(f"""WITH {ALL}, {STATS} SELECT user_id, k, round(shewhart, 6) AS shewhart, round(ewma, 6) AS ewma, round(cusum, 6) AS cusum FROM stats""")
def spc_statistics(spark, d):
    return rounded(windowed.statistics(run_table(spark, d)[2], "user_id", CENTER, SCALE, CONFIG).drop("segment"))


@query(f"""WITH {ALL}, {STATS}, grid2 AS (SELECT * FROM (VALUES ('shewhart', 1.0), ('shewhart', 1.5), ('shewhart', 2.0), ('ewma', 1.0), ('ewma', 2.0), ('ewma', 3.0), ('cusum', 2.0), ('cusum', 4.0), ('cusum', 6.0)) g(method, threshold)),
c AS (SELECT method, threshold::DOUBLE AS threshold, count_if(CASE method WHEN 'shewhart' THEN shewhart WHEN 'ewma' THEN ewma ELSE cusum END > threshold) AS alarms, count(*) AS evaluable FROM stats, grid2 GROUP BY ALL),
t AS (SELECT *, alarms / evaluable <= 0.05 AS fits FROM c)
SELECT method, threshold, alarms, evaluable, NOT coalesce(bool_or(fits) OVER (PARTITION BY method ORDER BY threshold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS tried,
  fits AND NOT coalesce(bool_or(fits) OVER (PARTITION BY method ORDER BY threshold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS chosen FROM t""")
def spc_thresholds(spark, d):
    return windowed.calibrate(run_table(spark, d)[2], "user_id", CENTER, SCALE, CONFIG)


WALK = f"""RECURSIVE {ALL}, z AS (SELECT user_id, k, (value - {CENTER}) / {SCALE} AS z FROM w),
walk(user_id, k, e, up, down, stat, alarm, before) AS (
  SELECT user_id, -1::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, NULL::DOUBLE, false, false FROM (SELECT DISTINCT user_id FROM z)
  UNION ALL
  SELECT y.user_id, y.k, 0.0::DOUBLE, CASE WHEN y.z IS NULL OR st > 2 THEN 0.0 ELSE u END, CASE WHEN y.z IS NULL OR st > 2 THEN 0.0 ELSE v END, st, coalesce(st > 2, false), y.alarm
  FROM (SELECT *, greatest(u, v) AS st FROM (SELECT z.user_id, z.k, z.z, p.alarm, greatest(0.0, p.up + z.z - 0.5) + 0 * z.z AS u, greatest(0.0, p.down - z.z - 0.5) + 0 * z.z AS v FROM walk p JOIN z ON z.user_id = p.user_id AND z.k = p.k + 1)) y)"""


@query(f"""WITH {WALK} SELECT user_id, count(stat) AS evaluable, count_if(alarm) AS alarms, count_if(alarm AND NOT before) AS episodes, count_if(stat IS NULL) AS resets_not_evaluable, count_if(alarm) AS resets_after_alarm FROM walk WHERE k >= 0 GROUP BY 1""")
def spc_reset_after_alarm(spark, d):
    runs = saved(run_table(spark, d, RESET)[2])
    return windowed.alarm_counts(windowed.detect(runs, "user_id", CENTER, SCALE, "cusum", 2.0, RESET), runs, "user_id", RESET)


@query(f"""WITH {ALL}, {STATS}, a AS (SELECT s.user_id, s.k, shewhart > 1 AS alarm, shewhart > 1 AND NOT coalesce(p.b, false) AS begins FROM stats s LEFT JOIN (SELECT user_id, k + 1 AS k, shewhart > 1 AS b FROM stats) p ON p.user_id = s.user_id AND p.k = s.k)
SELECT (SELECT count(*) FROM f WHERE why = '') AS series, (SELECT sum(complete)::BIGINT FROM f WHERE why = '') AS complete, count(*) AS evaluable, count_if(alarm) + (SELECT (count(value) + count(DISTINCT user_id))::BIGINT FROM w WHERE user_id % 10 = 3) AS alarms, count_if(begins) AS episodes,
  (SELECT count(DISTINCT user_id) FROM w WHERE user_id % 10 = 3) AS contradictions FROM a""")
def spc_roll_up(spark, d):
    states, placed, runs = run_table(spark, d, keep=True)
    counts = windowed.alarm_counts(windowed.detect(runs, "user_id", CENTER, SCALE, "shewhart", 1.0, CONFIG), runs, "user_id", CONFIG)
    # Planted contradictions: these users report more alarms than windows.
    counts = counts.withColumn("alarms", F.col("alarms") + F.when(F.col("user_id") % 10 == 3, F.col("evaluable") + 1).otherwise(0))
    return windowed.roll_up(windowed.file_summary(states, placed, runs, "user_id", CONFIG), counts, "user_id")


@query("""WITH c AS (SELECT o_custkey AS k, o_orderpriority AS p, min(o_orderkey) AS o FROM orders GROUP BY ALL), r AS (SELECT DISTINCT o_custkey AS k FROM orders),
g AS (SELECT r.k, n.p, c.o FROM r CROSS JOIN (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW')) n(p) LEFT JOIN c ON c.k = r.k AND c.p = n.p),
y AS (SELECT k, p, CASE WHEN o IS NULL THEN 'missing:' || p WHEN o % 4 = 0 THEN 'p_value_only_not_accepted:' || p WHEN o % 5 = 0 THEN 'incomplete:' || p END AS why FROM g)
SELECT k AS o_custkey, CASE WHEN count(why) = 0 THEN 'stability_supported_by_annotation' ELSE 'stability_unverified' END AS status, coalesce(string_agg(why, ',' ORDER BY p), '') AS reasons FROM y GROUP BY 1""")
def spc_evidence(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("category")).agg(F.min("o_orderkey").alias("o"))
    p_only, no_basis = F.col("o") % 4 == 0, F.col("o") % 5 == 0
    e = o.select("o_custkey", "category", F.when(~p_only, "supported").alias("status"), F.when(~no_basis, "study").alias("basis"), F.lit("lab").alias("assessed_by"), F.when(p_only, 0.2).alias("p_value"))
    found = windowed.assess_stability(e, "o_custkey", ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))
    return found.withColumn("reasons", F.array_join("reasons", ","))


#: Ten runs, a user's file in the run of its last digit, in turn with each role. Each run but 0 and 9 has one thing wrong.
PLANTED = {"strict": replace(CONFIG, least_reference=1_000_000_000), "none": replace(CONFIG, budget=0.0, grids={"shewhart": (0.001,), "ewma": (0.001,), "cusum": (0.001,)})}


@query(f"""WITH {ALL}, u AS (SELECT user_id, user_id % 10 AS run, ['reference', 'calibration', 'evaluation'][1 + (user_id // 10) % 3] AS role FROM f0),
g AS (SELECT run, count_if(role = 'evaluation') AS ev FROM u GROUP BY 1), bad AS (SELECT DISTINCT run, role FROM u JOIN f0 USING (user_id) WHERE why <> ''),
v AS (SELECT w.*, run, role FROM w JOIN u USING (user_id)), fit AS (SELECT run, avg(value) AS center, stddev_samp(value) AS scale FROM v WHERE role = 'reference' GROUP BY 1),
z1 AS (SELECT user_id, v.run, role, k, (value - center) / scale AS z, sum((value IS NULL)::INT) OVER (PARTITION BY user_id ORDER BY k) AS segment FROM v JOIN fit ON fit.run = v.run),
z2 AS (SELECT *, sum(z - 0.5) OVER q AS up, sum(-z - 0.5) OVER q AS down, list(z) OVER q AS zs FROM z1 WHERE z IS NOT NULL WINDOW q AS (PARTITION BY user_id, segment ORDER BY k)),
stats AS (SELECT run, role, abs(z) AS shewhart, abs(list_reduce(list_prepend(0.0::DOUBLE, zs), lambda e, x: 0.2 * x + 0.8 * e)) / sqrt(0.2 / 1.8) AS ewma, greatest(up - least(0, min(up) OVER q), down - least(0, min(down) OVER q)) AS cusum
  FROM z2 WINDOW q AS (PARTITION BY user_id, segment ORDER BY k)),
tried AS (SELECT run, m, t, count_if(CASE m WHEN 'shewhart' THEN shewhart WHEN 'ewma' THEN ewma ELSE cusum END > t) / count(*) <= 0.05 AS fits FROM stats,
  (VALUES ('shewhart', 1.0), ('shewhart', 1.5), ('shewhart', 2.0), ('ewma', 1.0), ('ewma', 2.0), ('ewma', 3.0), ('cusum', 2.0), ('cusum', 4.0), ('cusum', 6.0)) x(m, t) WHERE role = 'calibration' GROUP BY ALL),
th AS (SELECT run, min(t::DOUBLE) FILTER (fits AND m = 'shewhart') AS a, min(t::DOUBLE) FILTER (fits AND m = 'ewma') AS b, min(t::DOUBLE) FILTER (fits AND m = 'cusum') AS c FROM tried GROUP BY 1),
e AS (SELECT g.run, ev, center, scale, a, b, c, CASE g.run WHEN 1 THEN 'invalid_config' WHEN 2 THEN 'invalid_manifest' WHEN 3 THEN 'invalid_manifest' WHEN 4 THEN 'source_verification_failed' WHEN 5 THEN 'source_verification_failed' WHEN 6 THEN 'input_missing'
    WHEN 7 THEN 'reference_invalid' WHEN 8 THEN CASE WHEN (8, 'reference') IN (SELECT (run, role) FROM bad) THEN 'reference_invalid' ELSE 'calibration_failed' END
    ELSE CASE WHEN (g.run, 'reference') IN (SELECT (run, role) FROM bad) THEN 'reference_invalid' WHEN (g.run, 'calibration') IN (SELECT (run, role) FROM bad) OR coalesce(a, b, c) IS NULL THEN 'calibration_failed' ELSE 'exploratory_alarm_activity_only' END END AS run_status,
  list_sort(list_concat(CASE g.run WHEN 1 THEN ['config_unknown'] WHEN 2 THEN ['config_sha256_mismatch'] WHEN 3 THEN ['group_count_mismatch:evaluation:' || ev || '!=' || (ev + 1)]
      WHEN 4 THEN (SELECT list('source_sha256_mismatch:' || user_id) FROM u WHERE u.run = 4 AND user_id % 20 = 4) WHEN 5 THEN (SELECT list('source_missing:' || user_id) FROM u WHERE u.run = 5 AND user_id % 20 = 5) WHEN 6 THEN ['array_missing:ghost']
      WHEN 7 THEN ['reference_windows_insufficient'] ELSE []::VARCHAR[] END,
    CASE WHEN g.run NOT IN (0, 7, 8, 9) THEN []::VARCHAR[] WHEN (g.run, 'reference') IN (SELECT (run, role) FROM bad) THEN ['reference_file_invalid'] WHEN g.run = 7 THEN []::VARCHAR[]
      ELSE list_concat(CASE WHEN (g.run, 'calibration') IN (SELECT (run, role) FROM bad) THEN ['calibration_file_invalid'] ELSE []::VARCHAR[] END,
        CASE WHEN g.run = 8 OR coalesce(a, b, c) IS NULL THEN ['calibration_failed:shewhart', 'calibration_failed:ewma', 'calibration_failed:cusum'] ELSE []::VARCHAR[] END) END)) AS why
  FROM g LEFT JOIN fit ON fit.run = g.run LEFT JOIN th ON th.run = g.run), o AS (SELECT *, run_status = 'exploratory_alarm_activity_only' AS ok FROM e)
SELECT run, run_status, array_to_string(why, ',') AS reasons, CASE WHEN NOT ok THEN '' ELSE concat_ws(',', CASE WHEN a IS NULL THEN 'calibration_failed:shewhart' END, CASE WHEN b IS NULL THEN 'calibration_failed:ewma' END, CASE WHEN c IS NULL THEN 'calibration_failed:cusum' END,
    CASE WHEN run = 9 THEN 'stability_supported_by_annotation' ELSE 'stability_unverified' END, 'reused_development_data', CASE WHEN run = 0 THEN 'exploratory_posthoc_reference_selection' END) END AS flags,
  CASE WHEN ok THEN ev END AS evaluation_recording_groups, CASE WHEN ok THEN ev END AS evaluation_files, CASE WHEN ok THEN round(center, 6) END AS center, CASE WHEN ok THEN round(scale, 6) END AS scale,
  CASE WHEN ok THEN a END AS threshold_shewhart, CASE WHEN ok THEN b END AS threshold_ewma, CASE WHEN ok THEN c END AS threshold_cusum FROM o""")
def spc_protocol(spark, d):
    s = samples(spark, d).withColumn("file", F.col("user_id").cast("string"))
    users = saved(s.select("user_id", "file").distinct())
    sha = F.sha2(F.col("file"), 256)
    role = F.element_at(F.array(*map(F.lit, protocol.ROLES)), (F.floor(F.col("user_id") / 10) % 3 + 1).cast("int"))
    files = users.select((F.col("user_id") % 10).alias("run"), "file", F.concat(F.lit("g"), "file").alias("recording_group"), role.alias("role"), F.when(F.col("user_id") % 20 == 4, F.sha2(F.lit("other"), 256)).otherwise(sha).alias("source_sha256"))
    files = files.withColumn("source_sha256", F.when(F.col("source_sha256") == F.sha2(F.lit("other"), 256), F.sha2(F.concat(F.lit("other"), "file"), 256)).otherwise(F.col("source_sha256")))
    ghost = files.where("run = 6 and role = 'evaluation'").groupBy("run", "role").agg(F.min("recording_group").alias("recording_group")).select("run", F.lit("ghost").alias("file"), "recording_group", "role", F.sha2(F.lit("ghost"), 256).alias("source_sha256"))
    sources = users.where("user_id % 20 <> 5").select("file", sha.alias("sha256")).unionByName(ghost.select("file", F.col("source_sha256").alias("sha256")))
    groups = files.groupBy("run").agg(*[F.count_if(F.col("role") == r).alias(f"{r}_groups") for r in protocol.ROLES])
    configs = {"usual": CONFIG, **PLANTED}
    name = F.when(F.col("run") == 1, "other").when(F.col("run") == 7, "strict").when(F.col("run") == 8, "none").otherwise("usual")
    digest = F.create_map(*[F.lit(x) for n, c in configs.items() for x in (n, protocol.config_digest(c))])
    runs = groups.withColumn("config", name).withColumn("config_sha256", F.when(F.col("run") == 2, F.lit("x")).otherwise(digest[F.col("config")])).withColumn("evaluation_groups", F.col("evaluation_groups") + (F.col("run") == 3).cast("long"))
    runs = runs.withColumn("protocol_status", F.when(F.col("run") == 0, "exploratory_posthoc").otherwise("prespecified")).withColumn("holdout_status", F.lit("reused_development_data"))
    evidence = runs.where("run = 9").select("run", F.explode(F.array(*map(F.lit, windowed.STABILITY))).alias("category"), F.lit("supported").alias("status"), F.lit("study").alias("basis"), F.lit("lab").alias("assessed_by"), F.lit(None).cast("double").alias("p_value"))
    files = files.unionByName(ghost).withColumn("op", F.lit("run")).withColumn("env", F.lit("lab"))
    found = protocol.protocol(runs, files, sources, s, configs, ["ts", "event_id"], "t", ["value"], evidence)["status"]
    return rounded(found.withColumn("reasons", F.array_join("reasons", ",")).withColumn("flags", F.array_join("flags", ",")))


@query(f"""WITH {windows_sql(DAILY)}, i AS (SELECT *, k - row_number() OVER (PARTITION BY user_id, n = 0, reasons ORDER BY k) AS island FROM w)
SELECT user_id, min(k) AS k, count(*) AS count, max(n) AS n, reasons, round(max(value), 6) AS value FROM i GROUP BY user_id, reasons, CASE WHEN n = 0 THEN island END, CASE WHEN n > 0 THEN k END""")
def spc_window_rms(spark, d):
    return rounded(run_table(spark, d, DAILY)[2].withColumn("reasons", F.array_join("reasons", ",")))


@query(f"""WITH {windows_sql(DAILY)} SELECT count(value) AS n, round(avg(value), 6) AS center, round(stddev_samp(value), 6) AS scale, 'fitted' AS state FROM w WHERE user_id % 4 = 0""")
def spc_reference_fit(spark, d):
    return rounded(windowed.reference_fit(run_table(spark, d, DAILY)[2].where("user_id % 4 = 0"), "user_id", DAILY).drop("lag1"))


@query(f"""WITH {windows_sql(DAILY)}, {statistics_sql(50.0, 25.0)} SELECT user_id, k, round(shewhart, 6) AS shewhart, round(ewma, 6) AS ewma, round(cusum, 6) AS cusum FROM stats""")
def spc_detectors(spark, d):
    return rounded(windowed.statistics(run_table(spark, d, DAILY)[2], "user_id", 50.0, 25.0, DAILY).drop("segment"))


@query(f"""WITH {windows_sql(DAILY)}, {statistics_sql(50.0, 25.0)}, a AS (SELECT s.user_id, shewhart > 1 AS alarm, shewhart > 1 AND NOT coalesce(p.b, false) AS begins FROM stats s LEFT JOIN (SELECT user_id, k + 1 AS k, shewhart > 1 AS b FROM stats) p ON p.user_id = s.user_id AND p.k = s.k),
c AS (SELECT user_id, count(*) AS evaluable, count_if(alarm) AS alarms, count_if(begins) AS episodes FROM a GROUP BY 1), u AS (SELECT user_id, count_if(value IS NULL) AS resets FROM w GROUP BY 1)
SELECT user_id, coalesce(evaluable, 0) AS evaluable, coalesce(alarms, 0) AS alarms, coalesce(episodes, 0) AS episodes, resets AS resets_not_evaluable FROM u LEFT JOIN c USING (user_id)""")
def spc_episodes(spark, d):
    runs = saved(run_table(spark, d, DAILY)[2])
    return windowed.alarm_counts(windowed.detect(runs, "user_id", 50.0, 25.0, "shewhart", 1.0, DAILY), runs, "user_id", DAILY).drop("resets_after_alarm")


@query(f"""WITH {windows_sql(DAILY)}, {statistics_sql(50.0, 25.0)}, c AS (SELECT t::DOUBLE AS threshold, count_if(cusum > t) AS alarms, count(*) AS evaluable FROM stats, (VALUES (2), (4), (6), (8)) g(t) GROUP BY t), fi AS (SELECT *, alarms / evaluable <= 0.05 AS fits FROM c)
SELECT threshold, alarms, evaluable, fits AND NOT coalesce(bool_or(fits) OVER (ORDER BY threshold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS chosen FROM fi""")
def spc_calibrate(spark, d):
    return windowed.calibrate(run_table(spark, d, DAILY)[2], "user_id", 50.0, 25.0, DAILY).where("method = 'cusum'").select("threshold", "alarms", "evaluable", "chosen")
