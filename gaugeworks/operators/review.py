"""Review, decision and lineage joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.ranking import saved
from gaugeworks.functions.times import time_beside

#: Fixed values.
OUTCOMES = ("confirmed_issue", "false_alarm", "insufficient_evidence")
ACTIONS = ("reinspect", "equipment_check", "hold", "release", "no_action")


def bind_decisions(queue: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queue with decisions, pending rows kept; rejected decisions with a reason). Keys: review_id; decided_at, recorded_at."""
    n = F.count("*").over(Window.partitionBy("review_id"))
    known = queue.select("review_id", F.lit(1).alias("known")).distinct()
    d = decisions.withColumn("n", n).join(known, "review_id", "left")
    reason = (
        F.when(F.col("known").isNull(), "unknown_review").when(F.col("n") > 1, "decided_twice").when(F.col("decided_at") > F.col("recorded_at"), "decided_after_recording")
        .when(~F.col("outcome").isin(*OUTCOMES), "outcome_not_allowed").when(~F.col("action").isin(*ACTIONS), "action_not_allowed")
    )
    d = d.withColumn("reason", reason).drop("n", "known")
    good = d.where("reason is null").drop("reason")
    return queue.join(good, "review_id", "left").withColumn("state", F.when(F.col("outcome").isNull(), "pending").otherwise("decided")), d.where("reason is not null")


def context_holds(rows: DataFrame, changes: DataFrame, baseline: DataFrame, key: str, ts: str = "ts", at: str = "effective_at", value: str = "value", coverage: DataFrame | None = None, change_id: str | None = None) -> DataFrame:
    """Adds the changes of a row's series inside its baseline and after it up to the row, and the reasons to withhold; with the name of the
    changes' id also `related_changes`, these changes' ids in the order of time, then id.

    Changes and rows are laid in one time order by series and counted as they pass: no pairs of rows and changes.
    baseline: (key, baseline_start, baseline_end and, if known, flagged: its statistics need a review); a series without one
    is withheld. coverage: (key, start, end, complete) of the change history; a series whose rows it doesn't cover is withheld."""
    lines = rows.select(key, F.col(ts).alias("_t"), F.struct(*rows.columns).alias("_row"), F.lit(0).alias("_change")).unionByName(
        changes.select(key, F.col(at).alias("_t"), F.lit(1).alias("_change")), allowMissingColumns=True)
    base = baseline.select(key, "baseline_start", "baseline_end", (F.coalesce("flagged", F.lit(False)) if "flagged" in baseline.columns else F.lit(False)).alias("_flagged"))
    lines = lines.join(base, key, "left")
    inside = (F.col("_change") == 1) & F.col("_t").between(F.col("baseline_start"), F.col("baseline_end"))
    after = (F.col("_change") == 1) & (F.col("_t") > F.col("baseline_end"))
    w = Window.partitionBy(key).orderBy("_t", F.desc("_change")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key)
    out = lines.withColumn("changes_inside", F.count_if(inside).over(whole)).withColumn("changes_after", F.count_if(after).over(w))
    out = out.withColumn("_before", F.count_if((F.col("_change") == 1) & (F.col("_t") < F.col("baseline_start"))).over(whole))
    own = F.when(F.col("_change") == 0, F.col("_t"))
    out = out.withColumn("_first", F.min(own).over(whole)).withColumn("_last", F.max(own).over(whole)).where("_change = 0")
    covered = F.lit(True)
    if coverage is not None:
        out = out.join(coverage.select(key, F.col("start").alias("_start"), F.col("end").alias("_end"), F.col("complete").alias("_complete")), key, "left")
        covered = F.coalesce(F.col("_complete") & (F.col("_start") <= F.col("_first")) & (F.col("_end") >= F.col("_last")), F.lit(False))
    reasons = F.array_compact(F.array(
        F.when(~covered, "history_coverage_unverified"), F.when(F.col("baseline_end").isNull(), "baseline_absent"), F.when(F.col("changes_inside") > 0, "change_inside_baseline"),
        F.when(F.col("changes_after") > 0, "change_after_baseline"), F.when(F.col(f"_row.{value}").isNull(), "measurement_missing"), F.when(F.col("_flagged"), "statistical_baseline_requires_review")))
    told = ["changes_inside", "changes_after", reasons.alias("hold_reasons"), F.when(F.size(reasons) > 0, "withheld").otherwise("context_clear").alias("state")]
    if change_id is None:
        return out.select("_row.*", *told)
    return _related(out.select("_row", key, F.col("_before").alias("_first"), (F.col("_before") + F.col("changes_inside") + F.col("changes_after")).alias("_end"), *told), changes, key, at, change_id)


#: Ids of a series' changes that are kept as one array.
IDS = 4096


def _related(rows: DataFrame, changes: DataFrame, key: str, at: str, change_id: str, ids: int = IDS) -> DataFrame:
    """The ids of the changes _first .. _end - 1 of each row's series, numbered in their order. A series' ids are arrays of bounded size;
    a row takes slices of those that its range touches, in most cases of one. Rows and changes are never paired."""
    numbered = changes.select(key, (F.row_number().over(Window.partitionBy(key).orderBy(at, change_id)) - 1).alias("_no"), F.col(change_id).alias("_name"))
    block = F.floor(F.col("_no") / ids).alias("_block")
    blocks = numbered.groupBy(F.col(key).alias("_key"), block).agg(F.sort_array(F.collect_list(F.struct("_no", "_name"))).alias("_ids"))
    some, low, high = F.col("_first") < F.col("_end"), F.floor(F.col("_first") / ids), F.floor((F.col("_end") - 1) / ids)

    def with_ids(part: DataFrame) -> DataFrame:
        a = F.greatest(F.col("_first") - F.col("_block") * ids, F.lit(0))
        b = F.least(F.col("_end") - F.col("_block") * ids, F.lit(ids))
        j = part.join(blocks.withColumnRenamed("_block", "_of"), (F.col(key) == F.col("_key")) & (F.col("_block") == F.col("_of")))
        return j.withColumn("_part", F.slice("_ids", (a + 1).cast("int"), (b - a).cast("int"))["_name"])

    shown = ["_row.*", "changes_inside", "changes_after", "hold_reasons", "state"]
    kind = f"array<{changes.schema[change_id].dataType.simpleString()}>"
    none = rows.where(~some).select(*shown, F.array().cast(kind).alias("related_changes"))
    one = with_ids(rows.where(some & (low == high)).withColumn("_block", low)).select(*shown, F.col("_part").alias("related_changes"))
    long = saved(rows.where(some & (low < high))).withColumn("_place", F.monotonically_increasing_id())
    parts = with_ids(long.select("_place", key, "_first", "_end", F.explode(F.sequence(low, high)).alias("_block"))).groupBy("_place").agg(F.flatten(F.sort_array(F.collect_list(F.struct("_block", "_part")))["_part"]).alias("related_changes"))
    return none.unionByName(one).unionByName(long.join(parts, "_place").select(*shown, "related_changes"))


def change_timeline(changes: DataFrame, spans: DataFrame, key: str, at: str = "effective_at") -> tuple[DataFrame, DataFrame]:
    """(changes with their period, changes of series that aren't measured). spans: (key, first, baseline_end, last) of the measured series.
    Periods: before_baseline, baseline, monitoring, scheduled (after the last reading)."""
    t = F.col(at)
    period = F.when(t < F.col("first"), "before_baseline").when(t <= F.col("baseline_end"), "baseline").when(t <= F.col("last"), "monitoring").otherwise("scheduled")
    known = changes.join(spans.select(key, "first", "baseline_end", "last"), key).withColumn("period", period).drop("first", "baseline_end", "last")
    return known, changes.join(spans.select(key), key, "left_anti")


def knowledge_cutoff(rows: DataFrame, history: DataFrame, changes: DataFrame, key: str, as_of: Column, ts: str = "ts") -> DataFrame:
    """Rows (key, reason, n) of what wasn't known at the cutoff: readings after it, histories published after it, coverage that ends after its
    publication or begins after its end, and changes that became available after their history. history: (key, available_at, start, end);
    changes: (key, available_at)."""
    late = rows.where(F.col(ts) > as_of).groupBy(key).agg(F.count("*").alias("n")).select(key, F.lit("measurement_after_cutoff").alias("reason"), "n")
    why = F.array_compact(F.array(F.when(F.col("available_at") > as_of, "history_unavailable_at_cutoff"), F.when((F.col("start") > F.col("end")) | (F.col("end") > F.col("available_at")), "coverage_dates_invalid")))
    of_history = history.select(key, F.explode(why).alias("reason")).groupBy(key, "reason").agg(F.count("*").alias("n"))
    j = changes.select(key, F.col("available_at").alias("_known")).join(history.select(key, F.col("available_at").alias("_published")), key, "left")
    of_changes = j.where(F.coalesce(F.col("_known") > F.col("_published"), F.lit(True))).groupBy(key).agg(F.count("*").alias("n")).select(key, F.lit("change_postdates_history").alias("reason"), "n")
    return late.unionByName(of_history).unionByName(of_changes)


def evidence_digest(fields: list[str]) -> Column:
    """SHA-256 of a row's evidence as JSON, in the declared order of the fields and with nulls written out."""
    return F.sha2(F.to_json(F.struct(*[F.col(f).cast("string").alias(f) for f in fields]), {"ignoreNullFields": "false"}), 256)


def review_identity(source_sha: Column, sample: Column, measurement: Column) -> Column:
    """24 hexadecimal digits that tie a review to the bytes of its source, its sample and its measurement."""
    return F.substring(F.sha2(F.concat_ws(":", source_sha, sample.cast("string"), measurement.cast("string")), 256), 1, 24)


def queue_integrity(queue: DataFrame, fields: list[str], source_sha: str = "source_sha256", sample: str = "sample_id", measurement: str = "measurement") -> DataFrame:
    """Rows (review_id, reasons) of a saved queue whose evidence digest, id or uniqueness doesn't hold."""
    twice = queue.groupBy("review_id").agg(F.count("*").alias("_n"))
    reasons = F.array_compact(F.array(
        F.when(F.col("_n") > 1, "review_id_repeated"), F.when(~F.col("evidence_sha256").eqNullSafe(evidence_digest(fields)), "evidence_digest_differs"),
        F.when(~F.col("review_id").eqNullSafe(review_identity(F.col(source_sha), F.col(sample), F.col(measurement))), "review_id_not_of_source")))
    return queue.join(twice, "review_id", "left").select("review_id", reasons.alias("reasons")).where(F.size("reasons") > 0)


def reconcile(expected: DataFrame, archive: DataFrame, key: str, captured: str, digest: str) -> DataFrame:
    """Findings by kind over an archive: unexpected, missing, duplicate, other time, other digest."""
    a = archive.groupBy(key).agg(F.count("*").alias("n"), F.min(captured).alias("a_time"), F.min(digest).alias("a_digest"))
    j = expected.select(key, F.col(captured).alias("e_time"), F.col(digest).alias("e_digest"), F.lit(1).alias("e")).join(a, key, "full")
    kinds = {"unexpected": F.col("e").isNull(), "missing": F.col("n").isNull(), "duplicate": F.col("n") > 1, "time_changed": F.col("e_time") != F.col("a_time"), "digest_changed": F.col("e_digest") != F.col("a_digest")}
    return j.agg(*[F.count_if(c).alias(k) for k, c in kinds.items()])


def roster_state(roster: DataFrame, received: DataFrame, key: str) -> DataFrame:
    """By roster row: SUBSTITUTED (received more than once) before MISSING before MATCH; foreign ids count as SUBSTITUTED."""
    r = received.groupBy(key).agg(F.count("*").alias("n"))
    j = roster.select(key, F.lit(1).alias("listed")).join(r, key, "full")
    state = F.when(F.col("listed").isNull() | (F.col("n") > 1), "SUBSTITUTED").when(F.col("n").isNull(), "MISSING").otherwise("MATCH")
    return j.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def receipt_audit(roster: DataFrame, receipts: DataFrame, cutoff, key: str, group: str, scored: DataFrame | None = None) -> DataFrame:
    """By group: rows of the roster, admitted by the cutoff, late only, never received, scored (if a table of scored keys is given) and a
    verdict: BLOCKED (some were not admitted in time), MISSING (an admitted one wasn't scored) or MATCH."""
    r = receipts.groupBy(key).agg(F.count_if(F.col("received_at") <= time_beside(receipts, "received_at", cutoff)).alias("in_time"), F.count("*").alias("n"))
    j = roster.join(r, key, "left")
    if scored is not None:
        j = j.join(scored.select(key, F.lit(1).alias("_scored")).distinct(), key, "left")
    seen = [F.count_if((F.col("in_time") > 0) & F.col("_scored").isNotNull()).alias("scored")] if scored is not None else []
    out = j.groupBy(group).agg(F.count("*").alias("listed"), F.count_if(F.col("in_time") > 0).alias("admitted"), F.count_if(F.col("in_time") == 0).alias("late_only"), F.count_if(F.col("n").isNull()).alias("lost"), *seen)
    verdict = F.when(F.col("admitted") < F.col("listed"), "BLOCKED")
    return out.withColumn("verdict", (verdict.when(F.col("scored") < F.col("admitted"), "MISSING") if seen else verdict).otherwise("MATCH"))


#: Listed and received rows that one task compares, on average.
TASK_ROWS = 1_000_000


def receipt_sets(roster: DataFrame, received: DataFrame, roster_id: str, key: str) -> DataFrame:
    """By roster: SUBSTITUTED (a foreign or a repeated key was received) before MISSING (a listed key wasn't) before MATCH. A row without
    a key equals no other one; a key that is listed twice counts once.

    Listed and received rows are counted side by side, without a join, by tasks whose number goes with the rows."""
    side = lambda df, listed: df.select(roster_id, key, F.lit(listed).alias("_listed"))
    both = side(roster, True).unionByName(side(received, False))
    tasks = max(int(roster.sparkSession.conf.get("spark.sql.shuffle.partitions")), both.count() // TASK_ROWS + 1)
    g = both.repartition(tasks, roster_id, key).groupBy(roster_id, key).agg(F.max("_listed").alias("listed"), F.count_if(~F.col("_listed")).alias("n"))
    blank = F.col(roster_id).isNull() | F.col(key).isNull()
    odd = F.when(blank, F.col("n") > 0).otherwise(~F.col("listed") | (F.col("n") > 1))
    lacks = F.when(blank, F.col("listed")).otherwise(F.col("n") == 0)
    out = g.groupBy(roster_id).agg(F.max(odd).alias("odd"), F.max(lacks).alias("lacks"))
    return out.select(roster_id, F.when(F.col("odd"), "SUBSTITUTED").when(F.col("lacks"), "MISSING").otherwise("MATCH").alias("state"))
