"""Evidence behind reviews: decision bases, mappings, receipts, clarification chains, revisions, checklists, packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.operators.contracts import Rule, with_reasons

#: What a receipt declares, by its mode.
DECLARED = {"not_run": "NOT_RUN", "static": "STATIC_EVIDENCE_LINKED"}


def decision_basis(decisions: DataFrame, basis: DataFrame, observations: DataFrame, cutoff: Column) -> DataFrame:
    """Decisions and bases side by side, with reasons why a basis doesn't hold: one for each decision, captured between
    cutoff and decision, on the observation as it was, with references to distinct related changes only.

    decisions: (review_id, decided_at); basis: (review_id, reason_code, evidence_status, captured_at, digest, refs);
    observations: (review_id, digest, related, reasons).
    """
    n = F.count("*").over(Window.partitionBy("review_id"))
    b = basis.withColumn("bases", n).withColumnRenamed("digest", "basis_digest")
    seen = observations.withColumnRenamed("reasons", "observed_reasons")
    j = decisions.withColumn("decided", F.lit(True)).join(b, "review_id", "full").join(seen, "review_id", "left")
    refs = F.coalesce("refs", F.array().cast("array<string>"))
    has = F.col("bases").isNotNull()
    return with_reasons(j, [
        Rule("basis_missing", ~has),
        Rule("decision_unknown", F.col("decided").isNull()),
        Rule("basis_repeated", F.col("bases") > 1),
        Rule("observation_differs", has & ~F.col("basis_digest").eqNullSafe(F.col("digest"))),
        Rule("captured_out_of_time", has & ~F.coalesce(F.col("captured_at").between(cutoff, F.col("decided_at")), F.lit(False))),
        Rule("refs_not_related", F.size(F.array_except(refs, F.coalesce("related", F.array().cast("array<string>")))) > 0),
        Rule("refs_repeated", F.size(F.array_distinct(refs)) < F.size(refs)),
    ])


def basis_diagnostics(bases: DataFrame) -> DataFrame:
    """Adds diagnostic and status to sound bases (rows of decision_basis without reasons): hints on structure, not on truth."""
    linked, marked = F.size("refs") > 0, F.array_contains("observed_reasons", "measurement_missing")
    changed, missing = F.col("reason_code") == "context_changed", F.col("reason_code") == "measurement_missing"
    diagnostic = (
        F.when(changed & linked, "linked_change_present").when(changed, "context_reason_without_change_reference")
        .when(missing & marked, "snapshot_marks_measurement_missing").when(missing, "missing_reason_not_marked_in_snapshot").otherwise("reason_not_machine_assessed")
    )
    status = F.when((changed & linked) | (missing & marked), "no_structural_warning").when(changed | missing, "needs_human_review").otherwise("not_assessed")
    return bases.withColumn("diagnostic", diagnostic).withColumn("status", status)


def basis_quality(observations: DataFrame, diagnosed: DataFrame) -> DataFrame:
    """One row: observations, decided and pending ones, share decided, use of the reason `other`, diagnostics by status."""
    j = observations.select("review_id").join(diagnosed.select("review_id", "reason_code", F.col("status").alias("_status")), "review_id", "left")
    out = j.agg(
        F.count("*").alias("observations"), F.count("_status").alias("decided"), F.count_if(F.col("reason_code") == "other").alias("other_reasons"),
        *[F.count_if(F.col("_status") == s).alias(s) for s in ("needs_human_review", "no_structural_warning", "not_assessed")],
    )
    return out.withColumn("pending", F.col("observations") - F.col("decided")).withColumn("coverage", F.try_divide("decided", "observations")).withColumn("other_share", F.try_divide("other_reasons", "decided"))


def mapping_diagnostics(left: DataFrame, right: DataFrame, contracts: DataFrame, semantics: list[str], as_of: Column) -> DataFrame:
    """By mapping: reasons why two sources may not be used as one. Sources: (mapping_id, source_id, semantics.., digest,
    observed_at, available_at, valid_from, valid_until); contracts: (mapping_id, left_digest, right_digest, declared_at, valid_from, valid_until)."""
    side = lambda df, s: df.select("mapping_id", *[F.col(c).alias(f"{s}_{c}") for c in df.columns if c != "mapping_id"])
    j = side(contracts, "c").join(side(left, "l"), "mapping_id", "left").join(side(right, "r"), "mapping_id", "left")
    rules = []
    for s, name in (("l", "left"), ("r", "right")):
        start, seen, known, end = (F.col(f"{s}_{c}") for c in ("valid_from", "observed_at", "available_at", "valid_until"))
        rules.append(Rule(f"{name}:missing", F.col(f"{s}_source_id").isNull()))
        rules.append(Rule(f"{name}:invalid_validity_interval", start >= end))
        rules.append(Rule(f"{name}:time_outside_contract", ~((start <= seen) & (seen <= known) & (known <= as_of) & (as_of < end))))
        rules.append(Rule(f"contract:{name}:bytes_mismatch", F.col(f"{s}_source_id").isNotNull() & ~F.col(f"c_{name}_digest").eqNullSafe(F.col(f"{s}_digest"))))
        rules.append(Rule(f"contract:{name}:observation_outside_validity", ~((F.col("c_valid_from") <= seen) & (seen < F.col("c_valid_until")))))
    rules.append(Rule("sources:not_distinct", F.col("l_source_id") == F.col("r_source_id")))
    rules += [Rule(f"{c}:mismatch", ~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}"))) for c in (*semantics, "observed_at")]
    rules.append(Rule("contract:time_outside_contract", ~((F.col("c_valid_from") <= F.col("c_declared_at")) & (F.col("c_declared_at") <= as_of) & (as_of < F.col("c_valid_until")))))
    return with_reasons(j, rules).select("mapping_id", "reasons", F.when(F.size("reasons") == 0, "consistent").otherwise("held").alias("state"))


def binding_gate(declared: DataFrame, actual: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """One row: bindings declared, those that differ or are absent on either side, and whether work may begin."""
    j = declared.select(name, F.struct(value).alias("d")).join(actual.select(name, F.struct(value).alias("a")), name, "full")
    out = j.agg(F.count("d").alias("declared"), F.count_if(~F.col("d").eqNullSafe(F.col("a"))).alias("differing"))
    return out.withColumn("open", (F.col("declared") > 0) & (F.col("differing") == 0))


def receipt_linkage(roster: DataFrame, receipts: DataFrame, key: str, expected_source: Column) -> DataFrame:
    """By reviewer of the roster: what the receipt declares; one on another source is stale, a reviewer without one is missing."""
    declared = F.create_map(*[F.lit(x) for pair in DECLARED.items() for x in pair])[F.col("mode")]
    declared = F.when(F.col("mode") == "executed", F.when(F.col("exit_code") == 0, "EXECUTION_SUCCESS_DECLARED").otherwise("EXECUTION_FAILURE_DECLARED")).otherwise(declared)
    j = roster.select(key).join(receipts.select(key, "mode", "exit_code", "source", F.lit(True).alias("_there")), key, "left").withColumn("declared_status", declared)
    status = F.when(F.col("_there").isNull(), "MISSING").when(~F.col("source").eqNullSafe(expected_source), "STALE_SOURCE").otherwise(F.col("declared_status"))
    return j.withColumn("status", status).drop("_there")


def clarification_chains(records: DataFrame, scope: list[str]) -> DataFrame:
    """Adds reasons and usable. Records (id, supersedes, before, after, recorded_at, status, scope..): a parent must be known,
    of the same scope, no later, superseded once, and end where the record begins (or be the proposal it confirms); a scope has one root.
    Usable is a confirmed record without faults that nothing supersedes. Chains meet through joins on supersedes, link by link."""
    parent = records.select(F.col("id").alias("supersedes"), F.struct(*scope).alias("p_scope"), F.col("recorded_at").alias("p_at"), F.col("before").alias("p_before"), F.col("after").alias("p_after"), F.col("status").alias("p_status"), F.lit(True).alias("p"))
    children = records.where("supersedes is not null").groupBy(F.col("supersedes").alias("id")).agg(F.count("*").alias("children"))
    siblings = children.select(F.col("id").alias("supersedes"), F.col("children").alias("siblings"))
    roots = records.where("supersedes is null").groupBy(*scope).agg(F.count("*").alias("roots"))
    j = records.join(parent, "supersedes", "left").join(siblings, "supersedes", "left").join(children, "id", "left").join(roots, scope, "left")
    has = F.col("supersedes").isNotNull()
    confirms = (F.col("p_status") == "proposed") & (F.col("status") == "confirmed") & F.col("before").eqNullSafe(F.col("p_before")) & F.col("after").eqNullSafe(F.col("p_after"))
    out = with_reasons(j, [
        Rule("no_change", F.col("before").eqNullSafe(F.col("after"))),
        Rule("parent_unknown", has & F.col("p").isNull()),
        Rule("scope_differs", has & F.col("p") & ~F.struct(*scope).eqNullSafe(F.col("p_scope"))),
        Rule("chain_broken", has & F.col("p") & ~confirms & ~F.col("before").eqNullSafe(F.col("p_after"))),
        Rule("predates_parent", F.col("recorded_at") < F.col("p_at")),
        Rule("forked", F.col("siblings") > 1),
        Rule("several_roots", ~has & (F.col("roots") > 1)),
    ])
    usable = (F.col("status") == "confirmed") & F.col("children").isNull() & (F.size("reasons") == 0)
    return out.select(*records.columns, "reasons", F.coalesce(usable, F.lit(False)).alias("usable"))


def revision_changes(revisions: DataFrame, document: str, revision: str, at: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(documents, changes). By document: revisions, wrong numbers, times that run back. Changes: (document, revision, field, before, after) of neighbours."""
    w = Window.partitionBy(document).orderBy(revision)
    rows = revisions.withColumn("_n", F.row_number().over(w)).withColumn("_last", F.lag(at).over(w))
    docs = rows.groupBy(document).agg(F.count("*").alias("revisions"), F.count_if(F.col("_n") != F.col(revision)).alias("wrong_numbers"), F.count_if(F.col(at) < F.col("_last")).alias("times_back"))
    each = F.array(*[F.struct(F.lit(c).alias("field"), F.lag(F.col(c).cast("string")).over(w).alias("before"), F.col(c).cast("string").alias("after")) for c in fields])
    moved = rows.withColumn("_each", each).where("_n > 1").select(document, revision, F.inline("_each"))
    return docs, moved.where(~F.col("before").eqNullSafe(F.col("after")))


def unresolved(cases: DataFrame, checklist: DataFrame, case: str, items: list) -> DataFrame:
    """By case: items not declared present, absent ones included. The item list is fixed and small."""
    state = checklist.groupBy(case, "item").agg(F.max(F.col("state") == "declared_present").alias("present"))
    wanted = cases.select(case).distinct().withColumn("item", F.explode(F.array(*[F.lit(i) for i in items])))
    j = wanted.join(state, [case, "item"], "left").where(~F.coalesce("present", F.lit(False)))
    return j.groupBy(case).agg(F.sort_array(F.collect_list("item")).alias("unresolved"))


def evidence_blockers(observations: DataFrame, annotations: DataFrame, key: str, as_of: Column) -> DataFrame:
    """By observation: its own hold reasons, then what its annotation (measured_at, available_at, signal_class, claim) leaves open."""
    j = observations.join(annotations, key, "left")
    measured, available = F.col("measured_at"), F.col("available_at")
    more = {
        "signal_class_not_declared": F.coalesce(F.col("signal_class") == "unknown", F.lit(True)), "measurement_time_not_declared": measured.isNull(), "measurement_after_review_cutoff": measured > as_of,
        "availability_time_not_declared": available.isNull(), "availability_before_measurement": available < measured, "unavailable_at_review_cutoff": available > as_of,
        "causal_effect_not_established": F.col("claim") == "causal_effect",
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in more.items()]))
    return j.withColumn("blockers", F.concat(F.coalesce("hold_reasons", F.array().cast("array<string>")), found))


def package_findings(rows: DataFrame, queue: DataFrame, key: str, series: str, ts: str, compared: list[str]) -> DataFrame:
    """Findings (finding, n) on a context package: repeated ids, times not increasing in a series, queue rows that differ from or lack their row,
    rows withheld without a reason or with one but not withheld."""
    w = Window.partitionBy(series).orderBy(ts, key)
    r = rows.withColumn("_again", F.count("*").over(Window.partitionBy(key)) > 1).withColumn("_still", F.col(ts) <= F.lag(ts).over(w))
    own = r.agg(F.count_if("_again").alias("repeated_ids"), F.count_if("_still").alias("times_not_increasing"), F.count_if((F.col("state") == "withheld") != (F.size("hold_reasons") > 0)).alias("state_contradicts_reasons"))
    q = queue.select(key, F.struct(*compared).alias("q")).join(rows.select(key, F.struct(*compared).alias("r")), key, "left")
    against = q.agg(F.count_if(F.col("r").isNull()).alias("queue_without_row"), F.count_if(F.col("r").isNotNull() & ~F.col("q").eqNullSafe(F.col("r"))).alias("queue_differs"))
    tall = lambda df: df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("finding"), F.col(c).alias("n")) for c in df.columns])))
    return tall(own).union(tall(against))


def withheld_decisions(decisions: DataFrame, context: DataFrame, key: str, as_of: Column) -> DataFrame:
    """Adds reasons: a withheld row takes `insufficient_evidence` with hold, check or reinspect only; no decision before the cutoff."""
    j = decisions.join(context.select(key, "state"), key, "left")
    held = F.col("state") == "withheld"
    return with_reasons(j, [
        Rule("row_unknown", F.col("state").isNull()),
        Rule("outcome_not_allowed_when_withheld", held & (F.col("outcome") != "insufficient_evidence")),
        Rule("action_not_allowed_when_withheld", held & ~F.col("action").isin("hold", "equipment_check", "reinspect")),
        Rule("decided_before_cutoff", F.col("decided_at") < as_of),
    ])
