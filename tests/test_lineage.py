from pyspark.sql import functions as F

from gaugeworks.operators import lineage


def test_receipts(spark):
    roster = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "who string")
    got = spark.createDataFrame([("a", "executed", 0, "new"), ("b", "executed", 1, "new"), ("c", "static", None, "old"), ("d", "not_run", None, "new")], "who string, mode string, exit_code int, source string")
    rows = {r["who"]: (r["status"], r["declared_status"]) for r in lineage.receipt_linkage(roster, got, "who", F.lit("new")).collect()}
    assert rows == {
        "a": ("EXECUTION_SUCCESS_DECLARED",) * 2, "b": ("EXECUTION_FAILURE_DECLARED",) * 2, "c": ("STALE_SOURCE", "STATIC_EVIDENCE_LINKED"), "d": ("NOT_RUN", "NOT_RUN"), "e": ("MISSING", None),
    }


def test_only_the_last_confirmed_clarification_is_usable(spark):
    rows = [
        ("1", None, "a", "b", 1, "proposed", "s"), ("2", "1", "a", "b", 2, "confirmed", "s"), ("3", "2", "b", "c", 3, "confirmed", "s"),
        ("4", None, "a", "b", 1, "confirmed", "t"), ("5", "4", "b", "c", 2, "confirmed", "t"), ("6", "4", "b", "d", 2, "confirmed", "t"), ("7", "9", "x", "x", 0, "confirmed", "u"),
    ]
    df = spark.createDataFrame(rows, "id string, supersedes string, before string, after string, recorded_at int, status string, scope string")
    got = {r["id"]: (r["reasons"], r["usable"]) for r in lineage.clarification_chains(df, ["scope"]).collect()}
    assert [k for k, v in got.items() if v[1]] == ["3"]
    assert got["5"][0] == got["6"][0] == ["forked"] and got["7"][0] == ["no_change", "parent_unknown"] and got["1"][0] == got["2"][0] == []


def test_basis(spark):
    decisions = spark.createDataFrame([("a", 10), ("b", 10), ("c", 10)], "review_id string, decided_at int")
    basis = spark.createDataFrame([("a", "context_changed", "observed", 5, "h", ["x"]), ("b", "other", "observed", 11, "h", ["y", "y"]), ("z", "other", "observed", 5, "h", [])], "review_id string, reason_code string, evidence_status string, captured_at int, digest string, refs array<string>")
    seen = spark.createDataFrame([("a", "h", ["x"], []), ("b", "h", ["x"], []), ("c", "h", [], []), ("d", "h", [], [])], "review_id string, digest string, related array<string>, reasons array<string>")
    found = lineage.decision_basis(decisions, basis, seen, F.lit(4))
    got = {r["review_id"]: r["reasons"] for r in found.collect()}
    assert got["a"] == [] and got["b"] == ["captured_out_of_time", "refs_not_related", "refs_repeated"] and got["c"] == ["basis_missing"] and got["z"][0] == "decision_unknown"
    row = lineage.basis_quality(seen, lineage.basis_diagnostics(found.where(F.size("reasons") == 0))).first()
    assert (row["observations"], row["decided"], row["pending"], row["no_structural_warning"]) == (4, 1, 3, 1)


def test_revisions_and_checklist(spark):
    df = spark.createDataFrame([("d", 1, 1, "x", None), ("d", 2, 2, "y", None), ("d", 4, 1, "y", "n")], "doc string, rev int, at int, a string, b string")
    docs, changes = lineage.revision_changes(df, "doc", "rev", "at", ["a", "b"])
    assert docs.first().asDict() == {"doc": "d", "revisions": 3, "wrong_numbers": 1, "times_back": 1}
    assert sorted(map(tuple, changes.select("rev", "field", "before", "after").collect())) == [(2, "a", "x", "y"), (4, "b", None, "n")]
    items = spark.createDataFrame([("c", "i", "declared_present"), ("c", "j", "requested")], "case string, item string, state string")
    assert lineage.unresolved(items.select("case"), items, "case", ["i", "j", "k"]).first()["unresolved"] == ["j", "k"]


def test_gate(spark):
    a = spark.createDataFrame([("x", 1), ("y", None)], "name string, value int")
    assert lineage.binding_gate(a, a).first()["open"] and not lineage.binding_gate(a, a.where("name = 'x'")).first()["open"] and not lineage.binding_gate(a.limit(0), a.limit(0)).first()["open"]
