"""Decision tables and three-level validation on rows made by hand."""

import pytest
from pyspark.sql import functions as F

from statuta.operators import decisions, validation


def decided(spark, rules, **row):
    df = spark.createDataFrame([(row.get("a"), row.get("tags"))], "a string, tags array<string>")
    return decisions.decide(df, rules, {"a": F.col("a"), "tags": F.col("tags")}, ["out"]).first()


def test_first_match_conflicts_and_operations(spark):
    rules = [
        ("both", 2, [("tags", "all", ["x", "y"])], {"out": "both"}), ("x", 2, [("tags", "any", ["x"])], {"out": "x"}), ("word", 1, [("a", "has", ["needle", "pin"])], {"out": "word"}),
        ("not", 3, [("a", "not empty", []), ("a", "not is", ["stop"])], {"out": None}), ("none", 9, [("a", "empty", [])], {"out": "none"}),
    ]
    assert decided(spark, rules, a="a pin", tags=["x", "y"]).rule == "word"
    r = decided(spark, rules, a="", tags=["y", "x"])
    assert (r.rule, r.decided_out, r.conflicts) == ("both", "both", ["x"])
    assert decided(spark, rules, a="go", tags=None).rule == "not" and decided(spark, rules, a="go", tags=[]).decided_out is None
    assert decided(spark, rules, a=None, tags=None).rule == "none"
    assert decided(spark, rules, a="stop", tags=[]).rule is None
    assert decided(spark, [], a="x", tags=[]).rule is None


def test_tables_that_are_wrong_are_refused(spark):
    for rules in ([("r", 1, [("b", "is", ["1"])], {})], [("r", 1, [("a", "like", ["1"])], {})], [("r", 1, [], {}), ("r", 2, [], {})]):
        with pytest.raises(ValueError):
            decided(spark, rules, a="x", tags=[])


LAW = "idx int, ord int, law_id string, is_object boolean, status string, chronology string, treatment string, recommendation string, evidence string, comparison string, confidence string"
PROVISION = "idx int, ord int, is_object boolean, classes array<string>, treatment string, target string, evidence string, change string"


def law(idx, ord, law_id, status="active", ok=True, **blank):
    return (idx, ord, law_id, ok, status, *[blank.get(k, "x") for k in ("chronology", "treatment", "recommendation", "evidence", "comparison", "confidence")])


def test_statuses_of_reports_by_precedence(spark):
    laws = [
        law(1, 1, "A"), law(2, 1, "A", status="Source Unavailable"), law(2, 2, "B", status=""), law(3, 1, "A", status=None), law(4, 1, "A", confidence=None), law(5, 1, "A", ok=False), law(6, 1, "A"), law(6, 2, "A"), law(7, 1, "A"),
        law(30, 1, "A", status="unresolved"), law(8, 1, "A", evidence=""), law(10, 1, "C"),
    ]
    provisions = [(7, 1, True, ["repeal"], "new-section", "", "e", "c"), (1, 1, True, ["repeal"], "Note-only", "", "e", ""), (10, 1, True, None, None, None, "e", None)]
    n = {i: sum(x[0] == i for x in laws) for i in range(40)}
    reports = [(i, n[i], f"r{i}") for i in (1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 30)] + [(9, 1, "r9"), (12, 0, "same")]
    manifests = [(i, 1, f"m{i}") for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 30, 31)] + [(12, 0, "same")]
    asked = [(i, "A") for i in (1, 2, 3, 4, 6, 7, 8, 30)] + [(2, "B"), (10, "C"), (9, "Z")]
    checked = validation.law_level(spark.createDataFrame(laws, LAW), spark.createDataFrame(provisions, PROVISION))
    rows = validation.report_level(spark.createDataFrame(reports, "idx int, law_count long, digest string"), spark.createDataFrame(manifests, "idx int, law_count long, digest string"), checked, spark.createDataFrame(asked, "idx int, law_id string"))
    assert {r.idx: r.status for r in rows.collect()} == {
        1: "valid", 2: "source unavailable", 3: "missing conclusion", 4: "incomplete", 5: "schema-invalid", 6: "missing laws", 7: "missing target", 8: "incomplete", 9: "schema-invalid", 10: "valid", 11: "schema-invalid", 12: "manifest-copy",
        30: "unresolved conclusion", 31: "schema-invalid",
    }
    told = {r.subset: r for r in validation.summary(rows, checked).collect()}
    assert (told["all"].reports, told["canonical"].reports, told["all"].laws, told["all"].undecided_laws, told["canonical"].reports_without_source) == (14, 12, 3, 2, 2)
    assert {(r.subset, r.status): r.n for r in validation.status_counts(rows).collect()}["all", "schema-invalid"] == 4
    assert {r.law_id: r.idx for r in validation.latest(checked, rows).collect()} == {"A": 30, "B": 2, "C": 10}
