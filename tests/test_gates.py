"""The catalogue of ledger rules on its fixture, and on rows made by hand."""

from statuta import catalog
from statuta.operators import gates

SF = "/root/testdata/sf0.001"


def test_every_rule_is_broken_somewhere_and_a_clean_run_passes(spark):
    rows = catalog.queries()["pl23_ledger_gate"](spark, SF).collect()
    names = {(scope, rule) for scope, rules in gates.catalogue().items() for rule in rules}
    assert {(r.scope, r.rule) for r in rows if r.broken} == names
    assert {(r.scope, r.rule) for r in rows if r.run_id == 0} == names and all(r.passed and r.broken == 0 for r in rows if r.run_id == 0)


def test_first_rows_and_nulls(spark):
    laws = spark.createDataFrame(
        [(1, "L-1", "a.json", "valid", None, "active", "d", "t", "a", "e", "c", "high", "", ""), (1, None, None, None, None, *[None] * 9)],
        "run_id int, law_id string, report string, report_status string, issues string, status string, chronology string, treatment string, action string, evidence string, comparison string, confidence string, law_target string, law_command string",
    )
    index = spark.createDataFrame([(1, "L-1", "b.json", ""), (1, "L-1", "a.json", "")], "run_id int, law_id string, selected string, superseded string")
    candidates = spark.createDataFrame([(1, "L-1", 3, "c.json"), (1, "L-1", 9, "d.json")], "run_id int, law_id string, group_index int, report string")
    reports = spark.createDataFrame([(1, "a.json", "canonical", "broken"), (1, "a.json", "full", "valid")], "run_id int, report string, kind string, status string")
    rows = gates.broken(gates.law_rows(laws, index, candidates, reports), "law", gates.F.col("law_id"), gates.law_rules()).collect()
    assert {r.rule for r in rows if r.subject == "L-1"} == {"latest superseded"}
    assert {"report named", "in index", "validation recorded", "report valid", "status given"} <= {r.rule for r in rows if r.subject is None}
    assert gates.broken(gates.law_rows(laws.limit(0), index, candidates, reports), "law", gates.F.col("law_id"), gates.law_rules()).count() == 0


def test_provisions_are_sorted_once_and_meet_the_smallest_row_of_the_plan(spark):
    provision = [(1, "L-1", "1", "direct-amendment", "transfer", "", "page", ""), (1, None, "1", "", "", "s", "page", "x")]
    provisions = spark.createDataFrame(provision, "run_id int, law_id string, ref string, classes string, treatment string, target string, evidence string, exact_change string")
    row = lambda law, ord, command: (1, law, "1", ord, "A", "transfer", "f.xml", "", command, "")
    plan = spark.createDataFrame([row("L-1", 2, "history only"), row("L-1", 1, "move it"), row(None, 0, "")], "run_id int, law_id string, ref string, ord int, action_id string, action_type string, file string, identifier string, command string, node_ids string")
    laws = spark.createDataFrame([(1, "L-1", "title 28", ""), (1, None, "title 1", "all")], "run_id int, law_id string, law_target string, law_command string")
    rows = gates.provision_rows(provisions, plan, laws)
    told = gates.broken(rows, "provision", gates.F.col("law_id"), list(gates.provision_rules())).collect()
    assert {r.rule for r in told if r.subject == "L-1"} == {"action has target", "action has change", "executing treatment has target", "executing treatment has change", "executable names identifier"}
    assert {r.rule for r in told if r.subject is None} == {"treatment given", "in plan"}
    assert rows._jdf.queryExecution().executedPlan().toString().count(" Sort [") == 4
