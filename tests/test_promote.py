"""Approval and publication on rows made by hand; every reason occurs in the fixture."""

from statuta import catalog
from statuta.operators import promote as P

SF = "/root/testdata/sf0.001"


def test_every_reason_and_move_occurs(spark):
    q = catalog.queries()
    assert {r.reason for r in q["pl29_promote_plan"](spark, SF).collect()} == {"", "no plan", "not a draft", "blank summary", "no operations", "source hash differs"}
    assert {r.how for r in q["pl29_moved_targets"](spark, SF).collect()} == {"changed", "gone", "new"}


def test_nulls_and_empty_tables(spark):
    requests = spark.createDataFrame([(None, None), ("A", ""), ("B", "x")], "law_id string, confirmed string")
    plans = spark.createDataFrame([(None, "draft", "s", "h"), ("A", "draft", "s", None), ("B", None, "s", "x")], "law_id string, status string, summary string, source_sha256 string")
    ops = spark.createDataFrame([("A", None), ("B", "i")], "law_id string, identifier string")
    got = {r.law_id: (r.state, r.reason) for r in P.promote(requests, plans, ops).collect()}
    assert got == {None: ("missing", "no plan"), "A": ("approved", ""), "B": ("", "not a draft")}
    assert P.promote(requests.limit(0), plans, ops).count() == 0 and P.promote(requests, plans.limit(0), ops).where("state <> 'missing'").count() == 0


def test_published_by_marker_or_name_and_title(spark):
    files = spark.createDataFrame([("f", '<n id="m1"/>Pub. L. 2–2 Lists Act. Pub. L. 3–3'), ("g", None)], "file string, content string")
    laws = spark.createDataFrame([("PL-001-001", "x", "f", "m1"), ("PL-002-002", "Lists Act", "f", "m2"), ("PL-003-003", "Other Act", "f", "m3"), ("PL-004-004", None, "g", "m1"), ("PL-005-005", "Lists Act", None, None)], "law_id string, title string, file string, marker string")
    assert sorted(r.law_id for r in P.unpublished(laws, files).collect()) == ["PL-003-003", "PL-004-004", "PL-005-005"]


def test_what_files_hold_is_not_shipped_whole(spark, tmp_path):
    from statuta.operators import promote

    spark.createDataFrame([("f", "<p id=\"m1\">x</p>")], "file string, content string").write.parquet(str(tmp_path / "files"))
    laws = spark.createDataFrame([("PL-001-001", "T", "f", "m1"), ("PL-001-002", "T", "f", "m2"), ("PL-001-003", "T", "g", "m1")], "law_id string, title string, file string, marker string")
    out = promote.unpublished(laws, spark.read.parquet(str(tmp_path / "files")))
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert sorted(map(tuple, out.collect())) == [("PL-001-002", "f"), ("PL-001-003", "g")]
