"""The gate of results: every rule is met by the fixture, and rows made by hand."""

import random
from collections import Counter

from statuta import catalog
from statuta.operators import results as R

SF = "/root/testdata/sf0.001"
PLAN = "action_id string, action_type string, treatment string, identifier string, node_ids array<string>"
FILES = "file string, content string"


def result(spark, *rows):
    names = [part.split(" ")[0] for part in R.RESULTS.replace("struct<base:string,file:string,node:string,identifier:string,existing:string,comparison:string>", "x").replace("struct<action:string,law:string,target:string,chronology:string,proof:string>", "x").split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], R.RESULTS)


def test_every_rule_is_broken_somewhere(spark):
    rows = catalog.queries()["pl24_result_gate"](spark, SF).collect()
    assert {(r.scope, r.rule) for r in rows} == {(s, r) for s, held in R.catalogue().items() for r in held}
    assert [r.rule for r in rows if not r.broken] == []


def test_nulls_repeats_and_empty_tables(spark):
    files = spark.createDataFrame([("usc/a.xml", None), (None, '<p id="x">'), ("a.xml", "")], FILES)
    plan = spark.createDataFrame([("A", None, None, None, None), ("A", "no Code action", None, None, None), (None, None, None, None, None)], PLAN)
    rows = result(spark, {"nr": 1, "action_id": "A"}, {"nr": 2, "action_id": "A"}, {"nr": 3})
    found = Counter(tuple(r) for r in R.failures(rows, plan, files, files, "b", "board").collect())
    assert found[("result", "A", "other status valid")] == 2 and found[("result", None, "planned")] == 1 and found[("plan", None, "has a result")] == 1
    assert R.failures(rows.limit(0), plan.limit(0), files.limit(0), files.limit(0), "b", "board").count() == 0


def test_paths_with_backslashes_and_moves(spark):
    before = spark.createDataFrame([("usc/a.xml", '<s identifier="/us/usc/t1/s1"/>\nsame\nother words here stand alone now')], FILES)
    after = spark.createDataFrame([("a.xml", 'same\n<s identifier="/us/usc/t1/s1"/>\nother words here stand alone now')], FILES)
    plan = spark.createDataFrame([("A", "amend existing text", None, "/us/usc/t1/s1", [])], PLAN)
    rows = result(spark, {"nr": 1, "action_id": "A", "status": "applied", "file": "usc\\a.xml", "said": "other words here stand alone now", "credit": "c", "amendment": "a"})
    assert {r.rule for r in R.failures(rows, plan, before, after, "b", "board").collect()} == {"applied file changed", "applied has its change"}


def test_changed_lines_by_counting(spark):
    rng = random.Random(5)
    sides = [[(f"f{i}", "\n".join(rng.choice("abc") for _ in range(rng.randrange(7)))) for i in range(20)] for _ in range(2)]
    found = {tuple(r) for r in R.changed_lines(*[spark.createDataFrame(s, FILES) for s in sides]).collect()}
    expected = set()
    for (file, old), (_, new) in zip(*sides, strict=True):
        one, two = Counter(old.split("\n")), Counter(new.split("\n"))
        expected |= {(file, line) for line in one | two if one[line] != two[line]}
    assert found == expected


def test_words_of_claims(spark):
    text = "<b class='four'>Some</b> more WORDS of a b c some text1 über"
    row = spark.createDataFrame([(text,), (None,)], "t string").select(R.words(R.F.col("t")).alias("w")).collect()
    assert [r.w for r in row] == [["some", "more", "words", "text1"], []]


def test_notes_that_share_an_id(spark):
    note = lambda said: f'<note id="rp-pl001002-codification">{said}</note>'
    first, second = "each office keeps seven lists about makers", "other wording governs sellers under chapter nine"
    before = spark.createDataFrame([("a.xml", "x"), ("b.xml", "y")], FILES)
    after = spark.createDataFrame([("a.xml", note(first) + "\n" + note(second + " board")), ("b.xml", note("manifest-7"))], FILES)
    plan = spark.createDataFrame([(a, "add statutory note", "statutory_note", None, ["rp-pl001002-codification"]) for a in "AB"], PLAN)
    rows = result(spark, *[{"nr": i, "action_id": a, "status": "applied", "file": "a.xml", "said": said} for i, (a, said) in enumerate([("A", first), ("B", second)])])
    found = {(r.subject, r.rule) for r in R.failures(rows, plan, before, after, "b", "board").collect() if r.scope in ("result", "note")}
    assert found == {("B", "note clean"), ("rp-pl001002-codification", "no internal wording")}


def test_gate_where_ids_are_cut(spark, tmp_path):
    import duckdb

    # Keys of seven digits share the six that a note's id keeps.
    part = spark.read.parquet(f"{SF}/part.parquet")
    part.withColumn("p_partkey", (part.p_partkey + 1_000_000).cast(part.schema["p_partkey"].dataType)).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = Counter(tuple(r) for r in catalog.queries()["pl24_result_failures"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    assert found == Counter(con.execute(catalog.oracle_sql()["pl24_result_failures"]).fetchall())
