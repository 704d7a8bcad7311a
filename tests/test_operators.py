"""Operators on small inline rows."""

from datetime import date

from pyspark.sql import functions as F

from statuta.functions import text as T
from statuta.operators import cards, checks, extract, ledger, match, patch, rules


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_law_numbers(spark):
    law = T.extract_law_number(F.col("a"), F.col("b"))
    assert one(spark, law, a="5-6 | Pay", b="Public Law 41–7")["law_id"] == "PL-041-007"
    assert one(spark, law, a="5-6 | Pay", b="")["law_id"] == "PL-005-006"
    assert one(spark, law, a="P.L. 101-1234", b="")["law_id"] == "PL-101-1234"
    assert one(spark, law, a="Budget of 1999", b="") is None
    assert one(spark, T.title_from_card_name(F.col("a")), a="Public Law 41-7 | Fair Pay Act") == "Fair Pay Act"
    assert one(spark, T.title_from_card_name(F.col("a")), a="Public Law 41-7") == "Public Law 41-7"


def test_text_functions(spark):
    assert one(spark, T.normalize_whitespace(F.col("a")), a="﻿a  b \r\n\n\n\n c ") == "a b\n\nc"
    assert one(spark, T.clean_xml_text(F.col("a")), a="a\x01b😀c") == "abc"
    assert one(spark, T.tokenize(F.col("a")), a="The Law of farm-aid's 3 crops") == ["farm-aid's", "crops"]
    assert one(spark, T.safe_slug(F.col("a")), a="--!!--") == "item"
    assert one(spark, T.rtf_to_text(F.col("a")), a=r"{\b Bold\par next}") == "Bold\n next"
    assert one(spark, T.citation(F.col("a")), a="/us/usc/t5/s301/a/1") == "5 U.S.C. § 301(a)(1)"
    assert one(spark, T.pinpoint_absolute(F.lit("/us/usc/t7/s1b"), F.col("a")), a="a.1") == "/us/usc/t7/s1b/a/1"
    assert tuple(one(spark, T.route(F.col("a")), a="https://x.test/cite/42/1983/?p=b")) == ("42", "1983", "b")
    assert tuple(one(spark, T.route(F.col("a")), a="https://x.test/")) == (None, None, None)
    assert one(spark, T.section_label(F.col("a")), a="[§ 101.") == "101"
    assert tuple(one(spark, T.heading_body_split(F.col("a"), "Text"), a="“SEC. 2. Pay.—\nBody\nmore ”")) == ("Pay", "Body\nmore")
    assert tuple(one(spark, T.heading_body_split(F.col("a"), "Text"), a="A title.\r\nBody")) == ("A title", "Body") and tuple(one(spark, T.heading_body_split(F.col("a"), "Text"), a="x" * 160)) == ("Text", "x" * 160)
    assert tuple(one(spark, T.heading_body_split(F.col("a"), "Text"), a="(a) Body")) == ("Text", "(a) Body")
    assert one(spark, T.file_kind(F.lit("x"), F.lit(""), F.col("a")), a="%PDF-1.7") == ".pdf"
    assert one(spark, T.file_kind(F.lit("x"), F.lit("text/html; charset=x"), F.col("a")), a="") == ".html"
    assert one(spark, T.paragraphs(F.col("a")), a="a\nb\n\n\nc") == ["a b", "c"]


def test_status_and_canonical_card(spark):
    rows = [
        ("1", "Public Law 41-7 | Fair Pay Act", "Current Laws", "", date(2020, 1, 1), "Text", 1),
        ("2", "Public Law 41-7 | Fair Pay Act", "Repealed Laws", "", date(2021, 1, 1), "A longer text", 3),
        ("3", "Ideas", "Archive", "", date(2021, 1, 1), "be it enacted", 0),
        ("4", "Pub. L. 9-1 | Old Act [expired]", "Archive", "", date(2021, 1, 1), "Text", 0),
        ("5", "Pub. L. 9-2 | Act", "Archive", "", date(2021, 1, 1), "Status: void", 0),
        ("6", "Pub. L. 9-3 | The Expired Visa Act", "Archive", "", date(2021, 1, 1), "", 0),
    ]
    df = cards.identified(spark.createDataFrame(rows, "card_id string, name string, list_name string, label string, last_activity date, description string, n_attachments int"))
    best = {r.law_id: r for r in cards.canonical(df).collect()}
    assert (best["PL-041-007"].card_id, best["PL-041-007"].status, best["PL-041-007"].duplicates) == ("1", "active", 1)
    assert {k: v.status for k, v in best.items() if k != "PL-041-007"} == {"PL-009-001": "expired", "PL-009-002": "invalid", "PL-009-003": "active"}
    assert [r.card_id for r in cards.suspected_unparsed(df).collect()] == ["3"]


def test_first_url_and_ranks(spark):
    rows = [("1", 1, "u.pdf", "Signed act", date(2020, 1, 1), "board", 1), ("1", 2, "u.pdf", "Draft", date(2020, 1, 1), "board", 2), ("1", 3, "", "x", None, "board", 3), ("1", 4, "v.png", "image", date(2020, 1, 1), "action", 4)]
    df = spark.createDataFrame(rows, "card_id string, ordinal int, url string, name string, added date, source string, part_no int")
    assert [r.ordinal for r in cards.first_url_wins(df).orderBy("ordinal").collect()] == [1, 4]
    ranked = {r.ordinal: (r.points, r["rank"]) for r in cards.ranked_attachments(df.where("url <> ''")).collect()}
    assert ranked[1] == (18 + 5 + 8 + 2, 1) and ranked[4] == (-15 - 30, 3)


def test_citations_with_and_without_offsets(spark):
    df = spark.createDataFrame([(1, "See section 1001. of title 18, United States Code, and 5 U.S.C. § 301; title 1, U.S.C., section 7."), (2, ""), (3, None)], "id long, text string")
    assert sorted((r.title, r.section) for r in extract.citations(df, "id", "text").collect()) == [(1, "7"), (5, "301"), (18, "1001")]
    found = extract.find_all(df, "id", "text", {"usc": r"(\d+) U\.S\.C\. § (\d+)"}).collect()
    assert [(r.raw, list(r.groups), r.end - r.start) for r in found] == [("5 U.S.C. § 301", ["5", "301"], 14)]


def test_dependencies(spark):
    said = (
        "Public Law 1-2 is hereby repealed. As amended, Public Law 3-4 stands. See Public Law 9-9 and Public Law 5-5. No provision of Public Law 2-2 shall be read to repeal another act. "
        "This act supersedes Public Law 6-1, amends Public Law 6-2 and, notwithstanding any provision of Public Law 6-3, goes on repealing the provisions of Public Law 6-4. Public Law 6-5, and are hereby\n repealed. Public Law 6-2 is repealed."
    )
    df = spark.createDataFrame([("PL-009-009", said), ("PL-001-001", None), ("PL-001-003", "")], "law_id string, text string")
    want = {
        ("PL-001-002", "repeals", "high"), ("PL-003-004", "references", "low"), ("PL-005-005", "references", "low"), ("PL-002-002", "references", "low"), ("PL-006-001", "supersedes", "high"), ("PL-006-002", "amends", "medium"),
        ("PL-006-003", "overrides", "medium"), ("PL-006-004", "repeals", "high"), ("PL-006-005", "repeals", "high"), ("PL-006-002", "repeals", "high"),
    }
    assert {(r.target, r.relation, r.confidence) for r in extract.dependencies(df, "law_id", "text").collect()} == want


def test_a_part_named_after_the_citation_is_no_whole_repeal(spark):
    from statuta.operators import edits

    said = ["Section 10 of title 5, United States Code, subsection (b), is repealed.", "Section 10 of title 5, United States Code, is repealed, and subsection (b) stays.", "Section 10 of title 5, United States Code (c) is hereby repealed."]
    docs = spark.createDataFrame(list(enumerate(said)), "id int, text string")
    sections = spark.createDataFrame([(5, "10")], "title int, section string")
    assert {(r.id, r.kind) for r in edits.operations(docs, "id", "text", sections).collect()} == {(0, "REPEAL_PART"), (1, "REPEAL_SECTION"), (2, "REPEAL_PART")}


def test_blocks_and_edits(spark):
    df = spark.createDataFrame([(1, 'Intro\nSEC. 1. One\nbody\nSection 2. Two\nstriking "a  b" and inserting "c"\n')], "id long, text string")
    assert [(r.block, r.heading) for r in extract.numbered_sections(df, "id", "text").orderBy("block").collect()] == [(1, "SEC. 1. One"), (2, "Section 2. Two")]
    assert [tuple(r)[1:] for r in extract.strike_inserts(df, "id", "text").collect()] == [("a b", "c")]


def test_overrides_need_a_later_active_law(spark):
    edges = spark.createDataFrame([("PL-010-001", "PL-009-001", "repeals"), ("PL-011-001", "PL-009-001", "supersedes"), ("PL-001-001", "PL-009-002", "repeals"), ("PL-012-001", "PL-009-003", "amends")], "source string, target string, relation string")
    laws = spark.createDataFrame([(f"PL-{c:03d}-{n:03d}", True) for c, n in ((9, 1), (9, 2), (9, 3), (10, 1), (11, 1), (1, 1), (12, 1))], "law_id string, active boolean")
    assert [tuple(r) for r in match.overrides(edges, laws).collect()] == [("PL-009-001", "PL-010-001")]


def test_strike_needs_exactly_one_place(spark):
    sections = spark.createDataFrame([("s1", "red and blue"), ("s2", "red red"), ("s3", "x")], "identifier string, body string")
    ops = spark.createDataFrame([("s1", 1, "red", "green"), ("s1", 2, "green", "grey"), ("s2", 1, "red", "green")], "identifier string, ord long, old_text string, new_text string")
    out = {r.identifier: (r.body, r.applied, r.refused) for r in patch.strike_insert(sections, ops).collect()}
    assert out == {"s1": ("grey and blue", 2, 0), "s2": ("red red", 0, 1), "s3": ("x", 0, 0)}
    notes = spark.createDataFrame([("s1", 1, "m", "said")], "identifier string, ord long, marker string, note string")
    once = patch.append_notes(sections, notes)
    assert sorted(map(tuple, patch.append_notes(once, notes).collect())) == sorted(map(tuple, once.collect()))


def test_numbering_does_not_depend_on_partitions(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("g"), F.col("id").alias("o"))
    numbers = [sorted(map(tuple, ledger.numbered(df.repartition(n), "g", ["o"]).collect())) for n in (1, 8)]
    assert numbers[0] == numbers[1] and sorted(x[2] for x in numbers[0]) == list(range(1, 101))


def test_gates(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, v string")
    assert {tuple(r) for r in checks.gate(df, "id", {"has v": F.col("v") == "a", "id": F.col("id") > 0}).collect()} == {("has v", 1, False), ("id", 0, True)}


def test_six_dispositions(spark):
    base = {"incorporated": False, "active": True, "has_source": True, "category": "", "direct": False, "rider": False, "temporary": 0, "permanent": 5, "supplement": False, "unresolved": False}
    cases = [({"direct": True}, "DIRECT_CODE_AMENDMENT"), ({}, "STATUTORY_NOTE"), ({"category": "private"}, "NON_CODE"), ({"active": False}, "NONOPERATIVE_OR_REPEALED"), ({"incorporated": True}, "ALREADY_INCORPORATED"),
             ({"direct": True, "supplement": True}, "HYBRID_DIRECT_AMENDMENT_AND_STATUTORY_NOTE"), ({"category": "appropriation", "rider": True}, "STATUTORY_NOTE"), ({"temporary": 10}, "NON_CODE"), ({"has_source": False}, "SOURCE_UNAVAILABLE")]
    for change, want in cases:
        columns = {k: F.lit(v) for k, v in (base | change).items()}
        assert spark.range(1).select(patch.disposition(columns).alias("d")).first()["d"] == want


def test_targets_and_operations(spark):
    from statuta.operators import edits

    rest = " and so on for a good many words, so that the next heading is far enough from the citation to count"
    text = (
        "SEC. 1. A. Section 10 of title 5, United States Code, is hereby repealed" + rest + ".\nSEC. 2. B. Section 11(a)(1) of title 5, United States Code, is repealed" + rest
        + '.\nSEC. 3. C. 7 U.S.C. § 12 is amended to read as follows: "§ 12. Lists\n' + "A list shall be kept of all the makers and all the sellers of every item there is." + '"\nSEC. 4. D. Section 99 of title 5, United States Code, lists items. It is amended.'
    )
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, text + "\n" + text)], "id int, text string")
    sections = spark.createDataFrame([(5, "10"), (7, "12"), (5, "11")], "title int, section string")
    rows = {(r.id, r.kind, r.title, r.section, r.confidence) for r in edits.operations(docs, "id", "text", sections).collect()}
    assert rows == {(i, k, t, s, c) for i in (1, 4) for k, t, s, c in [("REPEAL_SECTION", 5, "10", "high"), ("REPEAL_PART", 5, "11", "medium"), ("REPLACE_SECTION", 7, "12", "high")]}
    assert edits.targets(docs.limit(0), "id", "text").count() == 0


def test_new_sections_need_the_chapter_formula(spark):
    from statuta.operators import edits

    body = "chapter 3 of title 9, United States Code, is amended by adding at the end the following:\n“§ 31a. Records.\nEach office shall keep its records for ten years.”"
    docs = spark.createDataFrame([(1, "The Act. " + body), (2, "§ 31a. Records. No formula."), (3, None)], "id int, text string")
    chapters = spark.createDataFrame([(9, "3")], "title int, chapter string")
    none, has = (spark.createDataFrame(rows, "title int, section string") for rows in ([], [(9, "31a")]))
    got = edits.new_sections(docs, "id", "text", chapters, none).collect()
    assert [(r.id, r.title, r.section, r.heading, r.confidence) for r in got] == [(1, 9, "31a", "Records", "high")]
    assert [r.confidence for r in edits.new_sections(docs, "id", "text", chapters, has).collect()] == ["medium"]


def test_expressions_of_edits_are_computed_once(spark):
    from statuta.operators import edits

    docs, none = spark.createDataFrame([(1, "")], "id int, text string"), spark.createDataFrame([], "title int, section string")
    plan = edits.operations(docs, "id", "text", none).where("kind = 'APPEND_TEXT'")._jdf.queryExecution().optimizedPlan().toString()
    # The pattern of the next heading stands at one place, not wherever a filter or a column uses the window.
    assert plan.count(edits.NEXT_SECTION) == 1 and plan.count(edits.VERB) == 1


def test_matches_begin_where_the_first_characters_are(spark):
    import random
    import re

    from statuta.functions import text as T
    from statuta.operators import edits

    parts = ["Section 5 of title 4, United States Code", "\u017fection 5(a) of title 1 united states code", "115 U.S.C. § 7", "5 u s c §§ ", "section ", "s", "SECT", "12", "3 U", " ", "\n", "chapter 2 of title 9, United States Code, adding the following", "Chapter ", "Public Law 1-2", "Pub. L. 3-4", "P.L. 5–6", "p", "PL7-8", "x"]
    rng = random.Random(3)
    for pattern, starts in ((edits.TARGET, edits.TARGET_STARTS), (edits.CHAPTER, edits.CHAPTER_STARTS), (T.LAW_PATTERN, edits.LAW_STARTS)):
        compiled, firsts = re.compile(pattern), [re.compile(s) for s in starts]
        found = 0
        for _ in range(2000):
            text = "".join(rng.choice(parts) for _ in range(rng.randrange(9)))
            expected = [m.span() for m in compiled.finditer(text)]
            assert [m.span() for m in edits.matches(text, compiled, firsts)] == expected
            found += len(expected)
        assert found > 200


def test_chronology_keeps_repeats(spark):
    from statuta.operators import edits

    docs = spark.createDataFrame([("PL-001-002", "Public Law 3-4 is suspended. Public Law 3-4 again. Public Law 1-2 is this one.")], "id string, text string")
    assert [(r.target, r.verbs) for r in edits.chronology(docs, "id", "text").collect()] == [("PL-003-004", "delay")] * 2


def test_breadcrumbs_show_what_they_cannot_reach(spark):
    from statuta.operators import nodes

    tree = spark.createDataFrame([("a", None, "A"), ("b", "a", ""), ("c", "b", "C"), ("x", "y", "X"), ("y", "x", "Y")], "id string, parent string, label string")
    got = {r.id: (r.path, r.complete) for r in nodes.breadcrumbs(tree, 3).collect()}
    assert got["a"] == ("A", True) and got["b"] == ("A", True) and got["c"] == ("A > C", True) and not got["x"][1]


def test_notes_descend_the_ladder(spark):
    from statuta.operators import nodes

    rows = spark.createDataFrame([("n1", "L", "f", "/us/usc/t1/s1"), ("n2", "M", "f", "/us/usc/t1/s1/a"), ("n3", "L", "f", "/us/usc/t1/s8"), ("n4", "M", "f", None), ("n5", "M", "g", None), ("n6", "M", "f", "/us/usc/t1/s8")], "note_id string, law_id string, file string, identifier string")
    existing = spark.createDataFrame([("n6", "f"), ("n6", "g")], "note_id string, file string")
    sections = spark.createDataFrame([("f", "/us/usc/t1/s1", None, 2), ("f", "/us/usc/t1/s0", None, 1), ("f", "/us/usc/t1/s5", "L", 5)], "file string, identifier string, law_id string, ord int")
    got = {r.note_id: (r.how, r.identifier) for r in nodes.placed_notes(rows, existing, sections).collect()}
    assert got == {"n1": ("exact", "/us/usc/t1/s1"), "n2": ("parent", "/us/usc/t1/s1"), "n3": ("law", "/us/usc/t1/s5"), "n4": ("first", "/us/usc/t1/s0"), "n5": ("unplaced", None), "n6": ("replaced", "/us/usc/t1/s8")}
    assert [(r.note_id, r.file) for r in nodes.stale_notes(rows, existing).collect()] == [("n6", "g")]


def test_strike_and_insert_is_a_direct_amendment(spark):
    from statuta.operators import classify

    text = 'Section 10 of title 5, United States Code, is amended by striking "old words" and inserting "new words".'
    docs = spark.createDataFrame([("PL-001-001", text, "active", False), ("PL-001-002", text.replace("10", "11"), "active", False)], "law_id string, text string, status string, incorporated boolean")
    sections, chapters = spark.createDataFrame([(5, "10")], "title int, section string"), spark.createDataFrame([], "title int, chapter string")
    got = {r.law_id: (r.disposition, r.confidence, r.n_direct, r.n_safe) for r in classify.classify(docs, sections, chapters).collect()}
    assert got == {"PL-001-001": ("DIRECT_CODE_AMENDMENT", "high", 1, 1), "PL-001-002": ("HYBRID_DIRECT_AMENDMENT_AND_STATUTORY_NOTE", "high", 1, 0)}


def test_operations_run_by_their_number(spark):
    sections = spark.createDataFrame([("s", "h", "a b", "")], "identifier string, heading string, body string, notes string")
    rows = [("L-10", 10, "L", 1, "s", 1, "STRIKE_INSERT", "c", "d", "m", "high"), ("L-2", 2, "L", 1, "s", 1, "STRIKE_INSERT", "a", "c", "m", "high")]
    ops = spark.createDataFrame(rows, "op_id string, op_no int, law_id string, law_order int, identifier string, title int, kind string, old_text string, new_text string, marker string, confidence string")
    after, told = patch.apply_manifest(sections, ops)
    assert after.first().body == "d b" and {r.status for r in told.collect()} == {"executed"}


def test_superseded_reads_the_edges_once(spark):
    from statuta.operators import classify, extract

    texts = [("PL-002-001", "Public Law 1-1 is hereby repealed."), ("PL-003-001", "Repealing Public Law 1-1. Public Law 4-1 is superseded."), ("PL-001-001", "None."), ("PL-004-001", None)]
    docs = spark.createDataFrame(texts, "law_id string, text string")
    laws = docs.selectExpr("law_id", "'active' as status", "'STATUTORY_NOTE' as disposition", "'medium' as confidence")
    out = classify.superseded(laws, extract.dependencies(docs, "law_id", "text").selectExpr("law_id as source", "target", "relation", "confidence"))
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()
    told = {r.law_id: (r.disposition, r.superseded_by, list(r.warnings)) for r in out.collect()}
    assert told["PL-001-001"] == ("SUPERSEDED_BEFORE_CODIFICATION", "PL-002-001", [])
    assert told["PL-003-001"] == ("STATUTORY_NOTE", None, ["not earlier: supersedes PL-004-001"])
    assert told["PL-002-001"][1:] == told["PL-004-001"][1:] == (None, [])


def test_normalize_whitespace_of_plain_and_odd_texts(spark):
    import re

    said = ["plain text", " one\tblank ", "two  blanks", "a \n b", "a\r\nb\rc", "a\n\n\n\nb", "﻿x  y", " x\ty ", "", None, "a\t\tb", "x \t\n"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string")

    def want(s):
        if s is None:
            return None
        s = s.replace("﻿", "").replace(" ", " ")
        for p, by in (("\r\n?", "\n"), ("[ \t]+\n", "\n"), ("\n[ \t]+", "\n"), ("[ \t]{2,}", " "), ("\n{3,}", "\n\n")):
            s = re.sub(p, by, s)
        return s.strip(" \t\n\r")

    assert [r.s for r in df.select("i", T.normalize_whitespace(F.col("s")).alias("s")).orderBy("i").collect()] == [want(s) for s in said]


def test_manifest_deals_operations_out_before_it_collects_them(spark):
    ops = [
        ("o1", 1, "PL-1", 1, "s1", 7, "APPEND_TEXT", "unused", "New.", "M1", "low"), ("o2", 2, "PL-1", 1, "s1", 7, "APPEND_TEXT", None, "Other.", "M1", "high"), ("o3", 3, "PL-1", 1, "s1", None, "STRIKE_INSERT", "a", "b", "M2", "high"),
        ("o4", 1, "PL-2", 2, "s1", 7, "STRIKE_INSERT", "gone", "b", "M3", "high"), ("o5", 1, "PL-2", 2, "s2", 7, "ADD_NEW_SECTION", "x", "A new section of text", None, "high"), ("o6", 1, "PL-3", 3, None, 7, "MOVE", "x", "y", "M", "high"), ("o7", 1, "PL-4", 4, "s2", 7, "REPEAL_SECTION", "x", "y", "M", "low"),
    ]
    ops = spark.createDataFrame(ops, "op_id string, op_no int, law_id string, law_order int, identifier string, title int, kind string, old_text string, new_text string, marker string, confidence string")
    sections = spark.createDataFrame([("s1", "One", "a text", "")], "identifier string, heading string, body string, notes string")
    after, told = patch.apply_manifest(sections, ops)
    assert {r.op_id: r.status for r in told.collect()} == {
        "o1": "executed", "o2": "already-present", "o3": "skipped-no-title", "o4": "fallback-note:executed", "o5": "executed", "o6": "unsupported", "o7": "withheld-preserved-by-note",
    }
    assert {tuple(r) for r in after.collect()} == {("s1", "One", "a text", "[M1] New.\n[M3] b\n"), ("s2", "A new section of tex", "A new section of text", "")}
    assert "REPARTITION_BY_COL" in told._jdf.queryExecution().executedPlan().toString()


def test_operations_are_one_pass_over_the_texts(spark):
    from statuta.operators import edits

    said = 'Section 5 of title 7, United States Code, is amended by STRIKING "one" and inserting "two", by striking "one" and inserting "two" and by adding at the end the following: "(z) More.". Section 6 of title 7, United States Code, is hereby repealed.'
    docs = spark.createDataFrame([("A", said), ("B", None)], "law_id string, text string")
    sections = spark.createDataFrame([(7, "5")], "title int, section string")
    out = edits.operations(docs, "law_id", "text", sections)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = sorted((r.kind, r.section, r.old_text, r.new_text, r.confidence) for r in out.collect())
    assert [g for g in got if g[0] != "APPEND_TEXT"] == [("REPEAL_SECTION", "6", "", "", "medium"), ("STRIKE_INSERT", "5", "one", "two", "high")]
    assert [g[:2] for g in got if g[0] == "APPEND_TEXT"] == [("APPEND_TEXT", "5")]


def test_kinds_leave_out_work_and_nothing_else(spark):
    from statuta.operators import edits

    at = "Section %d%s of title 5, United States Code, is "
    orders = ["hereby repealed.", "amended to read as follows:  \t“%s. Lists\nA list of all the makers.”\n", 'amended by adding at the end the following: "(z) More."', 'amended by striking "a" and inserting "b".',
              'amended by striking "a b" and inserting as follows: "c"; by striking "a b" and inserting "c".', "kept."]
    docs = spark.createDataFrame([(i, "\nSEC. 7. Next. ".join(at % (i + k, p) + o.replace("%s", str(i + k)) for k, o in enumerate(orders))) for i in range(3) for p in ("", "(a)")], "id int, text string")
    sections = spark.createDataFrame([(5, str(i)) for i in range(0, 9, 2)], "title int, section string")
    every = sorted(map(tuple, edits.operations(docs, "id", "text", sections).collect()))
    assert {r[1] for r in every} == set(edits.KINDS)
    for some in (["REPLACE_SECTION"], ["APPEND_TEXT"], ["STRIKE_INSERT"], ["REPEAL_SECTION", "REPEAL_PART"], ["REPEAL_PART"], ["REPEAL_SECTION", "APPEND_TEXT"]):
        assert sorted(map(tuple, edits.operations(docs, "id", "text", sections, some).collect())) == [r for r in every if r[1] in some]
    plan = edits.operations(docs, "id", "text", sections, ["REPLACE_SECTION"])._jdf.queryExecution().optimizedPlan().toString()
    assert edits.STRIKE not in plan
    # Known sections are joined to the first of each target, not to the windows of all.
    assert plan.index("Join") < plan.index("min_by(block")


def test_blocks_that_nobody_asks_for_are_not_moved(spark):
    from statuta.operators import edits

    docs, chapters, none = spark.createDataFrame([(1, "")], "id int, text string"), spark.createDataFrame([], "title int, chapter string"), spark.createDataFrame([], "title int, section string")
    out = edits.new_sections(docs, "id", "text", chapters, none)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by(block" in plan(out) and "min_by(block" not in plan(out.select("section", "n_chars", "confidence"))


def test_starts_are_searched_only_where_a_text_has_what_they_need(spark):
    import random
    import re

    from statuta.operators import edits

    parts = ["Section 5 of title 4, United States Code", "115 U.S.C. § 7", "5 u s c §§ 4(a)", "5 USC§1", "12 USC\n§ 3", "§ 7", '"§ 12. ', "C", ".", " ", "12", "3 U"]
    pattern, starts, needs = re.compile(edits.TARGET), [re.compile(s) for s in edits.TARGET_STARTS], [re.compile(n) for n in edits.TARGET_NEEDS]
    rng = random.Random(4)
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(7)))
        assert [m.span() for m in edits.matches(text, pattern, starts, needs)] == [m.span() for m in pattern.finditer(text)]


def test_edges_need_no_regular_expression(spark):
    from statuta.operators import edits

    said = "This act REVIVES,  \n and restores, Public Law 1-2 \t.  Nothing is postponed."
    out = edits.chronology(spark.createDataFrame([("PL-009-009", said)], "law_id string, text string"), "law_id", "text")
    assert [tuple(r) for r in out.collect()] == [("PL-009-009", "PL-001-002", "delay,revive", "This act REVIVES, and restores, Public Law 1-2 . Nothing is postponed.")]
    assert "RLIKE" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_dealt_out_once_to_classify_laws(spark):
    from statuta.operators import classify

    text = 'Section 10 of title 5, United States Code, is amended by striking "old words" and inserting "new words".'
    laws = [(f"PL-001-00{i}", f"Act {i}", t, "active", False) for i, t in enumerate((text, text + " " + text, "A commemorative coin.", "", None, text.replace("10", "11")))]
    schema = "law_id string, name string, text string, status string, incorporated boolean"
    docs = spark.createDataFrame([*laws, *laws], schema).distinct()
    sections, chapters = spark.createDataFrame([(5, "10")], "title int, section string"), spark.createDataFrame([], "title int, chapter string")
    out = classify.classify(docs, sections, chapters, "name")
    got = sorted(map(tuple, out.collect()))
    direct, hybrid = "DIRECT_CODE_AMENDMENT", "HYBRID_DIRECT_AMENDMENT_AND_STATUTORY_NOTE"
    want = [(direct, 1, 1, 0), (direct, 1, 1, 0), ("NON_CODE", 0, 0, 0), ("SOURCE_UNAVAILABLE", 0, 0, 0), ("SOURCE_UNAVAILABLE", 0, 0, 0), (hybrid, 1, 0, 1)]
    assert [(r[1], *r[3:]) for r in got] == want and [r[2] for r in got] == ["high", "high", "medium", "high", "high", "high"]
    # One shuffle has texts, that of the distinct docs, which all passes over the texts read; none has blocks, or texts by law.
    lines = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    dealt = [line for line in lines if "Exchange hashpartitioning" in line and "ReusedExchange" not in line]
    assert sum("text#" in line for line in dealt) == 1, "\n".join(dealt)


def test_phrases_of_a_text_are_told_alike_by_both_forms(spark):
    import random

    from statuta.operators import rules

    rng = random.Random(5)
    said = [p for phrases in (rules.PERMANENT, rules.TEMPORARY) for p, _ in phrases] + [p for _, phrases in rules.NON_CODE for p in phrases] + rules.RIDER + rules.RESIDUAL
    said += ["$ 5", "$ 5", "$x", "fiscal year", "appropriates $", "Spiele", "İ", "K"]
    texts = ["", *["".join(rng.choice([p, p.upper(), p[1:], " ", "\n"]) + rng.choice(["", " "]) for p in rng.choices(said, k=rng.choice([1, 2, 5, 40]))) for _ in range(600)]]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").withColumns({"low": F.lower("text"), "category": rules.non_code_category("text"), "rider": rules.permanent_rider()})
    for r in rules.character_scores(docs).withColumn("residual", rules.present(F.col("low"), rules.RESIDUAL)).collect():
        ours = (rules.category_of(r.low), rules.weight_of(r.low, rules.PERMANENT), rules.weight_of(r.low, rules.TEMPORARY), rules.how_many(r.low, rules.RIDER) >= 2, rules.how_many(r.low, rules.RESIDUAL))
        assert ours == (r.category, r.permanent_score, r.temporary_score, r.rider, r.residual), r.text
