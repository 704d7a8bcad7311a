"""The positions index on files made by hand: nesting, notes without an end, broken markup, nulls."""

import random

from statuta.operators import markup


def rows(spark, *texts):
    return markup.index(spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "file string, content string"))


def test_notes_stand_under_the_identifier_before_them(spark):
    text = '<note id="rp-pl001002-x">early</note><a identifier="/us/usc/t1/s1"/><note id="rp-pl003004-x"><heading>Pub. L. 5–6 <b>A</b>\n B</heading><b>Status.</b> kept <quotedContent/> https://x.test/a http://x.test/b SHA-256 ' + "a" * 64 + "</note>https://outside.test"
    found = {r.note_id: r for r in markup.note_inventory(rows(spark, text)).collect()}
    assert found["rp-pl001002-x"].placement is None and found["rp-pl001002-x"].heading == ""
    r = found["rp-pl003004-x"]
    assert (r.law, r.heading, r.heading_law, r.placement, r.status, r.dump) == ("3-4", "Pub. L. 5–6 A B", "5-6", "/us/usc/t1/s1", "kept", True)
    assert r.links == ["http://x.test/b", "https://x.test/a"] and r.digests == ["a" * 64]


def test_outermost_elements_and_their_law(spark):
    text = '<section identifier="/s/1"><p id="rp-a">Pub. L. 1-1 <q id="rp-b"><x href="/us/pl/2/2"/></q></p></section><p id="rp-c">Pub. L. 3-3</p></z><p id="rp-d"/><section><r id="rp-e">Pub. L. 4-4'
    found = {(r.law_id, r.location) for r in markup.incorporated(rows(spark, text)).collect()}
    assert found == {("PL-002-002", "/s/1"), ("PL-003-003", "f0")}


def test_open_notes_nulls_and_empty_texts(spark):
    long = '<note id="rp-pl001001-a">' + "x" * 9000 + "https://far.test"
    notes = markup.note_inventory(rows(spark, long, None, "")).collect()
    assert [(n.file, n.length, n.links) for n in notes] == [("f0", markup.OPEN_NOTE, [])]
    nothing = rows(spark, None, "")
    assert nothing.count() == 0 and markup.section_index(nothing).count() == 0
    assert markup.note_summary(markup.note_inventory(nothing)).collect()[0].asDict() == dict.fromkeys(("notes", "laws", "dumps", "linked", "with_digest", "other_law", "laws_repeated", "laws_in_files", "files"), 0)


def test_placement_and_enclosing_note_by_brute_force():
    rng = random.Random(3)
    parts = ['<a identifier="/us/usc/t1/s{}">', '<note id="rp-pl00100{}-n">', "</note>", 'id="n{}"', "Pub. L. {}-1 ", "plain {} "]
    for _ in range(60):
        text = "".join(rng.choice(parts).format(rng.randrange(9)) for _ in range(30))
        for at, _, kind, _, note, placement, _, _ in markup.scan(text):
            before = [m[1] for m in markup.IDENTIFIER.finditer(text) if m.start() < at]
            if kind != "element":
                assert placement == (before[-1] if before else None)
            spans = [(m.start(), e + 7 if (e := text.find("</note>", m.end())) >= 0 else min(len(text), m.start() + markup.OPEN_NOTE)) for m in markup.NOTE.finditer(text)]
            last = [s for s in spans if s[0] <= at]
            assert note == (last[-1][0] if last and at < last[-1][1] else None)


def test_mentions_of_given_laws(spark):
    laws = spark.createDataFrame([("PL-002-002",), ("PL-002-002",), (None,)], "law_id string")
    found = markup.law_mentions(rows(spark, "/us/pl/2/2 Pub. L. 2-2", "Pub. L. 3-3"), laws).collect()
    assert [(r.law_id, r.file, r.by_href, r.by_name, r.first) for r in found] == [("PL-002-002", "f0", 1, 1, 0)]
