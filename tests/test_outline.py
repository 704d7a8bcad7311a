"""Sections and subsections against Python's re and hand-made outlines."""

import random
import re

from statuta.operators import outline

FORMS = [re.compile(r"(?im)^[ \t]*(?:SEC(?:TION)?\.?[ \t]*)(\d+[A-Za-z]?|[IVXLCDM]+)[ \t]*(?:[.\-—:)]|$)[ \t]*([^\n]*)$"), re.compile(r"(?im)^[ \t]*§[ \t]*(\d+[A-Za-z]?)[ \t]*(?:[.\-—:)]|$)[ \t]*([^\n]*)$")]


def plain(text):
    starts = sorted({m.start(): m[1] for f in FORMS for m in f.finditer(text)}.items())
    out = {}
    for (a, number), b in zip(starts, [*[s for s, _ in starts[1:]], len(text)]):
        block = text[a:b].strip()
        if len(block) > len(out.get(number.upper(), "")):
            out[number.upper()] = block
    return out


def test_sections_equal_re(spark):
    draw = random.Random(4)
    lines = ["SEC. 1. One", "Sec 2", "section iv: Four", "§ 3.", " § 12a) x", "SEC. 1 Title", "SEC. XL - Forty", "text", "", "\t", "in sec. 2. of", "SECTION 9—Nine", "SEC.7", "sec. 1.", "a longer line of text"]
    rows = [(i, "\n".join(draw.choices(lines, k=draw.randrange(0, 14)))) for i in range(200)] + [(900, ""), (901, "SEC. 1. alone"), (902, "x\n" * 20_000 + "SEC. 5. Late\nend")]
    df = spark.createDataFrame([*rows, (903, None)], "id int, text string").repartition(4)
    got = {}
    for r in outline.split_sections(df, "id", "text").collect():
        got.setdefault(r.id, {})[r.number] = r.block
    assert got == {i: plain(t) for i, t in rows if plain(t)}


def test_selection_is_all_or_nothing(spark):
    text = "SEC. I. A\nSEC. 2. B\nlonger\nSEC. 2. C\nSEC. IX. D"
    cases = [(["1"], "SEC. I. A", "sections 1"), (["2", "1"], "SEC. 2. B\nlonger\n\nSEC. I. A", "sections 2, 1"), (["9"], text, outline.INCOMPLETE), (["ix"], "SEC. IX. D", "sections ix"), (["1", "3"], text, outline.INCOMPLETE), ([], text, outline.FULL), (None, text, outline.FULL)]
    df = spark.createDataFrame([(i, text, w) for i, (w, _, _) in enumerate(cases)], "id int, text string, wanted array<string>")
    got = {r.id: (r.selected, r.label) for r in outline.select_sections(df, "text", "wanted").collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}
    more = outline.select_sections(df.where("id = 2"), "text", "wanted", romans=20).first()
    assert more.selected == "SEC. IX. D"
    none = outline.select_sections(spark.createDataFrame([(None, ["1"])], "text string, wanted array<string>"), "text", "wanted").first()
    assert (none.selected, none.label) == ("", outline.INCOMPLETE)


def test_romans(spark):
    from pyspark.sql import functions as F

    got = [r.r for r in spark.range(0, 4001).select(outline.roman(F.col("id").cast("string")).alias("r")).collect()]
    assert got[1:4000] == [outline._as_roman(n) for n in range(1, 4000)] and got[0] is None and got[4000] is None
    assert all(outline._roman_value(outline._as_roman(n)) == n for n in range(1, 4000)) and outline._roman_value("IIX") is None


def tree(marks):
    return [(m, k, d, p) for _, m, k, d, p, _ in outline.outline([f"({m}) x" if m else "x" for m in marks])]


def test_enumerators_by_their_neighbours():
    assert tree(["h", "i", "j"]) == [("h", "a", 1, None), ("i", "a", 1, None), ("j", "a", 1, None)]
    assert tree(["h", "i", "ii", "i"])[1:] == [("i", "i", 2, 0), ("ii", "i", 2, 0), ("i", "a", 1, None)]
    assert [x[2] for x in tree(["a", "1", "A", "i", "ii", "iii", "iv", "v", "I", "II", "B", "2", "b"])] == [1, 2, 3, 4, 4, 4, 4, 4, 5, 5, 3, 2, 1]
    assert tree([None, "a", None, "1", None]) == [(None, None, 0, None), ("a", "a", 1, None), (None, None, 2, 1), ("1", "1", 2, 1), (None, None, 3, 3)]
    assert [k for _, k, _, _ in tree(["i", "ii"])] == ["i", "i"] and [k for _, k, _, _ in tree(["c", "d", "e"])] == ["a", "a", "a"]
    assert tree([]) == []


def test_random_outlines_are_read_back():
    draw = random.Random(8)
    styles = [lambda n: chr(96 + n), str, lambda n: chr(64 + n), lambda n: outline._as_roman(n).lower(), lambda n: outline._as_roman(n)]

    def make(depth, parent, rows):
        for n in range(1, draw.randrange(2, 6)):
            me = len(rows)
            rows.append((styles[depth](n), depth + 1, parent))
            if depth < 4 and draw.random() < 0.5:
                make(depth + 1, me, rows)

    for _ in range(300):
        rows = []
        make(0, None, rows)
        assert [(m, d, p) for m, _, d, p in tree([m for m, _, _ in rows])] == rows


def test_texts_of_one_file_are_dealt_out(spark, monkeypatch):
    from statuta.operators import outline

    docs = spark.range(500).selectExpr("id", "'(a) one\n\n(b) two' as text").coalesce(1)
    monkeypatch.setattr(outline, "SLICE_ROWS", 7)
    rows = outline.subsections(docs, "id", "text")
    # Before, one task parsed all texts of one small file.
    assert "RepartitionByExpression" in rows._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.id, r.n, r.mark, r.text) for r in rows.collect()) == [(i, n, "ab"[n], ["one", "two"][n]) for i in range(500) for n in (0, 1)]
