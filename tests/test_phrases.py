"""Phrase catalogues against str.count."""

import random

from statuta.operators import phrases


def plain(text, rules):
    low = (text or "").lower()
    hit = {}
    for i, (name, category, rank, phrase, weight, most) in enumerate(rules):
        if phrase and phrase in low:
            hit.setdefault((name, category, rank), []).append((i, min(most, weight * low.count(phrase)), phrase))
    return sorted((*k, sum(s for _, s, _ in v), len(v), tuple(p for _, _, p in v)) for k, v in hit.items())


def rows(df, key="id"):
    return {r[key]: sorted((f["list"], f["category"], f["rank"], f["score"], f["n"], tuple(f["phrases"])) for f in r["found"]) for r in df.collect()}


def test_counts_equal_str_count_in_one_block_and_in_many(spark):
    draw = random.Random(1)
    word = lambda k: "".join(draw.choice("abéß ") for _ in range(k))
    texts = [(i, word(draw.randrange(0, 300))) for i in range(60)] + [(60, None), (61, ""), (62, "aaaa" * 9), (None, "ab ab"), (63, "AB aB")]
    table = list(dict.fromkeys((draw.choice("xyz"), draw.choice("pq"), draw.randrange(2), word(draw.randrange(1, 5)), draw.randrange(1, 4), draw.randrange(1, 9)) for _ in range(150)))
    docs, rules = spark.createDataFrame(texts, "id long, text string").repartition(3), spark.createDataFrame(table, phrases.RULES).coalesce(1)
    want = {i: plain(t, table) for i, t in texts}
    assert rows(phrases.found(docs, rules, ["id"])) == want
    many = rows(phrases.found(docs, rules, ["id"], block=20))
    assert {k: [x[:5] for x in v] for k, v in many.items()} == {k: [x[:5] for x in v] for k, v in want.items()}


def test_a_catalogue_of_50_000_phrases(spark):
    table = [("parts", f"c{i % 90}", i % 90, f"item {i:05d}", 2, 5) for i in range(50_000)]
    docs = spark.createDataFrame([(i, f"an item {i * 7:05d}, an Item {i * 7:05d}; item {49_999 - i:05d} and item 99999") for i in range(300)], "id long, text string").repartition(4)
    got = rows(phrases.found(docs, spark.createDataFrame(table, phrases.RULES), ["id"]))
    assert all(got[i] == plain(f"item {i * 7:05d} item {i * 7:05d} item {49_999 - i:05d}", [table[k] for k in sorted({i * 7, 49_999 - i})]) for i in range(300))


def test_configurations_and_readers(spark):
    config = spark.createDataFrame([('{"banking": {"titles": [12, 31], "defaults": ["1"], "keywords": ["bank"]}, "sea": {"keywords": ["Coast Guard"], "non_code": true}, "none": {}}',), ("no object",), (None,)], "text string")
    subjects = phrases.subject_rules(config)
    assert [(r.subject, r["rank"], list(r.titles), list(r.keywords), r.non_code) for r in subjects.collect()] == [("banking", 0, [12, 31], ["bank"], False), ("sea", 1, [], ["Coast Guard"], True), ("none", 2, [], [], False)]
    docs = spark.createDataFrame([(1, "A title on the coast guard", "bank " * 9), (2, "", "")], "id long, title string, text string")
    assert [tuple(r) for r in phrases.subjects(docs, phrases.subject_phrases(subjects), "id", "text", "title").orderBy("rank").collect()] == [(1, "banking", 12, 1), (1, "sea", 5, 2)]
    categories = phrases.category_phrases(spark.createDataFrame([('{"b": ["two", "one"], "a": ["one"]}',)], "text string"), "kind")
    found = phrases.found(docs.selectExpr("id", "'one two two' as text"), categories, ["id"]).where("id = 1").select(phrases.first("kind").alias("f"), phrases.of_list("kind").alias("s")).first()
    assert (found.f.category, found.f.evidence, found.s) == ("b", "two, one", 15)


def test_no_rules_and_no_documents(spark):
    docs, none = spark.createDataFrame([(1, "x")], "id long, text string"), spark.createDataFrame([], phrases.RULES)
    assert rows(phrases.found(docs, none, ["id"])) == {1: []}
    assert phrases.found(docs.where("id > 1"), phrases.built_in(spark), ["id"]).count() == 0


def test_texts_do_not_come_back_from_the_pass(spark):
    acts = [(1, "There is appropriated $ 5 for a continuing resolution."), (2, "A continuing resolution."), (3, None), (4, "A commemorative coin and a Congressional Gold Medal.")]
    docs = spark.createDataFrame(acts, "law_id int, text string")
    out = phrases.characters(docs, phrases.built_in(spark), ["law_id"])
    line = next(x for x in out._jdf.queryExecution().executedPlan().toString().split("\n") if "MapInArrow" in x)
    assert "text#" not in line.rsplit("[", 1)[1]
    category = {r.law_id: r.category for r in out.collect()}
    assert category[1] == "appropriation" and category[2] != "appropriation" and category[3] == ""
