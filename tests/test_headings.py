"""The bounded search against scoring every section, and the branches of the cascade."""

import random
from collections import Counter

from statuta.functions.text import STOP_WORDS
from statuta.operators import headings

import re


def tokens(text):
    return [w for w in re.findall(r"[a-z][a-z0-9'-]{2,}", text.lower()) if w not in STOP_WORDS]


def plain(query, sections, defaults):
    best = None
    asked = Counter(tokens(query))
    for ord, section, heading, reserved in sorted(sections):
        if reserved:
            continue
        counts = Counter(tokens(heading))
        score = 12 * sum(min(asked[t], n) for t, n in counts.items()) + sum(min(5, len(t) / 2) for t in counts if t in asked)
        score += 20 * bool(heading and (heading.lower() in query.lower() or query.lower() in heading.lower())) + 3 * (section in defaults)
        if best is None or score > best[0]:
            best = (score, section)
    if best:
        return best[1], best[0]
    known = [s for _, s, _, _ in sorted(sections)]
    return next((d for d in defaults if d in known), known[0]), None


def data(seed=2):
    draw = random.Random(seed)
    words = ["the", "shall", "list", "lists", "agency", "Agency", "record", "rule-making", "tax", "ox", "banks", "a", "coast", "guard", "makers", "seller's", *[f"word{i}" for i in range(40)]]
    some = lambda n: " ".join(draw.choices(words, k=n))
    sections = [(t, f"s{i}", i, some(draw.randrange(0, 7)), draw.random() < 0.1 or t == 4) for t in (1, 2, 3, 4) for i in range(60)] + [(5, "only", 1, None, False)]
    queries = [(i, draw.choice([1, 2, 3, 4, 5, 9]), draw.choice([some(draw.randrange(0, 30)), draw.choice(sections)[3], "ox", ""]), draw.choice([None, [], ["s7", "s3"], ["nowhere", "s5"]])) for i in range(150)]
    return queries, sections


def test_search_equals_scoring_all(spark):
    queries, sections = data()
    q = spark.createDataFrame(queries, "query_id int, title int, query string, defaults array<string>").repartition(3)
    s = spark.createDataFrame(sections, "title int, section string, ord int, heading string, reserved boolean").repartition(2)
    want = {i: plain(text or "", [(o, name, h or "", r) for t, name, o, h, r in sections if t == title], d or []) for i, title, text, d in queries if title != 9}
    for block in (10_000, 50):
        got = headings.best_sections(q, s, block=block).collect()
        assert {r.query_id: (r.section, r.score) for r in got} == want
        assert all(r.candidates <= 60 for r in got)


def test_the_search_stops_early(spark):
    sections = [(1, f"s{i}", i, f"common words number{i}", False) for i in range(500)]
    s = spark.createDataFrame(sections, "title int, section string, ord int, heading string, reserved boolean")
    q = spark.createDataFrame([(1, 1, "common words number7 and number7")], "query_id int, title int, query string")
    r = headings.best_sections(q, s).first()
    assert (r.section, r.candidates) == ("s7", 2)


def test_branches_of_the_cascade(spark):
    sections = spark.createDataFrame([(1, "1", 1, "Words denoting number", False), (1, "2", 2, "Oath of office", False), (12, "9", 1, "Banks", False), (31, "7", 1, "Coins", True)], "title int, section string, ord int, heading string, reserved boolean")
    laws = spark.createDataFrame([(1, "a", "x"), (2, None, "a bank"), (3, "an oath", None), (4, "b", "of the mint"), (5, "c", "secret")], "law_id int, name string, text string")
    cited = spark.createDataFrame([(1, 12, "9", 0), (1, 1, "2", 1), (1, 1, "2", 2), (2, 5, "5", 0)], "law_id int, title int, section string, ord int")
    subjects = spark.createDataFrame([(2, "banking", 5), (2, "mint", 5), (4, "mint", 3), (5, "secret", 9)], "law_id int, subject string, score int")
    rules = spark.createDataFrame([("banking", 0, [99, 12], ["9"], False), ("mint", 1, [31], ["7"], False), ("secret", 2, [12], [], True)], "subject string, rank int, titles array<int>, defaults array<string>, non_code boolean")
    got = {r.law_id: (r.title, r.section, r.branch, r.cited, r.subject) for r in headings.anchors(laws, cited, sections, subjects, rules).collect()}
    assert got == {1: (1, "2", "cited", 2, None), 2: (12, "9", "subject", 0, "banking"), 3: (1, "2", "general", 0, None), 4: (31, "7", "subject", 0, "mint"), 5: (1, "1", "general", 0, None)}
    without = headings.anchors(laws.where("law_id = 3"), cited, sections.where("title > 1"), subjects, rules).first()
    assert (without.title, without.section, without.branch) == (12, "9", "first")


def test_sections_of_one_heading_are_shipped_once(spark):
    # 3,000 sections with two headings, all asked for by the last one's text: before, each copy was a candidate.
    sections = [(1, f"s{i}", i, "common words" if i % 2 else "other lists", False) for i in range(3000)]
    s = spark.createDataFrame(sections, "title int, section string, ord int, heading string, reserved boolean")
    q = spark.createDataFrame([(1, 1, "common words", None), (2, 1, "words", None), (3, 1, "on other lists", ["s100", "s5"])], "query_id int, title int, query string, defaults array<string>")
    got = {r.query_id: (r.section, r.score, r.candidates) for r in headings.best_sections(q, s).collect()}
    assert {i: g[0] for i, g in got.items()} == {1: "s1", 2: "s1", 3: "s100"} and max(g[2] for g in got.values()) <= 4
    assert {i: g[1] for i, g in got.items()} == {i: plain(t, [(o, n, h, r) for _, n, o, h, r in sections], d)[1] for i, t, d in [(1, "common words", []), (2, "words", []), (3, "on other lists", ["s100", "s5"])]}
