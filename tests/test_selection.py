"""Sources of laws on rows made by hand."""

from statuta.operators import selection as S

CARD = "law_id string, congress int, number int, title string, url string, description string"
OTHER = "law_id string, card_id string, card_name string, url string, description string"
PAPER = "law_id string, name string, file string, url string, text string"
LONG = "Be it enacted. Public Law 3-4. " + " ".join(f"word{i}" for i in range(60)) + " The office shall act and shall report."


def chosen(spark, cards, others=(), papers=()):
    frames = [spark.createDataFrame(list(rows), schema) for rows, schema in ((cards, CARD), (others, OTHER), (papers, PAPER))]
    return {r.law_id: r for r in S.select_source(frames[0], S.pool(*frames)).collect()}


def test_the_best_usable_candidate_is_taken(spark):
    cards = [("A", 3, 4, "Harbour lights", "u", LONG), ("B", None, None, None, None, None), ("C", 1, 2, "Harbour lights", "u", "x" * 130), ("D", 3, 4, "Harbour lights", "u", "short")]
    papers = [("A", "Enrolled bill", "a.txt", "p", LONG + " Harbour lights."), ("A", "old draft", "b.txt", "q", LONG), ("D", None, None, None, None), ("D", "image", "i.png", "z", "sign in")]
    got = chosen(spark, cards, [("D", "d1", None, "w", LONG)], papers)
    assert (got["A"].selected_name, got["A"].candidate_count, got["A"].error) == ("Enrolled bill", 3, "") and S.TITLE in got["A"].matches
    assert (got["B"].error, got["B"].candidate_count, got["B"].score) == (S.NO_SOURCE, 0, 0.0) and got["C"].error == S.NO_SOURCE
    assert got["D"].selected_name == "duplicate card description: d1" and got["D"].warnings[-1] == "selected from duplicate card d1" and got["D"].looks_enacted


def test_a_short_description_needs_the_formula_the_number_and_two_signals(spark):
    short = "Be it enacted. Public Law 3-4: an officer shall keep and print the list, and each of the many makers shall send it one by the end of a month."
    assert chosen(spark, [("A", 3, 4, "", "u", short)])["A"].error == ""
    assert chosen(spark, [("A", 3, 5, "", "u", short)])["A"].error == S.NO_SOURCE
    assert chosen(spark, [("A", 3, 4, "", "u", short.replace(" shall send", " will send"))])["A"].error == S.NO_SOURCE


def test_no_laws(spark):
    assert chosen(spark, []) == {}


def test_texts_stay_behind_where_only_their_digest_is_asked_for(spark):
    said = "Be it enacted. Public Law 1-2. " + "An office shall keep lists of makers and of what they sell. " * 10
    cards = spark.createDataFrame([("PL-1", 1, 2, "Lists of makers", "u", said), ("PL-2", 1, 3, "Nothing", "u", None)], "law_id string, congress int, number int, title string, url string, description string")
    duplicates = spark.createDataFrame([], "law_id string, card_id string, card_name string, url string, description string")
    papers = spark.createDataFrame([("PL-1", "signed act", "a.txt", "v", said + "More.")], "law_id string, name string, file string, url string, text string")
    pool = S.pool(cards, duplicates, papers)
    whole, slim = S.select_source(cards, pool), S.select_source(cards, pool, text=False)
    assert sorted(map(repr, whole.drop("text").collect())) == sorted(map(repr, slim.collect()))
    assert {r.law_id: r.text for r in whole.collect()} == {"PL-1": said + "More.", "PL-2": None}
    lines = [x for x in slim._jdf.queryExecution().executedPlan().toString().split("\n") if "Aggregate" in x]
    assert lines and not any("text#" in x for x in lines)
