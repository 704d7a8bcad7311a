"""The source of each law: candidates from descriptions and attachments, scored, and the best usable one selected.

All of it is expressions over a candidate's row; the choice is one aggregation by law whose state is one candidate, so a law with many long
candidates is never gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Phrases of an enactment and their points, in order, and terms of a file's name and theirs.
PHRASES = [("be it enacted", 12), ("section 1", 4), ("short title", 4), ("effective date", 3), ("united states code", 4)]
NAME_TERMS = [("enrolled", 8), ("signed", 8), ("final", 5), ("draft", -8), ("old", -5), ("veto", -8)]
SIGNALS = [" shall ", " may not ", " is established", " there is established"]
NUMBER, TITLE = "public-law number", "law title"
FEW_WORDS, LOGIN, VARIETY = "few title words found in source", "download appears to be an access or login page", "source has very little lexical variety"
NO_SOURCE = "No readable, plausibly matching enactment source was recovered."
SECTION_LINE = r"(?im)^\s*(?:SEC(?:TION)?\.?)\s+\d+[A-Za-z]?\s*[.\-—:]"
#: What a description costs against an attachment, and the least length of a candidate.
DESCRIPTION_COST, SHORTEST = 3, 120


def scored(candidates: DataFrame) -> DataFrame:
    """candidates with characters, score, matches and warnings. candidates: (congress, number, title, text, name, file)."""
    low, none = F.col("_low"), F.lit(None).cast("string")
    rows = candidates.withColumns({"_low": F.lower(F.coalesce("text", F.lit(""))), "_name": F.lower(F.concat_ws(" ", "name", "file"))})
    tokens = F.filter(T.tokenize(F.coalesce("title", F.lit(""))), lambda t: F.length(t) >= 4)
    rows = rows.withColumn("_tokens", tokens)
    number = F.concat(F.col("congress").cast("string"), F.lit("-"), F.col("number").cast("string"))
    dashed = F.replace(number, F.lit("-"), F.lit("–"))
    numbered = F.coalesce(reduce(lambda a, b: a | b, [low.contains(F.concat(F.lit(p), n)) for p, n in (("public law ", number), ("public law ", dashed), ("pub. l. ", number), ("pl ", number))]), F.lit(False))
    # Of a title's words each occurrence counts above the line, each different one below it.
    ratio = F.try_divide(F.size(F.filter("_tokens", lambda t: low.contains(t))).cast("double"), F.size(F.array_distinct("_tokens")))
    rows = rows.withColumns({
        "_numbered": numbered, "_ratio": ratio, "_login": low.contains("access denied") | F.left(low, F.lit(1000)).contains("sign in") | F.left(low, F.lit(1000)).contains("javascript is disabled"),
        "_poor": F.size(F.array_distinct(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"\s+"), ""))) < 20, "characters": F.length(F.coalesce("text", F.lit(""))).cast("long"),
    })
    yes = lambda c, points: F.when(c, float(points)).otherwise(0.0)
    score = F.when(F.col("characters") >= 500, 10.0).when(F.col("characters") >= 180, 4.0).otherwise(-12.0) + yes(F.col("_numbered"), 25) + F.coalesce(F.col("_ratio") * 30, F.lit(0.0))
    score = reduce(lambda a, b: a + b, [score, *[yes(low.contains(p), n) for p, n in PHRASES], *[yes(F.col("_name").contains(t), n) for t, n in NAME_TERMS], yes(F.col("_login"), -60), yes(F.col("_poor"), -20)])
    matches = F.array_compact(F.array(F.when(F.col("_numbered"), NUMBER), F.when(F.col("_ratio") >= 0.5, TITLE), *[F.when(low.contains(p), p) for p, _ in PHRASES]))
    warnings = F.array_compact(F.array(F.when(F.col("_ratio") < 0.2, FEW_WORDS), F.when(F.col("_login"), LOGIN), F.when(F.col("_poor"), VARIETY), none))
    return rows.withColumns({"score": score, "matches": matches, "warnings": warnings}).drop("_low", "_name", "_tokens", "_numbered", "_ratio", "_login", "_poor")


def looks_enacted() -> Column:
    """Whether a scored candidate is an enactment: score, identity, and the formula or two section headings."""
    return (F.col("score") >= 8) & (F.size("matches") > 0) & (F.lower("text").contains("be it enacted") | (F.regexp_count("text", F.lit(SECTION_LINE)) >= 2))


def usable() -> Column:
    """Whether a scored candidate may be a law's source. A description may be a synopsis, so it must be long and have the formula or two sections, or be
    short with the formula, the law's number and two statutory signals."""
    enacted = F.lower("text").contains("be it enacted")
    signals = reduce(lambda a, b: a + b, [T.count_text(F.lower("text"), F.lit(s)) for s in SIGNALS])
    short = (F.col("characters") >= SHORTEST) & enacted & (signals >= 2) & F.array_contains("matches", NUMBER)
    full = (F.col("characters") >= 500) & (enacted | (F.regexp_count("text", F.lit(SECTION_LINE)) >= 2))
    known = (F.col("characters") >= SHORTEST) & (F.col("score") >= 8) & ((F.size("matches") > 0) | (F.col("score") >= 45))
    return F.coalesce(known & (~F.col("is_description") | short | full), F.lit(False))


def pool(cards: DataFrame, duplicates: DataFrame, attachments: DataFrame) -> DataFrame:
    """The scored candidates of each law: its own description, those of duplicate cards and its attachments' texts. Descriptions of under 120 characters
    are none, and a description scores 3 less. cards: (law_id, congress, number, title, url, description), duplicates: (law_id, card_id, card_name,
    url, description), attachments: (law_id, name, file, url, text)."""
    law = cards.select("law_id", "congress", "number", "title")
    said = lambda c: T.normalize_whitespace(F.coalesce(c, F.lit("")))
    own = cards.select("law_id", said(F.col("description")).alias("text"), F.lit("card description").alias("name"), F.lit("card-description.txt").alias("file"), "url", F.lit("selected from canonical card description rather than attachment").alias("note"), F.lit(0).alias("place"))
    others = duplicates.select(
        "law_id", said(F.col("description")).alias("text"), F.concat(F.lit("duplicate card description: "), F.coalesce("card_name", "card_id")).alias("name"), F.lit("duplicate-card-description.txt").alias("file"), "url",
        F.concat(F.lit("selected from duplicate card "), "card_id").alias("note"), F.lit(1).alias("place"),
    )
    described = own.unionByName(others).where(F.length("text") >= SHORTEST).withColumn("is_description", F.lit(True))
    added = attachments.select("law_id", said(F.col("text")).alias("text"), F.coalesce("name", F.lit("")).alias("name"), "file", "url", F.lit(None).cast("string").alias("note"), F.lit(2).alias("place"), F.lit(False).alias("is_description"))
    rows = scored(described.unionByName(added).join(law, "law_id"))
    return rows.withColumns({"score": F.col("score") - F.when(F.col("is_description"), DESCRIPTION_COST).otherwise(0), "warnings": F.array_compact(F.array_append("warnings", F.col("note")))}).drop("note")


def select_source(cards: DataFrame, candidates: DataFrame, text: bool = True) -> DataFrame:
    """(law_id, selected_name, selected_url, source_sha256, characters, score, matches, warnings, error, candidate_count, looks_enacted, text) of every law: the usable
    candidate of the highest score, of equals the longest, then the first of description, duplicates and attachments by name and text. Laws without one
    have an error, as has a law without candidates. text: whether the texts go along; without them the choice moves their digests only."""
    fields = ["name", "url", "characters", "score", "matches", "warnings", "_sha", *(["text"] if text else [])]
    order = F.struct((-F.col("score")).alias("a"), (-F.col("characters")).alias("b"), "place", "name", F.col("_sha").alias("c"))
    rows = candidates.withColumns({"_usable": usable(), "_enacted": looks_enacted(), "_sha": F.sha2("text", 256)})
    best = rows.select("law_id", *fields, "place", "_usable", "_enacted").groupBy("law_id").agg(
        F.min_by(F.when(F.col("_usable"), F.struct(*fields, "_enacted")), F.when(F.col("_usable"), order)).alias("s"), F.count("*").alias("candidate_count")
    )
    rows = cards.select("law_id").join(best, "law_id", "left")
    none = F.array().cast("array<string>")
    return rows.select(
        "law_id", F.coalesce("s.name", F.lit("")).alias("selected_name"), F.coalesce("s.url", F.lit("")).alias("selected_url"), F.coalesce("s._sha", F.lit("")).alias("source_sha256"), F.coalesce("s.characters", F.lit(0)).alias("characters"),
        F.coalesce("s.score", F.lit(0.0)).alias("score"), F.coalesce("s.matches", none).alias("matches"), F.coalesce("s.warnings", none).alias("warnings"), F.when(F.col("s").isNull(), NO_SOURCE).otherwise("").alias("error"),
        F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"), F.coalesce("s._enacted", F.lit(False)).alias("looks_enacted"), *(["s.text"] if text else []),
    )


def source_register(laws: DataFrame, selected: DataFrame) -> DataFrame:
    """A row a law, with its title and status, lists joined with ` | `; a law that was not looked at has empty fields and no candidates. laws: (law_id, title, status)."""
    joined = laws.select("law_id", "title", "status").join(selected, "law_id", "left")
    text = lambda c: F.coalesce(c, F.lit(""))
    return joined.select(
        "law_id", "title", "status", *[text(c).alias(c) for c in ("selected_name", "selected_url", "source_sha256")], F.coalesce("characters", F.lit(0)).alias("characters"), F.coalesce("score", F.lit(0.0)).alias("score"),
        *[F.coalesce(F.array_join(c, " | "), F.lit("")).alias(c) for c in ("matches", "warnings")], text("error").alias("error"), F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"),
    )
