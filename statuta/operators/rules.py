"""Rule tables (data, not code) and weighted phrase scoring."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Phrase, weight.
PERMANENT = [
    ("shall", 1), ("may not", 3), ("is prohibited", 4), ("is established", 4), ("there is established", 5), ("shall have authority", 4),
    ("offense", 2), ("penalty", 2), ("judicial review", 3), ("cause of action", 4), ("shall appoint", 2),
]
TEMPORARY = [
    ("expires", 5), ("sunset", 5), ("fiscal year", 3), ("for a period of", 2), ("days after enactment", 2), ("temporary", 3), ("emergency period", 3), ("until the date", 2),
]
RIDER = [
    "is established", "there is established", "may not", "is prohibited", "judicial review", "cause of action", "shall have authority",
    "united states code", "is amended", "shall promulgate regulations",
]
RESIDUAL = [
    "effective date", "definitions", "severability", "rule of construction", "applicability", "transition", "implementation",
    "authorization of appropriations", "report to congress", "regulations", "short title",
]
#: Category and its phrases, in order of precedence.
NON_CODE = [
    ("constitutional", ["constitutional amendment", "amendment to the constitution", "proposal to amend the constitution"]),
    ("appropriation", ["appropriation for fiscal year", "supplemental appropriation", "continuing resolution", "shall remain available until expended", "appropriates $", "appropriated, out of"]),
    ("commemorative", ["congressional gold medal", "commemorative coin", "commemorative", "honorary designation", "posthumous award", "commendation", "national day of", "national week of", "national month of"]),
    ("appointment", ["confirmation of", "nomination of", "resolution confirming", "consent to the appointment of"]),
    ("treaty", ["ratification of the treaty", "resolution of ratification", "consent to ratification"]),
    ("private", ["for the relief of", "private law", "individual relief"]),
    ("internal_congress", ["rules of the house", "rules of the senate", "sense of congress only", "adjournment resolution"]),
    ("one_time", ["one-time payment", "single payment", "for this event only", "authorization for the specific operation"]),
]
MONEY = re.compile(r"\$\s*\d", re.ASCII)
#: Status words, the status each gives, and words of a law in force.
NEGATIVE_STATUS = [
    ("repealed", "repealed"), ("rescinded", "rescinded"), ("expired", "expired"), ("failed", "failed"), ("vetoed", "failed"), ("rejected", "failed"),
    ("withdrawn", "withdrawn"), ("superseded", "superseded"), ("invalid", "invalid"), ("void", "invalid"), ("denied", "failed"),
]
STATUS_RANK = [("active", 8), ("unknown", 7), ("expired", 4), ("superseded", 3), ("repealed", 2), ("rescinded", 2), ("withdrawn", 1), ("failed", 0), ("invalid", 0)]
#: Words of an attachment's name or address, and their points.
ATTACHMENT_POINTS = [
    ("enrolled", 20), ("signed", 18), ("public law", 18), ("final", 12), ("act", 5), ("bill", 3), ("document", 2), ("revised", 3),
    ("draft", -12), ("old", -8), ("veto", -8), ("amendment", -2), ("image", -15),
]
TEXT_EXTENSIONS = r"\.(txt|md|html?|rtf|docx|odt|pdf)$"
MEDIA_EXTENSIONS = r"\.(png|jpe?g|gif|webp|svg|mp4|mov|mp3|zip)$"


def weighted(text: Column, phrases: list[tuple[str, int]], cap: int = 20) -> Column:
    """Sum over phrases of the capped count times weight. text: in lower case."""
    return reduce(lambda a, b: a + b, [F.least(F.lit(cap), T.count_text(text, F.lit(p)) * w) for p, w in phrases])


def present(text: Column, phrases: list[str]) -> Column:
    """How many of the phrases occur."""
    return reduce(lambda a, b: a + b, [text.contains(p).cast("int") for p in phrases])


def points(text: Column, terms: list[tuple[str, int]]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(text.contains(t), w).otherwise(0) for t, w in terms])


def character_scores(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds permanent_score, temporary_score and non_code_score."""
    every = [p for _, phrases in NON_CODE for p in phrases]
    scores = T.bound(F.lower(text_col), lambda low: F.struct(weighted(low, PERMANENT).alias("permanent"), weighted(low, TEMPORARY).alias("temporary"), (present(low, every) * 5).alias("non_code")))
    scored = docs.withColumn("_scores", scores)
    return scored.select(*docs.columns, *[F.col(f"_scores.{x}").alias(f"{x}_score") for x in ("permanent", "temporary", "non_code")])


def non_code_category(text_col: str | Column = "text") -> Column:
    """The first category any of whose phrases occurs; an appropriation also needs money or a fiscal year."""

    def first(low: Column) -> Column:
        money = low.rlike(r"\$\s*\d") | low.contains("fiscal year") | low.contains("appropriated, out of")
        out = F.lit("")
        for category, phrases in reversed(NON_CODE):
            hit = reduce(lambda a, b: a | b, [low.contains(p) for p in phrases])
            out = F.when(hit & money if category == "appropriation" else hit, category).otherwise(out)
        return out

    return T.bound(F.lower(text_col), first)


def permanent_rider(text_col: str = "text") -> Column:
    return T.bound(F.lower(text_col), lambda low: present(low, RIDER) >= 2)


def needs_supplement(text: Column, operations: Column, represented: Column) -> Column:
    """Whether an enactment says more than its parsed operations: a residual marker, more sections than
    operations, or much more text."""
    return says_more(present(F.lower(text), RESIDUAL) > 0, numbered_sections(text), F.length(text), operations, represented)


def numbered_sections(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?im)^\s*(?:SEC(?:TION)?\.?)\s+[0-9]+[A-Za-z]?\s*[.:—-]"))


def says_more(residual: Column, sections: Column, length: Column, operations: Column, represented: Column) -> Column:
    """needs_supplement by what it takes from the text."""
    return residual | (sections > F.greatest(F.lit(1), operations)) | (length > F.greatest(F.lit(3500), represented + 1500))


# The same rules on one text in lower case, for a pass that asks for many phrases of each text.
def weight_of(low: str, phrases: list[tuple[str, int]], cap: int = 20) -> int:
    return sum(min(cap, low.count(p) * w) for p, w in phrases if p in low)


def how_many(low: str, phrases: list[str]) -> int:
    return sum(p in low for p in phrases)


def category_of(low: str) -> str:
    for category, phrases in NON_CODE:
        for p in phrases:
            if p in low and (category != "appropriation" or "fiscal year" in low or "appropriated, out of" in low or MONEY.search(low)):
                return category
    return ""


def status(list_name: Column, labels: Column, name: Column, description: Column) -> Column:
    """A card's status: by list or label, by a marked word of the name, by a `status:` line near the top of
    the description, else active."""
    metadata = F.lower(F.concat_ws(" | ", list_name, labels))
    head = F.lower(F.array_join(F.slice(F.split(description, "\n"), 1, 8), "\n"))
    marked = F.lower(name)

    def first(c: Column) -> Column:
        branches = [(c["metadata"].contains(t), s) for t, s in NEGATIVE_STATUS]
        branches += [(c["marked"].contains(t) & c["marked"].rlike(rf"(?:^|[\[(|:—-]\s*)(?:status\s*[:=-]\s*)?{t}(?:\s*[\])|:—-]|$)"), s) for t, s in NEGATIVE_STATUS]
        branches += [(c["head"].contains(t) & c["head"].rlike(rf"(^|[^a-z0-9_])status\s*[:=-]\s*{t}($|[^a-z0-9_])"), s) for t, s in NEGATIVE_STATUS]
        out = F.lit("active")
        for condition, s in reversed(branches):
            out = F.when(condition, s).otherwise(out)
        return out

    return T.bound(F.struct(metadata.alias("metadata"), marked.alias("marked"), head.alias("head")), first)


def status_rank(c: Column) -> Column:
    out = F.lit(5)
    for s, rank in reversed(STATUS_RANK):
        out = F.when(c == s, rank).otherwise(out)
    return out


def attachment_points(name: Column, url: Column, source: Column) -> Column:
    value = F.lower(F.concat_ws(" ", name, url))
    path = F.lower(F.regexp_replace(url, "[?#].*$", ""))
    return (
        points(value, ATTACHMENT_POINTS) + F.when(path.rlike(TEXT_EXTENSIONS), 8).otherwise(0) - F.when(path.rlike(MEDIA_EXTENSIONS), 30).otherwise(0)
        + F.when(value.contains("docs.google.com/document") | value.contains("drive.google.com/file"), 10).otherwise(0) + F.when(source == "board", 2).otherwise(0)
    )
