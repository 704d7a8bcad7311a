"""Edits that enactments order: new, restated, repealed and amended sections, and edges between laws.

`windows` finds citations with the text around them; everything after that is built-in expressions.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Wordings that name a section to edit, a chapter to add to, a section's first line, the start of
#: the next section of the enactment, and the ways to edit.
TARGET = (
    r"(?i)section\s+([0-9A-Za-z][0-9A-Za-z.\-]*)((?:\([A-Za-z0-9]+\))*)\s+of\s+title\s+(\d{1,2})\s*,?\s*(?:of\s+the\s+)?United\s+States\s+Code"
    r"|(\d{1,2})\s+U\.?\s*S\.?\s*C\.?\s*§+\s*([0-9A-Za-z][0-9A-Za-z.\-]*)((?:\([A-Za-z0-9]+\))*)"
)
CHAPTER = (
    r"(?is)chapter\s+([0-9A-Za-z.-]+)\s+of\s+title\s+(\d{1,2})\s*,?\s*(?:of\s+the\s+)?United\s+States\s+Code"
    r".{0,1200}?(?:adding|add)\s+(?:at\s+the\s+end\s+)?(?:the\s+following|a\s+new\s+section)"
)
FIRST_LINE = r"(?i)(?:§+\s*|SEC(?:TION)?\.?\s+)([0-9A-Za-z][0-9A-Za-z.-]*)\s*[.\-—:]\s*([^\n]{1,180})"
NEXT_SECTION = r"(?im)^\s*SEC(?:TION)?\.?\s+\d+[A-Za-z]?\s*[.\-—:]"
VERB = r"(?is)^[^.;]{0,300}?\b(?:is|are)\s+(?:hereby\s+)?(amended|repealed)\b"
PREFIX = r"(?is)^([^.;]{0,300}?)\b(?:is|are)\s+(?:hereby\s+)?(?:amended|repealed)\b"
PART_NAMED = r"(?i)^\s*\([A-Za-z0-9]+\)|\b(?:subsection|paragraph|subparagraph|clause|item)\b"
RESTATED = r"(?is)\b(?:to\s+read|by\s+striking\s+.*?and\s+inserting)\s+as\s+follows\s*[:—-]"
ADDED = r"(?is)\bby\s+(?:adding|inserting)\s+(?:at\s+the\s+end\s+)?(?:the\s+following|after\s+[^:]{1,300}\s+the\s+following)\s*[:—-]"
#: How a match of each pattern begins: a character out of a set comes first, which the search skips to.
TARGET_STARTS = (r"[sS\u017f](?i:ection)", r"\d\d?\s+[uU]")
#: What a text must hold for a match with the start of the same place; a literal comes first, so that the search is fast.
TARGET_NEEDS = (r"", r"§(?<=[cC.\s]§)")
CHAPTER_STARTS = (r"[cC](?i:hapter)",)
LAW_STARTS = (r"[pP](?i:ub|\.?l)",)
STRIKE = r'(?is)striking\s+["“](.*?)["”]\s+and\s+inserting\s+(?:in\s+lieu\s+thereof\s+)?["“](.*?)["”]'
#: Fixed value: characters of an added section that is no mere mention.
MIN_ADDED = 40
#: What targets may order.
KINDS = ("REPEAL_SECTION", "REPEAL_PART", "REPLACE_SECTION", "APPEND_TEXT", "STRIKE_INSERT")
#: Groups of verbs near a reference to another law.
EDGE_VERBS = {"amend": "amend", "delay": "delay|postpone|suspend", "extend": "extend|reauthoriz", "repeal": "repeal", "revive": "reviv|reinstat|restor", "supersede": "supersed"}

#: Windows of a batch are handed on when they come to so many characters.
SLICE_CHARS = 4_000_000


def matches(text: str, pattern: re.Pattern, starts: Sequence[re.Pattern], needs: Sequence[re.Pattern] = ()) -> Iterator[re.Match]:
    """What pattern.finditer gives, tried only where one of `starts` matches: every match, never an empty one, begins at such a place. Where a
    text doesn't hold what a start `needs`, that start is passed over."""
    if not starts:
        yield from pattern.finditer(text)
        return
    if needs:
        starts = [s for s, n in zip(starts, needs, strict=True) if n.search(text)]
    ahead = [s.search(text) for s in starts]
    while places := [m.start() for m in ahead if m]:
        found = pattern.match(text, min(places))
        if found:
            yield found
        at = found.end() if found else min(places) + 1
        ahead = [m if m is None or m.start() >= at else s.search(text, at) for m, s in zip(ahead, starts, strict=True)]


def windows(docs: DataFrame, id_col: str, text_col: str, pattern: str, before: int, after: int, starts: Sequence[str] = (), needs: Sequence[str] = ()) -> DataFrame:
    """(id, start, raw, groups, before, after) of every match, with so many characters on either side. starts, needs: see `matches`."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    names = [id_col, "start", "raw", "groups", "before", "after"]
    types = [pa.int32(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, firsts, held = re.compile(pattern), [re.compile(s) for s in starts], [re.compile(n) for n in needs]
        for batch in batches:
            at, rows, size = [], [], 0

            def made(at, rows, ids=batch.column(0)):
                return pa.record_batch([ids.take(pa.array(at)), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]], names=names)

            for i, said in enumerate(batch.column(1)):
                text = said.as_py() or ""
                for m in matches(text, compiled, firsts, held):
                    at.append(i)
                    rows.append((m.start(), m[0], [g or "" for g in m.groups()], text[max(0, m.start() - before) : m.start()], text[m.end() : m.end() + after]))
                    size += before + after
                    if size > SLICE_CHARS:
                        yield made(at, rows)
                        at, rows, size = [], [], 0
            if rows:
                yield made(at, rows)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, start int, raw string, groups array<string>, before string, after string")


def may_add(low: Column) -> Column:
    """Whether a text, given in lower case, may add sections to chapters."""
    return low.contains("chapter")


def may_target(low: Column) -> Column:
    """Whether a text, given in lower case, may name sections to edit. Python's patterns take other letters too for the rest of `section`."""
    return low.contains("ect") | low.contains("§")


def holding(docs: DataFrame, id_col: str, text_col: str, may: Callable[[Column], Column]) -> DataFrame:
    """(id, text) of the docs whose texts in lower case `may` hold what is looked for. As a column of a generator that isn't pushed below a distinct
    of the docs, of which all uses then share one shuffle; a plain filter gives each use its own."""
    return once(once(docs.select(id_col, text_col), low=F.lower(text_col)), may=may(F.col("low"))).where("may").select(id_col, text_col)


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once a row. Filters and projections that use an alias repeat its expression at every use, and those
    within it again, which multiplies regular expressions; they don't reach through the rows of a generator."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def until_next_section(text: Column, skip: int) -> Column:
    """The text up to the next section heading of the enactment after the first `skip` characters."""
    # The heading's own leading line breaks count to the match, so the cut falls before them.
    return F.concat(F.left(text, F.lit(skip)), F.get(F.split(F.substring(text, skip + 1, 2**31 - 1), NEXT_SECTION, 2), F.lit(0)))


def following(text: Column, pattern: str) -> Column:
    """What comes after the first match, without white space and then quotes around it; all of a text without a match."""
    parts = F.split(text, pattern, 2)
    return bare(F.element_at(parts, -1))


def bare(text: Column) -> Column:
    return F.btrim(F.btrim(text, F.lit(" \t\n\x0b\f\r")), F.lit('"“”'))


def with_sections(rows: DataFrame, sections: DataFrame) -> DataFrame:
    """Adds section_exists. sections: (title, section)."""
    return rows.join(sections.select("title", "section").distinct().withColumn("section_exists", F.lit(True)), ["title", "section"], "left").withColumn("section_exists", F.coalesce("section_exists", F.lit(False)))


def added_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, start, title, section, chapter, heading, block, n_chars) of every section that a text adds to a chapter."""
    found = windows(holding(docs, id_col, text_col, may_add), id_col, text_col, CHAPTER, 0, 12_000, CHAPTER_STARTS)
    found = once(once(found, window=bare(until_next_section(F.col("after"), 120))), at=F.regexp_instr("window", F.lit(FIRST_LINE)))
    cut = once(found.where("at > 0").drop("after"), block=F.expr("substring(window, at, 2147483647)"))
    return cut.select(
        id_col, "start", F.get("groups", F.lit(1)).cast("int").alias("title"), F.rtrim(F.regexp_extract("block", FIRST_LINE, 1), F.lit(".")).alias("section"),
        F.get("groups", F.lit(0)).alias("chapter"), F.btrim(F.regexp_extract("block", FIRST_LINE, 2), F.lit(" .—-")).alias("heading"), "block", F.length("block").cast("long").alias("n_chars"),
    )


def with_chapters(rows: DataFrame, chapters: DataFrame) -> DataFrame:
    """Adds chapter_exists. chapters: (title, chapter)."""
    known = rows.join(chapters.select("title", "chapter").distinct().withColumn("chapter_exists", F.lit(True)), ["title", "chapter"], "left")
    return known.withColumn("chapter_exists", F.coalesce("chapter_exists", F.lit(False)))


def new_sections(docs: DataFrame, id_col: str, text_col: str, chapters: DataFrame, sections: DataFrame) -> DataFrame:
    """(id, title, section, chapter, heading, block, n_chars, confidence): sections to be added to a chapter of the
    Code, the first of each (id, title, section). High where the chapter exists, the section doesn't and the
    block has 40 characters. A section number without the chapter's formula never counts."""
    rows = added_blocks(docs, id_col, text_col)
    # An aggregate for each column, so that blocks that nobody asks for aren't moved.
    columns = ("chapter", "heading", "block", "n_chars")
    first = rows.groupBy(id_col, "title", "section").agg(*[F.min_by(c, "start").alias(c) for c in columns])
    known = with_chapters(with_sections(first, sections), chapters)
    sure = F.col("chapter_exists") & ~F.col("section_exists") & (F.col("n_chars") >= MIN_ADDED)
    return known.select(id_col, "title", "section", *columns, F.when(sure, "high").otherwise("medium").alias("confidence"))


def targets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, start, title, section, verb, subdivision, window): citations that are followed, within their
    sentence, by an order to amend or repeal. subdivision: a part of the section is named, in the citation or
    between it and the verb."""
    found = windows(holding(docs, id_col, text_col, may_target), id_col, text_col, TARGET, 0, 10_000, TARGET_STARTS, TARGET_NEEDS)
    g = lambda k: F.get("groups", F.lit(k))
    cut = once(once(found, said=F.concat("raw", "after")).drop("after"), window=until_next_section(F.col("said"), 100)).drop("said")
    near = once(cut, near=F.expr("left(substring(window, length(raw) + 1), 700)"))
    told = once(near, verb=F.lower(F.regexp_extract("near", VERB, 1))).where("verb <> ''")
    part = (F.concat(g(1), g(5)) != "") | F.regexp_extract("near", PREFIX, 1).rlike(PART_NAMED)
    return told.select(
        id_col, "start", F.coalesce(F.nullif(g(2), F.lit("")), g(3)).cast("int").alias("title"), F.rtrim(F.concat(g(0), g(4)), F.lit(".,;:")).alias("section"),
        "verb", part.alias("subdivision"), "window",
    )


def ordered(docs: DataFrame, id_col: str, text_col: str, kinds: Sequence[str] = KINDS) -> DataFrame:
    """(id, start, kind, title, section, block, old_text, new_text, digest) of everything that targets order, repeated orders too. digest: of
    added texts, else empty; orders of one (id, kind, title, section, old_text, new_text, digest) are the same. For the rest see `operations`."""
    asked = lambda *names: any(n in kinds for n in names)
    verbs = [v for v, names in (("repealed", ("REPEAL_SECTION", "REPEAL_PART")), ("amended", ("REPLACE_SECTION", "APPEND_TEXT", "STRIKE_INSERT"))) if asked(*names)]
    rows = targets(docs, id_col, text_col).where(F.col("verb").isin(verbs))
    whole = ~F.col("subdivision")
    amended = F.col("verb") == "amended"
    kind = F.when(~amended, F.when(whole, "REPEAL_SECTION").otherwise("REPEAL_PART"))
    if asked("REPLACE_SECTION", "APPEND_TEXT"):
        kind = kind.when(whole & F.lower("window").contains("follows") & F.col("window").rlike(RESTATED), "REPLACE_SECTION")
    if asked("APPEND_TEXT"):
        kind = kind.when(F.lower("window").contains("following") & F.col("window").rlike(ADDED), "APPEND_TEXT")
    rows = once(rows, kind=kind)
    if not asked("STRIKE_INSERT"):
        rows = rows.where(F.col("kind").isin(list(kinds)))
    block = F.when(F.col("kind") == "REPLACE_SECTION", following(F.col("window"), RESTATED)).when(F.col("kind") == "APPEND_TEXT", following(F.col("window"), ADDED)).when(F.col("kind") == "REPEAL_PART", F.trim("window")).otherwise("")
    rows = once(rows, block=block)
    # What a target orders as a whole and its quoted edits are rows of one pass over the texts.
    none = F.lit("")
    at_large = F.struct("kind", "block", none.alias("old_text"), none.alias("new_text"))
    plain = T.normalize_whitespace
    edit = lambda p: F.struct(F.lit("STRIKE_INSERT").alias("kind"), none.alias("block"), plain(p["old"]).alias("old_text"), plain(p["new"]).alias("new_text"))
    every = F.concat(F.array(at_large), F.transform(quoted(), edit)) if asked("STRIKE_INSERT") else F.array(at_large)
    said = rows.select(id_col, "start", "title", "section", F.inline(every)).where(F.col("kind").isin(list(kinds)))
    said = said.where("case kind when 'STRIKE_INSERT' then old_text <> '' and length(old_text) <= 4000 and length(new_text) <= 8000 when 'REPEAL_SECTION' then true else block <> '' end")
    return said.withColumn("digest", F.when(F.col("kind") == "APPEND_TEXT", F.left(F.sha2("block", 256), F.lit(16))).otherwise(""))


def settled() -> Column:
    """Whether an order is of high confidence if its section exists: repeals, edits, and restatements that begin with the section's number."""
    named = F.rtrim(F.regexp_extract(F.left("block", F.lit(700)), FIRST_LINE, 1), F.lit(".")) == F.col("section")
    return F.when(F.col("kind") == "REPLACE_SECTION", named & F.length("block").between(80, 30_000)).otherwise(F.col("kind").isin("REPEAL_SECTION", "STRIKE_INSERT"))


def operations(docs: DataFrame, id_col: str, text_col: str, sections: DataFrame, kinds: Sequence[str] = KINDS) -> DataFrame:
    """(id, kind, title, section, block, old_text, new_text, confidence) of what targets order. A repealed section is
    repealed whole only if no part is named; a restated one is replaced; text added to it, and a repealed part, become
    notes; each quoted pair of texts to strike and to insert is an edit of its own, also in a part. First of each (id,
    kind, title, section); of added texts and of edits, of each different one. Edits without an old text, or over 4,000
    characters of it or 8,000 of the new one, don't count. kinds: those that are asked for; work that only others need is left out."""
    said = ordered(docs, id_col, text_col, kinds)
    keys = [id_col, "kind", "title", "section", "old_text", "new_text", "digest"]
    # Sections are met only by what is left, not by all windows.
    first = with_sections(said.groupBy(*keys).agg(F.min_by("block", "start").alias("block")), sections)
    sure = F.col("section_exists") & settled()
    return first.select(id_col, "kind", "title", "section", "block", "old_text", "new_text", F.when(sure, "high").otherwise("medium").alias("confidence"))


def quoted() -> Column:
    """The quoted pairs (old, new) that a target's window strikes and inserts."""
    groups = [F.regexp_extract_all("window", F.lit(STRIKE), F.lit(k)) for k in (1, 2)]
    pairs = F.arrays_zip(groups[0].alias("old"), groups[1].alias("new"))
    return F.when((F.col("verb") == "amended") & F.lower("window").contains("striking"), pairs).otherwise(F.array().cast("array<struct<old:string,new:string>>"))


def chronology(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, target, verbs, context): each reference to another law, with the verb groups within 200 characters
    of its start and 90 characters of context. Repeated references stay."""
    found = windows(docs, id_col, text_col, T.LAW_PATTERN, 200, 200, LAW_STARTS)
    g = lambda k: F.get("groups", F.lit(k)).cast("int").cast("string")
    found = once(found.withColumn("ahead", F.concat("raw", "after")), near=F.lower(F.concat(F.col("before"), F.left("ahead", F.lit(200)))))
    near, ahead = F.col("near"), F.col("ahead")
    said = lambda words: functools.reduce(operator.or_, [near.contains(w) for w in words.split("|")])
    verbs = F.concat_ws(",", *[F.when(said(words), name) for name, words in EDGE_VERBS.items()])
    # Single blanks stay as they are and are not replaced by themselves.
    context = F.trim(F.regexp_replace(F.concat(F.right("before", F.lit(90)), F.left(ahead, F.lit(90))), r"[\t-\r]\s*+| \s++", " "))
    return found.select(id_col, T.law_id(g(0), g(1)).alias("target"), verbs.alias("verbs"), context.alias("context")).where(F.col(id_col) != F.col("target"))
