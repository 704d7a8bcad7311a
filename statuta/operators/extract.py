"""Text to rows: citations, references, edits, sections, lines and links.

Offsets need a matcher with positions, which Spark's regular expressions lack: `find_all` is the one
Arrow function for them. What needs no offsets stays in built-in expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import edits

#: The three ways to cite the Code, with the groups of title and section.
CITATIONS = [
    (r"(?i)sections?\s+([0-9A-Za-z][0-9A-Za-z.\-]*)\s+of\s+title\s+(\d{1,2})\s*,?\s*(?:of\s+the\s+)?United\s+States\s+Code", 2, 1),
    (r"(?i)(\d{1,2})\s+U\.?\s*S\.?\s*C\.?\s*(?:§+|sections?|secs?\.?|s\.)?\s*([0-9A-Za-z][0-9A-Za-z.\-]*)", 1, 2),
    (r"(?i)title\s+(\d{1,2})\s*,?\s*(?:United\s+States\s+Code|U\.?S\.?C\.?)\s*,?\s*section\s+([0-9A-Za-z][0-9A-Za-z.\-]*)", 1, 2),
]
#: Fixed values, strongest first: relation, confidence, characters before a law number and the wording that ends them,
#: characters after it and the wording that begins them.
RELATIONS = [
    ("repeals", "high", 180, r"(?:hereby\s+)?(?:repeals?|repealing|repeal\s+of)(?:\s+(?:all|the|titles?|sections?|provisions?|amendments?))*(?:\s+(?:of|made\s+by|contained\s+in))*\s*$",
     180, r"^\s*[,;]?\s*(?:and\s+)?(?:is|are|shall\s+be)\s+(?:hereby\s+)?repealed\b"),
    ("supersedes", "high", 120, r"(?:supersedes?|replaces?|replacement\s+for)\s*$", 160, r"^\s*[,;]?\s*(?:is|are)\s+(?:hereby\s+)?(?:superseded|replaced)\b"),
    ("amends", "medium", 120, r"(?:amends?|amending|amendment\s+to)\s*$", 160, r"^\s*[,;]?\s*(?:is|are)\s+(?:hereby\s+)?amended\b"),
    ("overrides", "medium", 160, r"notwithstanding(?:\s+any\s+provision\s+of)?\s*$", 0, None),
]
#: Names of operative wording.
OPERATIVE = [
    ("amends", r"is (hereby )?amended"), ("repeals", r"is (hereby )?repealed"), ("strikes", "striking"), ("inserts", "inserting"), ("restates", "to read as follows"),
    ("establishes", "there is established"), ("appropriates", "appropriated"), ("reports", "shall report"), ("prohibits", "may not|is prohibited"),
]


def citations(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, title, section) of every citation, distinct; sections end without punctuation."""
    parts = []
    for pattern, t, s in CITATIONS:
        both = F.arrays_zip(F.regexp_extract_all(text_col, F.lit(pattern), F.lit(t)).alias("t"), F.regexp_extract_all(text_col, F.lit(pattern), F.lit(s)).alias("s"))
        parts.append(both)
    rows = docs.select(id_col, F.explode(F.concat(*parts)).alias("c"))
    return rows.select(id_col, F.col("c.t").cast("int").alias("title"), F.rtrim(F.col("c.s"), F.lit(".,;:)")).alias("section")).distinct()


def find_all(docs: DataFrame, id_col: str, text_col: str, patterns: dict[str, str]) -> DataFrame:
    """(id, pattern, raw, groups, start, end) of every match of named Python patterns."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(name, re.compile(p)) for name, p in patterns.items()]
        for batch in batches:
            at, out = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for name, p in compiled:
                    for m in p.finditer(text or ""):
                        at.append(i)
                        out.append((name, m[0], [g or "" for g in m.groups()], m.start(), m.end()))
            if out:
                name, raw, groups, start, end = zip(*out, strict=True)
                yield pa.record_batch([batch.column(0).take(pa.array(at)), pa.array(name), pa.array(raw), pa.array(groups, pa.list_(pa.string())), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=[id_col, "pattern", "raw", "groups", "start", "end"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, pattern string, raw string, groups array<string>, start int, end int")


def dependencies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, target, relation, confidence, context): every other law that a text names, once for each relation. A
    relation needs its verb directly before or after the number; a verb elsewhere in the sentence says nothing."""
    found = edits.windows(docs, id_col, text_col, T.LAW_PATTERN, 260, 260, edits.LAW_STARTS)
    g = lambda k: F.get("groups", F.lit(k)).cast("int").cast("string")
    rows = found.select(id_col, "start", "raw", T.law_id(g(0), g(1)).alias("target"), T.normalize_whitespace(F.col("before")).alias("before"), T.normalize_whitespace(F.col("after")).alias("after"))
    context = F.left(T.normalize_whitespace(F.concat_ws(" ", "before", "raw", "after")), F.lit(700))
    known = rows.where(F.col(id_col) != F.col("target")).select(id_col, "start", "target", F.explode(F.array(relation(F.lower("before"), F.lower("after")))).alias("r"), context.alias("context"))
    first = known.groupBy(id_col, "target", F.col("r.relation").alias("relation"), F.col("r.confidence").alias("confidence")).agg(F.min_by("context", "start").alias("context"))
    return first.select(id_col, "target", "relation", "confidence", "context")


def relation(before: Column, after: Column) -> Column:
    """(relation, confidence) of the first relation whose wording touches the law number, in lower case."""
    named = lambda name, sure: F.struct(F.lit(name).alias("relation"), F.lit(sure).alias("confidence"))
    out = named("references", "low")
    for name, sure, n, ends, m, begins in reversed(RELATIONS):
        said = F.right(before, F.lit(n)).rlike(ends)
        out = F.when(said | F.left(after, F.lit(m)).rlike(begins) if begins else said, named(name, sure)).otherwise(out)
    return out


def strike_inserts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, old_text, new_text) of quoted edits, distinct; empty or over-long ones are skipped."""
    pair = F.arrays_zip(F.regexp_extract_all(text_col, F.lit(edits.STRIKE), F.lit(1)).alias("old"), F.regexp_extract_all(text_col, F.lit(edits.STRIKE), F.lit(2)).alias("new"))
    rows = docs.select(id_col, F.explode(pair).alias("p")).select(id_col, T.normalize_whitespace(F.col("p.old")).alias("old_text"), T.normalize_whitespace(F.col("p.new")).alias("new_text"))
    return rows.where("old_text <> '' and length(old_text) <= 4000 and length(new_text) <= 8000").distinct()


def operative_tags(text: Column) -> Column:
    """Sorted names of the operative wording present."""
    low = F.lower(text)
    return F.array_sort(F.array_compact(F.array(*[F.when(low.rlike(p), name) for name, p in OPERATIVE])))


def numbered_sections(docs: DataFrame, id_col: str, text_col: str, start: str = r"(?i)^\s*(?:SEC(?:TION)?\.?|§+)\s+[0-9A-Za-z]+") -> DataFrame:
    """(id, block, heading, text): lines that match `start` open a block that runs to the next one."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("n", "line"))
    w = Window.partitionBy(id_col).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    blocks = lines.withColumn("block", F.sum(F.col("line").rlike(start).cast("int")).over(w)).where("block > 0")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    return blocks.groupBy(id_col, "block").agg(F.min_by("line", "n").alias("heading"), said.alias("text"))


def line_filter(docs: DataFrame, id_col: str, text_col: str, *needs: str) -> DataFrame:
    """(id, n, line) of the lines that match every pattern."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("n", "line"))
    for p in needs:
        lines = lines.where(F.col("line").rlike(p))
    return lines.select(id_col, (F.col("n") + 1).alias("n"), F.trim("line").alias("line"))


def links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, n, href) of every link in page order."""
    return pages.select(id_col, F.posexplode(F.regexp_extract_all(html_col, F.lit('href="([^"]+)"'), F.lit(1))).alias("n", "href"))


def detected(docs: DataFrame, id_col: str, text_col: str, patterns: list[str]) -> DataFrame:
    """(id, refs): the distinct matches of any pattern, sorted, white space collapsed."""
    every = F.concat(*[F.regexp_extract_all(text_col, F.lit(p), F.lit(0)) for p in patterns])
    rows = docs.select(id_col, F.explode(F.transform(every, lambda x: F.regexp_replace(x, r"\s+", " "))).alias("ref"))
    return rows.groupBy(id_col).agg(F.array_join(F.array_sort(F.collect_set("ref")), ",").alias("refs"))
