"""The outline of enactments: numbered sections, selection of sections, and subsections by their enumerators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The two forms of a section's first line; group 1 is its number, group 2 its heading.
WORDED = r"(?i)^[ \t]*SEC(?:TION)?\.?[ \t]*(\d+[A-Za-z]?|[IVXLCDM]+)[ \t]*(?:[.\-—:)]|\z)[ \t]*([^\n]*)\z"
SIGNED = r"^[ \t]*§[ \t]*(\d+[A-Za-z]?)[ \t]*(?:[.\-—:)]|\z)[ \t]*([^\n]*)\z"
#: What a selection is called.
FULL = "full enacted text"
INCOMPLETE = "full enacted text (section-heading OCR prevented a complete subsection extraction)"
_ROMAN = [("M", 1000), ("D", 500), ("C", 100), ("L", 50), ("X", 10), ("V", 5), ("I", 1)]


def roman(number: Column) -> Column:
    """The roman numeral of 1 to 3999; null for others."""
    n = number.try_cast("int")
    digits = {1: ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"], 10: ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"], 100: ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"], 1000: ["", "M", "MM", "MMM"]}
    at = lambda unit: F.get(F.array(*[F.lit(x) for x in digits[unit]]), (F.floor(n / unit) % 10).cast("int"))
    return F.when(n.between(1, 3999), F.concat(at(1000), at(100), at(10), at(1)))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _blocks(text: Column) -> Column:
    """array<struct<number, heading, block>> of a text, in order: a first line to before the next one. Lines ahead of the first are in none."""
    first = lambda line: line.rlike(WORDED) | line.rlike(SIGNED)
    group = lambda line, k: F.coalesce(F.nullif(F.regexp_extract(line, WORDED, k), F.lit("")), F.regexp_extract(line, SIGNED, k))

    def of(lines: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: first(F.get(lines, i)))
        ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(lines)))
        return F.zip_with(starts, F.slice(ends, 1, F.size(starts)), lambda a, b: F.struct(
            F.upper(group(F.get(lines, a), 1)).alias("number"), F.trim(group(F.get(lines, a), 2)).alias("heading"), _strip(F.array_join(F.slice(lines, a + 1, b - a), "\n")).alias("block")))

    # The lines are bound once: a lambda's variable is not computed again.
    return F.get(F.transform(F.array(F.split(F.coalesce(text, F.lit("")), "\n")), of), F.lit(0))


def _longest(blocks: Column, number: Column) -> Column:
    """The longest block of a number, of equals the first; null if there is none."""
    ranked = F.transform(blocks, lambda b, i: F.struct(F.length(b["block"]).alias("size"), (-i).alias("early"), b["number"].alias("number"), b["block"].alias("block")))
    return F.array_max(F.filter(ranked, lambda b: b["number"] == number))["block"]


def split_sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, number, heading, block): of each number its longest block, of equals the first. A null text has none."""
    rows = docs.select(id_col, F.posexplode(_blocks(F.col(text_col))).alias("n", "b")).select(id_col, F.col("n").alias("n"), "b.number", "b.heading", "b.block")
    best = rows.groupBy(id_col, "number").agg(F.max_by(F.struct("n", "heading", "block"), F.struct(F.length("block"), -F.col("n"))).alias("s"))
    return best.select(id_col, "s.n", "number", "s.heading", "s.block")


def select_sections(docs: DataFrame, text_col: str, wanted_col: str, romans: int = 8) -> DataFrame:
    """docs with `selected` and `label`: the wanted sections, in the order asked for, if all of them are found, else the full text. A
    number up to `romans` is also found under its roman numeral. Without wanted sections the text is whole; a null text is empty. Nothing
    leaves its row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumn("_blocks", _blocks(text))
    asked = F.coalesce(F.col(wanted_col), F.array().cast("array<string>"))
    as_roman = lambda w: F.when(F.coalesce(w.try_cast("int") <= romans, F.lit(False)) & w.rlike(r"^\d+$"), roman(w))
    rows = rows.withColumn("_found", F.transform(asked, lambda w: F.coalesce(_longest(F.col("_blocks"), F.upper(w)), _longest(F.col("_blocks"), as_roman(w)))))
    whole = (F.size(asked) > 0) & ~F.exists("_found", lambda b: b.isNull())
    label = F.when(F.size(asked) == 0, FULL).when(whole, F.concat(F.lit("sections "), F.array_join(asked, ", "))).otherwise(INCOMPLETE)
    return rows.withColumns({"selected": F.when(whole, F.array_join("_found", "\n\n")).otherwise(text), "label": label}).drop("_blocks", "_found")


# Enumerators ------------------------------------------------------------------------------------
#: The kinds of enumerators by which a paragraph can be counted.
LETTER, NUMBER, CAPITAL, SMALL_ROMAN, ROMAN = "a", "1", "A", "i", "I"


def _roman_value(word: str) -> int | None:
    """The value of a well-formed numeral in capitals."""
    values = dict(_ROMAN)
    if not word or any(c not in values for c in word):
        return None
    total = sum(-values[c] if i + 1 < len(word) and values[word[i + 1]] > values[c] else values[c] for i, c in enumerate(word))
    return total if _as_roman(total) == word else None


def _as_roman(n: int) -> str:
    out = ""
    for sign, value in (("M", 1000), ("CM", 900), ("D", 500), ("CD", 400), ("C", 100), ("XC", 90), ("L", 50), ("XL", 40), ("X", 10), ("IX", 9), ("V", 5), ("IV", 4), ("I", 1)):
        while n >= value:
            out, n = out + sign, n - value
    return out


def readings(mark: str) -> list[tuple[str, int]]:
    """What an enumerator can count: (kind, value). (i) is the ninth letter or the first numeral."""
    if mark.isdigit():
        return [(NUMBER, int(mark))]
    out = []
    if len(mark) == 1 and mark.isalpha():
        out.append((LETTER if mark.islower() else CAPITAL, ord(mark.lower()) - 96))
    if (mark.islower() or mark.isupper()) and (value := _roman_value(mark.upper())):
        out.append((SMALL_ROMAN if mark.islower() else ROMAN, value))
    return out


def outline(paragraphs: list[str], nested: bool = True) -> list[tuple]:
    """(n, mark, kind, depth, parent, text) of each paragraph. A stack holds the open enumerators: a mark that counts on at an open level
    closes what is below it, another kind opens a level. Where a mark has two readings, the one that counts on or begins wins; of two such,
    the one the next mark counts on from; of two such, the open level. A paragraph without a mark belongs to the one that is open
    (its parent, one deeper); before the first it is the chapeau, at depth 0. Not nested: single letters alone are marks, all at depth 1."""
    import re

    found = [re.match(r"\(([A-Za-z]{1,6}|\d{1,4})\)\s*(.*)$" if nested else r"\(([A-Za-z])\)\s*(.*)$", p, re.DOTALL) for p in paragraphs]
    read = [readings(m[1]) if m else [] for m in found]
    if not nested:
        read = [[(LETTER, 1)] if m else [] for m in found]
    marks = [i for i, r in enumerate(read) if r]
    after = dict(zip(marks, [*marks[1:], None], strict=True)) if marks else {}
    stack: list[list] = []  # kind, value, row
    out: list[tuple] = []
    for i, text in enumerate(paragraphs):
        if not read[i]:
            out.append((i, None, None, len(stack) + 1 if stack else 0, stack[-1][2] if stack else None, text))
            continue

        def grade(reading: tuple[str, int]) -> tuple:
            kind, value = reading
            level = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == kind), None)
            regular = value == stack[level][1] + 1 if level is not None else value == 1
            goes_on = after[i] is not None and (kind, value + 1) in read[after[i]]
            return regular, goes_on, level is not None

        kind, value = max(read[i], key=grade) if nested else (LETTER, 1)
        level = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == kind), None)
        stack = stack[:level] if level is not None else stack
        out.append((i, found[i][1], kind, len(stack) + 1, stack[-1][2] if stack else None, found[i][2].strip()))
        stack = [*stack, [kind, value, i]]
    return out


#: Rows of several texts are handed on when they come to so many, or to so many characters.
SLICE_ROWS, SLICE_CHARS = 20_000, 4_000_000
ROWS = "n int, mark string, kind string, depth int, parent int, text string"


def subsections(docs: DataFrame, id_col: str, text_col: str, nested: bool = True) -> DataFrame:
    """(id, n, mark, kind, depth, parent, text) of each paragraph of a text (parted by blank lines, inner line ends become spaces). Texts without
    paragraphs have no rows."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    # A small file of many texts is read by one task; the texts are dealt out before they are parsed.
    spread = docs.select(id_col, text_col).repartition(id_col)
    paragraphs = F.filter(F.transform(F.split(F.coalesce(text_col, F.lit("")), r"\n[ \t]*\n"), lambda p: _strip(F.regexp_replace(p, r"\s*\n\s*", " "))), lambda p: p != "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]

        def made(ids, at, rows):
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *columns], names=[id_col, *[x.split()[0] for x in ROWS.split(", ")]])

        for batch in batches:
            at, rows, size = [], [], 0
            for i in range(batch.num_rows):
                of = outline(batch.column(1)[i].as_py(), nested)
                at += [i] * len(of)
                rows += of
                size += sum(len(r[-1]) for r in of)
                if size > SLICE_CHARS or len(rows) > SLICE_ROWS:
                    yield made(batch.column(0), at, rows)
                    at, rows, size = [], [], 0
            if rows:
                yield made(batch.column(0), at, rows)

    return spread.select(id_col, paragraphs.alias("p")).mapInArrow(run, f"`{id_col}` {kind}, {ROWS}")
