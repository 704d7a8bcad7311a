"""The closest section heading of a title, and from it where a law belongs.

A text meets the headings of its title through an inverted index that is shipped to the tasks, at most `BLOCK` sections at a
time: texts are never joined with headings by token, so a token that a title's headings share costs nothing across rows. For a text
the rarest of its tokens come first, each section they lead to is scored in full, and the search stops as soon as the tokens that are
left can't bring an unseen section up to the best one. Sections that may win by more than tokens (a heading that stands in
the text, a text that stands in a heading, a default) are scored at the start. So the result is that of scoring every section.

Sections of one heading score alike, so that only the first of each heading of a title is shipped, and those that a query names as its
defaults. Texts that stand in a heading are found for all texts of a batch in one pass over the headings, and equal texts are searched once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .phrases import _Shipped

#: Entries of an index, and answers that an index remembers.
BLOCK, REMEMBERED = 300_000, 50_000
#: Points of a shared token, of its length at most, of a text within the other, and of a default section.
SHARED, LENGTH_MOST, HOLDS, DEFAULT = 12, 5.0, 20, 3

_INDEXES: dict = {}


class Index:
    """The first live section of each heading of one title, and its default sections, in document order."""

    def __init__(self, rows: list[tuple]) -> None:
        import ahocorasick

        self.rows = sorted(rows)  # ord, section, heading, tokens
        self.counts = [Counter(r[3]) for r in self.rows]
        self.postings: dict[str, list[int]] = {}
        self.most: Counter = Counter()
        self.by_section: dict[str, list[int]] = {}
        headings: dict[str, list[int]] = {}
        for i, (row, counts) in enumerate(zip(self.rows, self.counts, strict=True)):
            for token, n in counts.items():
                self.postings.setdefault(token, []).append(i)
                self.most[token] = max(self.most[token], n)
            self.by_section.setdefault(row[1], []).append(i)
            if row[2]:
                headings.setdefault(row[2], []).append(i)
        self.longest = max(map(len, headings), default=0)
        self.headings = headings
        self.answers: dict[tuple, tuple] = {}
        self.machine = ahocorasick.Automaton()
        for heading, owners in headings.items():
            self.machine.add_word(heading, owners)
        if headings:
            self.machine.make_automaton()

    def within(self, texts: set[str]) -> dict[str, set[int]]:
        """The entries whose heading holds a text, for the texts that one may hold."""
        import ahocorasick

        short = {t for t in texts if len(t) <= self.longest}
        machine = ahocorasick.Automaton()
        for text in short - {""}:
            machine.add_word(text, text)
        found: dict[str, set[int]] = {t: set() for t in short}
        if len(machine):
            machine.make_automaton()
            for heading, owners in self.headings.items():
                for _, text in machine.iter(heading):
                    found[text].update(owners)
        if "" in found:
            found[""] = {i for owners in self.headings.values() for i in owners}
        return found

    def answer(self, text: str, tokens: list[str], defaults: list[str], within: dict[str, set[int]]) -> tuple:
        key = (text, *defaults)
        if key not in self.answers:
            if len(self.answers) >= REMEMBERED:
                self.answers.clear()
            self.answers[key] = self.best(text, tokens, defaults, within.get(text, set()))
        return self.answers[key]

    def best(self, text: str, tokens: list[str], defaults: list[str], within: set[int]) -> tuple:
        """(section, ord, score, candidates) of the best section; of equals the first. within: the entries whose heading holds the text."""
        asked = Counter(t for t in tokens if t in self.postings)
        holding = {i for _, owners in self.machine.iter(text) for i in owners} if self.headings else set()
        holding |= within
        preferred = {i for s in defaults for i in self.by_section.get(s, [])}
        worth = lambda t, n: SHARED * min(asked[t], n) + min(LENGTH_MOST, len(t) / 2)

        def score(i: int) -> float:
            return sum(worth(t, n) for t, n in self.counts[i].items() if t in asked) + HOLDS * (i in holding) + DEFAULT * (i in preferred)

        seen = {0} | holding | preferred
        top = max((score(i), -i) for i in seen)
        order = sorted(asked, key=lambda t: (len(self.postings[t]), t))
        left = sum(worth(t, self.most[t]) for t in order)
        for token in order:
            if left < top[0]:
                break
            fresh = [i for i in self.postings[token] if i not in seen]
            seen.update(fresh)
            top = max([top, *((score(i), -i) for i in fresh)])
            left -= worth(token, self.most[token])
        row = self.rows[-top[1]]
        return row[1], row[0], float(top[0]), len(seen)


def _index(shipped: _Shipped) -> dict[int, Index]:
    if shipped.id not in _INDEXES:
        by_title: dict[int, list[tuple]] = {}
        for title, *row in shipped.rows:
            by_title.setdefault(title, []).append(tuple(row))
        _INDEXES.clear()
        _INDEXES[shipped.id] = {title: Index(rows) for title, rows in by_title.items()}
    return _INDEXES[shipped.id]


def best_sections(queries: DataFrame, sections: DataFrame, id_col: str = "query_id", block: int = BLOCK) -> DataFrame:
    """(id, title, section, score, candidates): for each query (id, title, query, and if it has the column, defaults) the live section of
    its title whose heading fits best. Points: 12 for every shared token occurrence, min(5, length / 2) for each shared token, 20 if
    one text holds the other, 3 for a default section; ties go to the earlier section (ord). A title whose sections are all reserved gives
    its first default that exists, else its first section, without a score. Titles that don't exist give nothing. candidates: how many sections were
    scored. sections: (title, section, ord, heading, reserved); ids of queries are unique for each title."""
    kind = queries.select(id_col).schema[0].dataType.simpleString()
    live = sections.where("not reserved").select("title", F.col("ord").cast("long").alias("ord"), "section", F.lower(F.coalesce("heading", F.lit(""))).alias("heading"))
    none = F.array().cast("array<string>")
    defaults: Column = F.coalesce("defaults", none) if "defaults" in queries.columns else none
    text = F.lower(F.coalesce("query", F.lit("")))
    asked = queries.select(F.col(id_col), "title", text.alias("text"), T.tokenize(text).alias("tokens"), defaults.alias("defaults"))
    entries = live.groupBy("title", "heading").agg(F.min(F.struct("ord", "section")).alias("f")).select("title", "f.ord", "f.section", "heading")
    if "defaults" in queries.columns:
        wanted = asked.select(F.col("title").alias("t"), F.explode("defaults").alias("s")).distinct()
        named = live.join(wanted, F.col("title").eqNullSafe(F.col("t")) & (F.col("section") == F.col("s")), "left_semi").groupBy("title", "section", "heading").agg(F.min("ord").alias("ord"))
        entries = entries.unionByName(named).distinct()
    entries = entries.withColumn("tokens", T.tokenize(F.col("heading"))).persist()
    blocks = max(1, -(-entries.count() // block))
    part = F.pmod(F.xxhash64("title", "heading"), F.lit(blocks))

    def scored(b: int) -> DataFrame:
        shipped = _Shipped(queries.sparkSession, [tuple(r) for r in (entries.where(part == b) if blocks > 1 else entries).collect()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(shipped)
            for batch in batches:
                at, rows = [], []
                titles, texts = batch.column("title").to_pylist(), batch.column("text")
                of: dict[int, set[str]] = {}
                for i, title in enumerate(titles):
                    if title in index and len(said := texts[i].as_py()) <= index[title].longest:
                        of.setdefault(title, set()).add(said)
                within = {title: index[title].within(some) for title, some in of.items()}
                for i, title in enumerate(titles):
                    if title in index:
                        at.append(i)
                        rows.append((title, *index[title].answer(*[batch.column(c)[i].as_py() for c in ("text", "tokens", "defaults")], within.get(title, {}))))
                if rows:
                    kinds = [pa.int32(), pa.string(), pa.int64(), pa.float64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]], names=[id_col, "title", "section", "ord", "score", "candidates"])

        return asked.mapInArrow(run, f"`{id_col}` {kind}, title int, section string, ord long, score double, candidates long")

    found = reduce(DataFrame.unionAll, [scored(b) for b in range(blocks)])
    if blocks > 1:
        found = found.groupBy(id_col, "title").agg(F.min(F.struct((-F.col("score")).alias("minus"), "ord", "section")).alias("b"), F.sum("candidates").alias("candidates")).select(id_col, "title", "b.section", (-F.col("b.minus")).alias("score"), "candidates")
    return found.select(id_col, "title", "section", "score", "candidates").unionByName(_reserved(asked, sections, live, id_col))


def _reserved(asked: DataFrame, sections: DataFrame, live: DataFrame, id_col: str) -> DataFrame:
    """What titles without a live section give."""
    dead = sections.join(live.select("title").distinct(), "title", "left_anti").select("title", "section", F.col("ord").cast("long").alias("ord"))
    first = dead.groupBy("title").agg(F.min(F.struct("ord", "section")).alias("f"))
    mine = asked.select(id_col, "title", "defaults").join(first, "title")
    wanted = mine.select(id_col, "title", F.posexplode("defaults").alias("n", "section")).join(dead.select("title", "section").distinct(), ["title", "section"]).groupBy(id_col, "title").agg(F.min_by("section", "n").alias("d"))
    return mine.join(wanted, [id_col, "title"], "left").select(id_col, "title", F.coalesce("d", "f.section").alias("section"), F.lit(None).cast("double").alias("score"), F.lit(0).cast("long").alias("candidates"))


def anchors(laws: DataFrame, cited: DataFrame, sections: DataFrame, subjects: DataFrame, rules: DataFrame, general_title: int = 1, general_default: str = "1", chars: int = 12_000) -> DataFrame:
    """(law_id, title, section, branch, cited, subject, score, candidates): where a law's note belongs, by the first branch that gives a section.

    cited: the existing section it cites most, of equals the one cited first. subject: the closest heading of the first title that exists, going through its
    subjects by score (ties by their rank) and each one's titles in order, but for subjects outside the Code. general: the closest heading of the general title.
    first: the first section of the first title. A law's text is its name and the first `chars` characters. laws: (law_id, name, text); cited: (law_id, title,
    section, ord); subjects: (law_id, subject, score); rules: (subject, rank, titles, defaults, non_code)."""
    known = sections.select("title", "section").distinct()
    counts = cited.join(laws.select("law_id"), "law_id", "left_semi").join(known, ["title", "section"]).groupBy("law_id", "title", "section").agg(F.count("*").alias("n"), F.min("ord").alias("at"))
    most = counts.groupBy("law_id").agg(F.min(F.struct((-F.col("n")).alias("minus"), "at", "title", "section")).alias("b")).select("law_id", F.col("b.title").alias("title"), F.col("b.section").alias("section"), (-F.col("b.minus")).alias("cited"))
    titles = sections.select("title").distinct()
    open_rules = rules.where("not non_code").select("subject", "rank", "defaults", F.posexplode("titles").alias("place", "title")).join(titles, "title")
    choice = subjects.select("law_id", "subject", "score").join(open_rules, "subject").groupBy("law_id").agg(F.min(F.struct((-F.col("score")).alias("minus"), "rank", "place", "title", "subject", "defaults")).alias("c"))
    rest = laws.join(most, "law_id", "left_anti").join(choice, "law_id", "left")
    # A row at most each: the general title, and the first section of all.
    general = titles.where(F.col("title") == general_title).select(F.col("title").alias("general"))
    first = sections.agg(F.min(F.struct("title", "ord", "section")).alias("f")).where("f is not null")
    rest = rest.join(F.broadcast(general), how="left").select(
        "law_id", F.coalesce("c.title", "general").alias("title"), F.concat_ws("\n", "name", F.left("text", F.lit(chars))).alias("query"), F.col("c.subject").alias("subject"),
        F.when(F.col("c").isNotNull(), F.col("c.defaults")).otherwise(F.array(F.lit(general_default))).alias("defaults"),
    )
    placed = best_sections(rest.where("title is not null").withColumn("title", F.col("title").cast("int")), sections, "law_id")
    by_heading = placed.join(rest.select("law_id", "subject"), "law_id").select("law_id", "title", "section", F.when(F.col("subject").isNotNull(), "subject").otherwise("general").alias("branch"), F.lit(0).cast("long").alias("cited"), "subject", "score", "candidates")
    none = lambda kind: F.lit(None).cast(kind)
    by_citation = most.select("law_id", "title", "section", F.lit("cited").alias("branch"), F.col("cited").cast("long").alias("cited"), none("string").alias("subject"), none("double").alias("score"), F.lit(0).cast("long").alias("candidates"))
    last = rest.where("title is null").join(F.broadcast(first)).select("law_id", F.col("f.title").alias("title"), F.col("f.section").alias("section"), F.lit("first").alias("branch"), F.lit(0).cast("long").alias("cited"), none("string").alias("subject"), none("double").alias("score"), F.lit(0).cast("long").alias("candidates"))
    return by_citation.unionByName(by_heading).unionByName(last)
