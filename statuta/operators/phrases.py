"""Phrase catalogues as data: rule tables read from configurations, compiled to one multi-pattern automaton that
counts every phrase of every list in one pass over each text.

A rule is a row (list, category, rank, phrase, weight, most): `rank` orders the categories of a list, `weight` is
what each occurrence counts, `most` bounds what a phrase gives in all. The automaton is broadcast once an executor and kept
by its workers. Catalogues of more than `BLOCK` phrases are run in blocks of whole categories, one pass each, so that
no automaton grows with the catalogue; the rows of a document then meet by its id.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rules as R

RULES = "list string, category string, rank int, phrase string, weight int, most int"
FOUND = "array<struct<list:string,category:string,rank:int,score:long,n:int,phrases:array<string>>>"
#: Phrases of one automaton.
BLOCK = 500_000
_UNBOUNDED = 2**31 - 1


def subject_rules(configs: DataFrame, text_col: str = "text", source_cols: Sequence[str] = ()) -> DataFrame:
    """(*source_cols, subject, rank, titles, defaults, keywords, non_code): the subjects of JSON objects {subject: {titles, defaults,
    keywords, non_code}} in their order. Text that is no such object gives no rows."""
    kind = "map<string, struct<titles: array<int>, defaults: array<string>, keywords: array<string>, non_code: boolean>>"
    rows = configs.select(*source_cols, F.posexplode(F.from_json(text_col, kind)).alias("rank", "subject", "s"))
    empty = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    return rows.select(*source_cols, "subject", "rank", empty(F.col("s.titles"), "int").alias("titles"), empty(F.col("s.defaults"), "string").alias("defaults"), empty(F.col("s.keywords"), "string").alias("keywords"), F.coalesce("s.non_code", F.lit(False)).alias("non_code"))


def subject_phrases(subjects: DataFrame, phrase_weight: int = 5, word_weight: int = 3, most: int = 12) -> DataFrame:
    """RULES of subjects: a keyword of several words weighs more than a single one."""
    rows = subjects.select("subject", "rank", F.explode("keywords").alias("keyword"))
    weight = F.when(F.col("keyword").contains(" "), phrase_weight).otherwise(word_weight)
    return rows.select(F.lit("subject").alias("list"), F.col("subject").alias("category"), "rank", F.lower("keyword").alias("phrase"), weight.alias("weight"), F.lit(most).alias("most"))


def category_phrases(configs: DataFrame, name: str, weight: int = 5, text_col: str = "text") -> DataFrame:
    """RULES of a JSON object {category: [phrases]}; a phrase that is present gives its weight once."""
    rows = configs.select(F.posexplode(F.from_json(text_col, "map<string, array<string>>")).alias("rank", "category", "phrases"))
    return rows.select(F.lit(name).alias("list"), "category", "rank", F.explode(F.transform("phrases", F.lower)).alias("phrase"), F.lit(weight).alias("weight"), F.lit(weight).alias("most"))


def built_in(spark: SparkSession) -> DataFrame:
    """RULES of the lists that dispositions rest on."""
    rows = [(name, name, 0, p, w, 20) for name, phrases in (("permanent", R.PERMANENT), ("temporary", R.TEMPORARY)) for p, w in phrases]
    rows += [("non_code", category, rank, p, 5, 5) for rank, (category, phrases) in enumerate(R.NON_CODE) for p in phrases]
    rows += [(name, name, 0, p, 1, 1) for name, phrases in (("rider", R.RIDER), ("residual", R.RESIDUAL)) for p in phrases]
    return spark.createDataFrame(rows, RULES)


_AUTOMATA: dict = {}


def _automaton(shipped: _Shipped):
    """The automaton, built once by a worker process from the broadcast rows."""
    import ahocorasick

    if shipped.id not in _AUTOMATA:
        by_phrase: dict[str, list[int]] = {}
        for i, r in enumerate(shipped.rows):
            by_phrase.setdefault(r[3], []).append(i)
        machine = ahocorasick.Automaton()
        for phrase, owners in by_phrase.items():
            machine.add_word(phrase, (phrase, owners))
        machine.make_automaton()
        _AUTOMATA.clear()  # a worker serves one catalogue at a time
        _AUTOMATA[shipped.id] = machine
    return _AUTOMATA[shipped.id]


class _Shipped:
    def __init__(self, spark: SparkSession, rows: list[tuple]) -> None:
        self._rows = spark.sparkContext.broadcast(rows)
        self.id = uuid.uuid4().hex

    @property
    def rows(self) -> list[tuple]:
        return self._rows.value


class _Hits:
    """Finds of a batch's texts as flat columns: no object is made for a find."""

    def __init__(self) -> None:
        self.ends, self.phrase_ends = [0], [0]
        self.categories, self.scores, self.numbers, self.phrases = [], [], [], []

    def add(self, text: str, machine, rows: list[tuple]) -> None:
        """What each category of the catalogue finds in a text; occurrences of a phrase don't overlap."""
        counts: dict[str, int] = {}
        ends: dict[str, int] = {}
        hit: dict[tuple, list[int]] = {}
        for last, (phrase, owned) in machine.iter(text):
            if last - len(phrase) >= ends.get(phrase, -1):
                if phrase not in counts:
                    counts[phrase] = 0
                    for i in owned:
                        hit.setdefault(rows[i][:3], []).append(i)
                counts[phrase] += 1
                ends[phrase] = last
        for name, category, rank in sorted(hit, key=lambda k: (k[0], k[2], k[1])) if len(hit) > 1 else hit:
            which = sorted(hit[name, category, rank])
            self.categories.append((name, category, rank))
            self.scores.append(sum(min(rows[i][5], rows[i][4] * counts[rows[i][3]]) for i in which))
            self.numbers.append(len(which))
            self.phrases.extend(rows[i][3] for i in which)
            self.phrase_ends.append(len(self.phrases))

    def close(self) -> None:
        """Ends a text."""
        self.ends.append(len(self.scores))

    def column(self) -> pa.Array:
        name, category, rank = zip(*self.categories, strict=True) if self.categories else ((), (), ())
        phrases = pa.ListArray.from_arrays(pa.array(self.phrase_ends, pa.int32()), pa.array(self.phrases, pa.string()))
        columns = [pa.array(name, pa.string()), pa.array(category, pa.string()), pa.array(rank, pa.int32()), pa.array(self.scores, pa.int64()), pa.array(self.numbers, pa.int32()), phrases]
        return pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), pa.StructArray.from_arrays(columns, ["list", "category", "rank", "score", "n", "phrases"]))


def _block(docs: DataFrame, rows: list[tuple], keep: list[str], text: Column, as_name: str) -> DataFrame:
    spark = docs.sparkSession
    shipped = _Shipped(spark, rows)
    any_rows = bool(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(shipped) if any_rows else None
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            found = _Hits()
            for said in texts:
                if any_rows and (t := said.as_py()):
                    found.add(t, machine, shipped.rows)
                found.close()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found.column()], names=[*batch.schema.names[:-1], as_name])

    said = docs.select(*keep, F.lower(text).alias("_low"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in said.schema.fields[:-1]), f"`{as_name}` {FOUND}"])
    return said.mapInArrow(run, schema)


def found(docs: DataFrame, rules: DataFrame, keep: list[str], text: Column | str = "text", as_name: str = "found", block: int = BLOCK) -> DataFrame:
    """(*keep, found): for each document the categories any of whose phrases occur, with score, number of different phrases and
    the phrases in the rules' order. keep: columns that pass through; with more than one block of rules the first of
    them is the document's key. Empty phrases and null fields count for nothing; null texts find nothing."""
    text = F.col(text) if isinstance(text, str) else text
    usable = rules.select(*[x.split()[0] for x in RULES.split(", ")]).where("phrase <> '' and list is not null and category is not null")
    usable = usable.select("list", "category", F.coalesce("rank", F.lit(0)).alias("rank"), "phrase", F.coalesce("weight", F.lit(1)).alias("weight"), F.coalesce("most", F.lit(_UNBOUNDED)).alias("most"))
    blocks = max(1, -(-usable.count() // block))
    if blocks == 1:
        return _block(docs, [tuple(r) for r in usable.collect()], keep, text, as_name)
    part = F.pmod(F.xxhash64("list", "category"), F.lit(blocks))
    every = [_block(docs, [tuple(r) for r in usable.where(part == b).collect()], keep, text, as_name).select(keep[0], F.explode(as_name).alias("f")) for b in range(blocks)]
    hits = reduce(DataFrame.unionAll, every).groupBy(F.col(keep[0]).alias("_key")).agg(F.collect_set("f").alias("f"))
    order = F.transform("f", lambda x: F.struct(x["list"].alias("list"), x["rank"].alias("rank"), x["category"].alias("category"), x.alias("f")))
    joined = docs.select(*keep).join(hits, F.col(keep[0]).eqNullSafe(F.col("_key")), "left")
    return joined.select(*keep, F.coalesce(F.transform(F.array_sort(order), lambda x: x["f"]), F.array().cast(FOUND)).alias(as_name))


# What is read off the catalogue's finds --------------------------------------------------------
def of_list(name: str, field: str = "score", as_name: str = "found") -> Column:
    """The sum of a field over the categories of a list."""
    return F.aggregate(F.filter(as_name, lambda x: x["list"] == name), F.lit(0).cast("long"), lambda a, x: a + x[field].cast("long"))


def best(name: str, top: int, as_name: str = "found") -> Column:
    """The `top` categories of a list by score, ties by rank: array of (category, score)."""
    scored = F.transform(F.filter(as_name, lambda x: x["list"] == name), lambda x: F.struct((-x["score"]).alias("minus"), x["rank"].alias("rank"), x["category"].alias("category")))
    return F.transform(F.slice(F.array_sort(scored), 1, top), lambda x: F.struct(x["category"].alias("category"), (-x["minus"]).alias("score")))


def first(name: str, also: dict[str, Column] | None = None, top: int = 5, as_name: str = "found") -> Column:
    """(category, evidence) of the first category of a list by rank; also: a further condition for a category."""
    conditions = also or {}
    allowed = lambda x: reduce(lambda a, b: a & b, [(x["category"] != c) | F.coalesce(cond, F.lit(False)) for c, cond in conditions.items()], F.lit(True))
    hits = F.array_sort(F.transform(F.filter(as_name, lambda x: (x["list"] == name) & allowed(x)), lambda x: F.struct(x["rank"].alias("rank"), x["category"].alias("category"), x["phrases"].alias("phrases"))))
    head = F.get(hits, F.lit(0))
    return F.struct(F.coalesce(head["category"], F.lit("")).alias("category"), F.coalesce(F.array_join(F.slice(head["phrases"], 1, top), ", "), F.lit("")).alias("evidence"))


def subjects(docs: DataFrame, rules: DataFrame, id_col: str, text_col: str, title_col: str | None = None, top: int = 8, chars: int = 16_000) -> DataFrame:
    """(id, subject, score, rank) of the best subjects of a document, from its title and the first `chars` of its text."""
    head = F.left(F.col(text_col), F.lit(chars))
    said = F.concat_ws("\n", F.col(title_col), head) if title_col else head
    rows = found(docs, rules, [id_col], said).select(id_col, F.posexplode(best("subject", top)).alias("rank", "b"))
    return rows.select(id_col, F.col("b.category").alias("subject"), F.col("b.score").alias("score"), (F.col("rank") + 1).alias("rank"))


def characters(docs: DataFrame, rules: DataFrame, keep: list[str], text_col: str = "text", title_col: str | None = None) -> DataFrame:
    """(*keep, permanent, temporary, non_code, category, evidence, rider, residual): what the lists say of each document in one pass."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    low = F.lower(F.col(text_col))
    # Told before the pass, so that no text goes through it only to be asked afterwards.
    money = text.rlike(r"\$\s*\d") | low.contains("fiscal year") | low.contains("appropriated, out of")
    rows = found(docs.withColumn("_money", money), rules, [*keep, "_money"], F.concat_ws("\n", F.col(title_col), text) if title_col else text)
    out = rows.withColumn("_first", first("non_code", {"appropriation": F.col("_money")}))
    named = [of_list("permanent").alias("permanent"), of_list("temporary").alias("temporary"), of_list("non_code").alias("non_code")]
    return out.select(*keep, *named, "_first.category", "_first.evidence", (of_list("rider", "n") >= 2).alias("rider"), (of_list("residual", "n") > 0).alias("residual"))
