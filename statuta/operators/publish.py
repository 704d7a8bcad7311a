"""Publication views: registers, routes, search and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def registers(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds register: the first rule that holds. One table, written with partitionBy("register")."""
    out = F.lit(None).cast("string")
    for name, condition in reversed(list(rules.items())):
        out = F.when(condition, name).otherwise(out)
    return rows.withColumn("register", out)


def inventory(actions: DataFrame) -> DataFrame:
    """One row a law, lists joined with ` | `."""
    return actions.groupBy("law_id").agg(F.array_join(F.array_sort(F.collect_set("action_type")), " | ").alias("types"), F.count("*").alias("n_actions"), F.countDistinct("identifier").alias("n_targets"))


def operation_register(actions: DataFrame) -> DataFrame:
    """Operations with their place in their law, from 1, and the law's number of operations."""
    w = Window.partitionBy("law_id")
    return actions.withColumns({"op_index": F.row_number().over(w.orderBy("ord", "action_id", "identifier", "action_type", "treatment", "evidence")), "n_ops": F.count("*").over(w)})


def routes(sections: DataFrame) -> DataFrame:
    """(title, section, path, page_title, description), the first of each (title, section)."""
    first = sections.dropDuplicates(["title", "section"])
    t, s = F.col("title").cast("string"), F.col("section")
    return first.select(
        "title", "section", F.concat(F.lit("/cite/"), t, F.lit("/"), s, F.lit("/")).alias("path"),
        T.compact(F.concat(t, F.lit(" U.S.C. § "), s, F.lit(" - "), F.col("heading")), 180).alias("page_title"), T.compact(F.col("body"), 240).alias("description"),
    )


def search(rows: DataFrame, columns: list[str], text: str) -> DataFrame:
    """Rows any of whose columns hold the text, whatever the case; an empty text keeps all."""
    said = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]))
    return rows.where(said.contains(" ".join(text.lower().split())))


def lookup(sections: DataFrame, wanted: DataFrame) -> DataFrame:
    """(identifier, heading) of sections asked for by title and section, by their keys."""
    keyed = sections.withColumn("key", T.section_key(F.col("section")))
    asked = wanted.select("title", T.section_key(F.col("section")).alias("key")).distinct()
    return keyed.join(asked, ["title", "key"], "left_semi").select("identifier", "heading")


def unambiguous(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys no other row has."""
    w = Window.partitionBy(*keys)
    return rows.withColumn("_n", F.count("*").over(w)).where("_n = 1").drop("_n")


def law_view(actions: DataFrame) -> DataFrame:
    return actions.groupBy("law_id").agg(
        F.count("*").alias("n_actions"), F.countDistinct("identifier").alias("n_targets"), F.count_if(F.col("evidence") == "").alias("without_evidence"), F.count_if(F.col("action_type") == "repeal").alias("repeals")
    )


def summaries(actions: DataFrame) -> DataFrame:
    """A sentence a law."""
    many = lambda n, word: F.concat(F.col(n).cast("string"), F.when(F.col(n) == 1, f" {word}").otherwise(f" {word}s"))
    counts = actions.groupBy("law_id").agg(F.count("*").alias("a"), F.countDistinct("identifier").alias("t"))
    return counts.select("law_id", F.concat("law_id", F.lit(": "), many("a", "action"), F.lit(" on "), many("t", "target"), F.lit(".")).alias("said"))


#: Result states as readers see them.
RESULT_LABELS = {
    "applied": "Applied", "already-satisfied-with-baseline-proof": "Already reflected in the Code", "superseded-by-later-action": "Superseded by a later action",
    "documented-no-code-action": "No Code amendment required", "blocked": "Blocked", "pending": "Pending",
}


def result_label(c: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in RESULT_LABELS.items() for x in pair])
    return F.coalesce(known[c], T.friendly_status(F.coalesce(F.nullif(c, F.lit("")), F.lit("recorded"))))


def effect(repealed: Column, result: Column, action: Column, treatment: Column) -> Column:
    note = F.lower(treatment).contains("note") | F.lower(action).contains("note")
    return F.when(repealed, "repealed-history").when(result == "documented-no-code-action", "no-code").when(result == "superseded-by-later-action", "superseded").when(note, "note").otherwise("code")


def completeness(laws: DataFrame, minimum: int, most_holds: int) -> DataFrame:
    """One row: active laws, those that can be acted on, those without source, and whether that is enough.
    laws: (active, held)."""
    n = laws.agg(F.count_if("active").alias("active_remaining"), F.count_if(F.col("active") & ~F.col("held")).alias("actionable"), F.count_if(F.col("active") & F.col("held")).alias("source_holds"))
    required = F.least(F.lit(minimum).cast("long"), F.col("active_remaining"))
    return n.withColumns({"required": required, "passed": (F.col("actionable") >= required) & (F.col("source_holds") <= most_holds)})


#: Issues that name a report's status, in order of precedence.
STATUS_ISSUES = [
    "schema-invalid", "missing laws", "source unavailable", "unsupported source", "source-defect-unresolved", "operative-text-required-but-target-unresolved",
    "unresolved conclusion", "missing conclusion", "missing evidence", "missing target",
]


def report_status(issues: Column) -> Column:
    """The strongest issue; else incomplete if there is any, else valid."""
    out = F.when(F.size(issues) > 0, "incomplete").otherwise("valid")
    for issue in reversed(STATUS_ISSUES):
        out = F.when(F.array_contains(issues, issue), issue).otherwise(out)
    return out


def disagreements(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, differs): the fields that both sides fill, and differently."""
    both = left.alias("l").join(right.alias("r"), key)
    names = [F.when((F.col(f"l.{f}") != "") & (F.col(f"r.{f}") != "") & (F.col(f"l.{f}") != F.col(f"r.{f}")), f) for f in fields]
    return both.select(key, F.array_join(F.array_compact(F.array(*names)), ",").alias("differs"))
