"""Decision tables: rules as rows, the first that matches decides, and conflicts are told.

A rule is a row (rule, priority, conditions, result). Its conditions must all hold; each is (field, op, values), where op is one
of `OPS`, or one of them after `not `. `result` gives values by name. Rules are tried by priority, then by their
order in the table. A table becomes one expression over a row: nothing is joined or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

RULES = "rule string, priority int, conditions array<struct<field:string, op:string, values:array<string>>>, result map<string, string>"
#: Rules of one table: they are part of the plan.
MOST_RULES = 2000
OPS: dict[str, Callable[[Column, list[str]], Column]] = {
    "is": lambda c, values: c.isin(*values),
    "has": lambda c, values: reduce(lambda a, b: a | b, [c.contains(v) for v in values]),
    "any": lambda c, values: F.arrays_overlap(c, F.array(*[F.lit(v) for v in values])),
    "all": lambda c, values: F.size(F.array_except(F.array(*[F.lit(v) for v in values]), c)) == 0,
    "empty": lambda c, values: F.trim(c) == "",
}


def condition(fields: dict[str, Column], field: str, op: str, values: list[str]) -> Column:
    """A condition; what is null holds for nothing and negated for everything."""
    if field not in fields:
        raise ValueError(f"a rule reads the field {field}, which is not given")
    negated, name = op.startswith("not "), op.removeprefix("not ")
    if name not in OPS:
        raise ValueError(f"a rule has the operation {op}")
    holds = F.coalesce(F.trim(fields[field]) == "", F.lit(True)) if name == "empty" else F.coalesce(OPS[name](fields[field], list(values or [])), F.lit(False))
    return ~holds if negated else holds


def decide(df: DataFrame, rules: DataFrame | list[tuple], fields: dict[str, Column], names: list[str]) -> DataFrame:
    """df with `rule` (null where none matches), `conflicts` (other matching rules of the same priority, in order) and for
    each of `names` a column `decided_<name>` with the rule's result or null."""
    table = df.sparkSession.createDataFrame(rules, RULES) if isinstance(rules, list) else rules
    rows = table.limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"a decision table of more than {MOST_RULES} rules")
    if len({r.rule for r in rows}) < len(rows):
        raise ValueError("rules have names of their own")
    ordered = sorted(enumerate(rows), key=lambda x: (x[1].priority, x[0]))
    matched = [F.when(reduce(lambda a, b: a & b, [condition(fields, c["field"], c["op"], c["values"]) for c in r.conditions or []], F.lit(True)), F.struct(F.lit(r.priority).alias("priority"), F.lit(r.rule).alias("rule"))) for _, r in ordered]
    hits = F.array_compact(F.array(*matched)) if matched else F.array().cast("array<struct<priority:int,rule:string>>")
    out = df.withColumn("_hits", hits).withColumn("rule", F.get("_hits", F.lit(0))["rule"])
    same = F.filter(F.slice("_hits", 2, MOST_RULES), lambda x: x["priority"] == F.get("_hits", F.lit(0))["priority"])
    out = out.withColumn("conflicts", F.transform(same, lambda x: x["rule"]))
    for name in names:
        known = [(r.rule, r.result[name]) for r in rows if r.result and r.result.get(name) is not None]
        lookup = F.create_map(*[F.lit(v) for pair in known for v in pair]) if known else F.create_map().cast("map<string,string>")
        out = out.withColumn(f"decided_{name}", F.try_element_at(lookup, F.col("rule")) if known else F.lit(None).cast("string"))
    return out.drop("_hits")


#: Treatments of a law under which new general text goes into the Code, statuses of laws that are history, and the
#: texts that stand in for a missing change.
PLACED = ["operative_text_required", "amend_existing_text", "new_section", "new_subsection", "repeal_marking", "transfer", "redesignation", "substitution"]
HISTORIC = ["fully_repealed", "repealed", "historical_note_only"]
NOTE_TEXT = "Add statutory note material at the current Title 28 anchor."
CONTEXT_TEXT = "Retain as historical enactment context only."
OPERATIVE_TEXT = "Place the operative text in Title 28 text."
HISTORY_TEXT = "Keep as history only."
_GENERAL = [("classes", "any", ["new-permanent-general"]), ("law_treatment", "is", PLACED)]
#: How a provision's class, its summary and its law decide its treatment.
PROVISION_RULES = [
    ("notes", 1, [("classes", "any", ["short-title", "findings-or-sense"])], {"treatment": "statutory-note", "change": NOTE_TEXT}),
    ("effective date", 2, [("classes", "any", ["effective-date"])], {"treatment": "historical-note-only", "change": CONTEXT_TEXT}),
    ("definitions", 3, [*_GENERAL, ("summary", "has", ["definition"])], {"treatment": "new-subsection", "change": OPERATIVE_TEXT, "from": "law"}),
    ("purpose", 4, [*_GENERAL, ("summary", "has", ["purpose"])], {"treatment": "statutory-note", "change": OPERATIVE_TEXT, "from": "law"}),
    ("general", 5, _GENERAL, {"treatment": "new-section", "change": OPERATIVE_TEXT, "from": "law"}),
    ("history", 6, [("law_status", "is", HISTORIC)], {"treatment": "historical-note-only", "change": HISTORY_TEXT}),
]


def normalize_provisions(df: DataFrame, rules: DataFrame | list[tuple] = PROVISION_RULES) -> DataFrame:
    """df with treatment, target and exact_change as the rules have them, `rule` and `conflicts`. df: provisions with classes
    (array), summary, treatment, target, exact_change, those of their source (source_*), and of their law law_status, law_treatment,
    law_target, law_command, law_change. What a provision lacks is taken from its source, then its law; a rule
    whose result says from: law prefers the law's own wording to the provision's."""
    classes = F.when(F.size("classes") > 0, F.col("classes")).otherwise(F.coalesce("source_classes", F.array().cast("array<string>")))
    filled = T.first_nonempty
    fields = {
        "classes": classes, "summary": F.lower(filled(F.col("summary"), F.col("source_summary"))),
        "law_status": T.normalize_text(F.coalesce("law_status", F.lit(""))), "law_treatment": T.normalize_text(F.coalesce("law_treatment", F.lit(""))),
    }
    own = filled(F.col("exact_change"), F.col("source_change"), F.col("law_command"), F.col("law_change"))
    of_law = filled(F.col("law_command"), F.col("law_change"), own)
    out = decide(df, rules, fields, ["treatment", "change", "from"])
    change = F.when(F.col("decided_from") == "law", of_law).otherwise(own)
    return out.withColumns({
        "exact_change": F.coalesce(F.nullif(change, F.lit("")), F.col("decided_change"), F.lit("")),
        "target": filled(F.col("target"), F.col("source_target"), F.col("law_target")),
        "treatment": F.coalesce("decided_treatment", "treatment"),
    }).drop("decided_treatment", "decided_change", "decided_from")
