"""Guarded edits of section rows as ordered folds, and the checks around them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def strike_insert(sections: DataFrame, ops: DataFrame) -> DataFrame:
    """Applies quoted edits to section bodies in (law order, op order). ops: (identifier, ord, old_text,
    new_text). An edit is made only if its old text occurs exactly once in the body as it then stands.

    Gives identifier, body, applied and refused. One group holds the edits of one section; a body is
    folded in its own row, so no title is gathered.
    """
    grouped = ops.groupBy("identifier").agg(F.array_sort(F.collect_list(F.struct("ord", "old_text", "new_text"))).alias("ops"))
    zero = F.struct(F.col("body").alias("body"), F.lit(0).alias("applied"), F.lit(0).alias("refused"))

    def step(state: Column, op: Column) -> Column:
        once = T.count_text(state["body"], op["old_text"]) == 1
        return F.struct(
            F.when(once, F.replace(state["body"], op["old_text"], op["new_text"])).otherwise(state["body"]).alias("body"),
            (state["applied"] + once.cast("int")).alias("applied"), (state["refused"] + (~once).cast("int")).alias("refused"),
        )

    joined = sections.join(grouped, "identifier", "left").withColumn("ops", F.coalesce("ops", F.array().cast("array<struct<ord:bigint,old_text:string,new_text:string>>")))
    return joined.withColumn("s", F.aggregate("ops", zero, step)).select("identifier", "s.body", "s.applied", "s.refused")


def append_notes(sections: DataFrame, notes: DataFrame) -> DataFrame:
    """Appends each note once: a note whose marker the body already holds changes nothing. notes:
    (identifier, ord, marker, note)."""
    grouped = notes.groupBy("identifier").agg(F.array_sort(F.collect_list(F.struct("ord", "marker", "note"))).alias("notes"))
    joined = sections.join(grouped, "identifier", "left").withColumn("notes", F.coalesce("notes", F.array().cast("array<struct<ord:bigint,marker:string,note:string>>")))
    add = lambda body, n: F.when(F.instr(body, n["marker"]) > 0, body).otherwise(F.concat(body, F.lit("\n["), n["marker"], F.lit("] "), n["note"]))
    return joined.select("identifier", F.aggregate("notes", F.col("body"), add).alias("body"))


def repeal(sections: DataFrame, targets: DataFrame) -> DataFrame:
    """Heading `Repealed` and an empty body for the targets; numbers and all else stay."""
    hit = targets.select("identifier").distinct().withColumn("_hit", F.lit(True))
    joined = sections.join(hit, "identifier", "left")
    gone = F.coalesce("_hit", F.lit(False))
    return joined.withColumns({"heading": F.when(gone, "Repealed").otherwise(F.col("heading")), "body": F.when(gone, "").otherwise(F.col("body")), "reserved": F.col("reserved") | gone}).drop("_hit")


def restate(sections: DataFrame, texts: DataFrame) -> DataFrame:
    """Replaces the bodies of sections by the last restatement of each. texts: (identifier, ord, new_body)."""
    last = texts.groupBy("identifier").agg(F.max_by("new_body", "ord").alias("new_body"))
    return sections.join(last, "identifier", "left").withColumn("body", F.coalesce("new_body", "body")).drop("new_body")


def insert(sections: DataFrame, new: DataFrame) -> DataFrame:
    """Adds sections whose identifier isn't there yet, each once."""
    fresh = new.dropDuplicates(["identifier"]).join(sections, "identifier", "left_anti")
    return sections.unionByName(fresh.select(sections.columns))


def apply_manifest(sections: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Applies the operations of many laws in law order, then by their number in the law. sections: (identifier,
    heading, body, notes). ops: (op_id, op_no, law_id, law_order, identifier, title, kind, old_text, new_text, marker,
    confidence).

    Gives the sections as they stand at the end, with new ones, and (op_id, law_id, identifier, kind, status) of each
    operation. A section's operations are folded in its own row, so each sees what those before it left.
    An operation without a title is skipped, a destructive one of less than high confidence is withheld, an
    edit whose old text doesn't stand exactly once becomes a note, and a note whose marker is there is kept once.
    Operations are dealt out by section before they are collected, without the texts that neither their kind nor their fate uses.
    """
    fields = ["law_order", "op_no", "op_id", "law_id", "title", "kind", "old_text", "new_text", "marker", "confidence"]
    used = F.col("title").isNotNull() & (withheld(F.col("kind"), F.col("confidence")) == "planned")
    of = {"old_text": ("STRIKE_INSERT",), "marker": ("STRIKE_INSERT", "APPEND_TEXT", "STATUTORY_NOTE"), "new_text": ("STRIKE_INSERT", "REPLACE_SECTION", "ADD_NEW_SECTION", "APPEND_TEXT", "STATUTORY_NOTE")}
    ops = ops.select("identifier", *[F.when(used & F.col("kind").isin(*of[c]), F.col(c)).alias(c) if c in of else c for c in fields]).repartition("identifier")
    grouped = ops.groupBy("identifier").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("ops"))
    joined = sections.select("identifier", "heading", "body", "notes", F.lit(True).alias("there")).join(grouped, "identifier", "full_outer")
    zero = F.struct(
        F.coalesce("there", F.lit(False)).alias("there"), F.coalesce("heading", F.lit("")).alias("heading"), F.coalesce("body", F.lit("")).alias("body"), F.coalesce("notes", F.lit("")).alias("notes"),
        F.array().cast("array<string>").alias("status"),
    )

    def step(s: Column, op: Column) -> Column:
        kind = op["kind"]
        note = F.concat(F.lit("["), op["marker"], F.lit("] "), op["new_text"], F.lit("\n"))
        noted = F.instr(s["notes"], F.concat(F.lit("["), op["marker"], F.lit("]"))) > 0
        once = T.count_text(s["body"], op["old_text"]) == 1
        status = (
            F.when(op["title"].isNull(), "skipped-no-title").when(withheld(kind, op["confidence"]) != "planned", withheld(kind, op["confidence"]))
            .when(kind == "ADD_NEW_SECTION", F.when(s["there"], "already-present").otherwise("executed"))
            .when(~kind.isin("STRIKE_INSERT", "REPEAL_SECTION", "REPLACE_SECTION", "APPEND_TEXT", "STATUTORY_NOTE"), "unsupported")
            .when(~s["there"], "target-not-found")
            .when(kind == "STRIKE_INSERT", F.when(once, "executed").when(noted, "fallback-note:already-present").otherwise("fallback-note:executed"))
            .when(kind == "REPEAL_SECTION", F.when(s["heading"] == "Repealed", "already-present").otherwise("executed"))
            .when(kind.isin("APPEND_TEXT", "STATUTORY_NOTE") & noted, "already-present").otherwise("executed")
        )

        def after_status(done: Column) -> Column:
            runs = done == "executed"
            texts = runs & kind.isin("REPLACE_SECTION", "ADD_NEW_SECTION")
            body = F.when(runs & (kind == "STRIKE_INSERT"), F.replace(s["body"], op["old_text"], op["new_text"])).when(runs & (kind == "REPEAL_SECTION"), "").when(texts, op["new_text"]).otherwise(s["body"])
            heading = F.when(runs & (kind == "REPEAL_SECTION"), "Repealed").when(texts, F.left(op["new_text"], F.lit(20))).otherwise(s["heading"])
            repealed = F.concat(F.lit("[repeal] Repealed by "), op["law_id"], F.lit("\n"))
            notes = F.concat(s["notes"], F.when(runs & (kind == "REPEAL_SECTION"), repealed).when((runs & kind.isin("APPEND_TEXT", "STATUTORY_NOTE")) | (done == "fallback-note:executed"), note).otherwise(""))
            return F.struct(
                (s["there"] | (runs & (kind == "ADD_NEW_SECTION"))).alias("there"), heading.alias("heading"), body.alias("body"), notes.alias("notes"), F.concat(s["status"], F.array(done)).alias("status"),
            )

        # Bound, as every use of an expression would count the old text and look for the marker again.
        return T.bound(status, after_status)

    folded = joined.withColumn("s", F.aggregate(F.coalesce("ops", F.array().cast(grouped.schema["ops"].dataType)), zero, step))
    after = folded.where("s.there").select("identifier", "s.heading", "s.body", "s.notes")
    told = folded.where("ops is not null").select("identifier", F.explode(F.arrays_zip("ops", F.col("s.status").alias("status"))).alias("x"))
    return after, told.select("x.ops.op_id", "x.ops.law_id", "identifier", "x.ops.kind", "x.status")


def withheld(kind: Column, confidence: Column) -> Column:
    """Destructive operations of less than high confidence are preserved by a note instead."""
    return F.when(kind.isin("STRIKE_INSERT", "REPEAL_SECTION", "REPLACE_SECTION", "ADD_NEW_SECTION") & (confidence != "high"), "withheld-preserved-by-note").otherwise("planned")


def disposition(ready: dict[str, Column]) -> Column:
    """The ordered cascade of dispositions. ready: named conditions and scores of a law."""
    r = ready
    steps = [
        (r["incorporated"], "ALREADY_INCORPORATED"), (~r["active"], "NONOPERATIVE_OR_REPEALED"), (~r["has_source"], "SOURCE_UNAVAILABLE"),
        ((r["category"] != "") & ~r["direct"] & ~((r["category"] == "appropriation") & r["rider"]), "NON_CODE"),
        (~r["direct"] & (r["temporary"] >= F.greatest(F.lit(8), r["permanent"] + 5)), "NON_CODE"),
        (r["direct"] & (r["supplement"] | r["unresolved"]), "HYBRID_DIRECT_AMENDMENT_AND_STATUTORY_NOTE"), (r["direct"], "DIRECT_CODE_AMENDMENT"),
    ]
    return reduce(lambda out, s: F.when(s[0], s[1]).otherwise(out), reversed(steps), F.lit("STATUTORY_NOTE"))


#: Treatments and the action each stands for.
TREATMENTS = {
    "new_section": "insert new section",
    "new_subsection": "insert new subsection",
    "amend_existing_text": "amend existing text",
    "repeal_marking": "repeal or remove project-added text",
    "redesignation": "redesignate",
    "transfer": "transfer",
    "substitution": "substitution",
    "statutory_note": "add statutory note",
    "statutory_note_only": "add statutory note",
    "note_only": "add statutory note",
    "historical_note_only": "add historical note",
    "historical_note": "add historical note",
    "history_only": "add historical note",
    "source_limited_historical_note": "add historical note",
    "amendment_note": "add amendment note",
    "effective_date_note": "add historical note",
    "savings_note": "add historical note",
    "transfer_note": "add statutory note",
    "exclude_from_code": "no Code action",
    "already_incorporated": "no Code action",
}
#: Actions that change the Code's text.
EXECUTABLE = ("amend existing text", "insert new section", "insert new subsection", "repeal or remove project-added text", "redesignate", "transfer", "substitution")


def action_for(treatment: Column, classes: Column | None = None, summary: Column | None = None) -> Column:
    """The action of a treatment; of an unknown one, that of the provision's classes and summary."""
    known = F.create_map(*[F.lit(x) for pair in TREATMENTS.items() for x in pair])
    of = F.coalesce(classes, F.array().cast("array<string>")) if classes is not None else F.array().cast("array<string>")
    said = F.lower(F.coalesce(summary, F.lit(""))) if summary is not None else F.lit("")
    general = F.when(said.contains("definition"), "insert new subsection").when(said.rlike("purpose|findings|sense"), "add statutory note").otherwise("insert new section")
    default = (
        F.when(F.array_contains(of, "new-permanent-general"), general).when(F.arrays_overlap(of, F.array(F.lit("short-title"), F.lit("findings-or-sense"))), "add statutory note")
        .when(F.array_contains(of, "effective-date"), "add historical note").otherwise("no Code action")
    )
    return F.coalesce(known[T.normalize_text(F.coalesce(treatment, F.lit("")), "runs")], default)


def executable(action: Column) -> Column:
    return action.isin(*EXECUTABLE)
