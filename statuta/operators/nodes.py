"""Tables of statute nodes: paths, proofs, notes of repealed laws, placement of notes, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import checks

#: Tokens that unfinished text leaves.
PLACEHOLDERS = ["TODO", "FIXME", "PLACEHOLDER", "LOREM IPSUM", "TBD", "XXXX"]
#: What a proof of a node in the baseline must state.
PROOF_FIELDS = ["baseline_commit", "file", "node_id", "identifier", "existing_text", "comparison"]
#: What the history note of a repealed law must say.
HISTORY_WORDS = ["repealed", "no current operative effect"]


def breadcrumbs(nodes: DataFrame, depth: int = 8, mark: str = " > ") -> DataFrame:
    """(id, path, complete): labels from the root to each node, those without a label left out. nodes: (id,
    parent, label), parent null at a root. One join a level, up to `depth` levels; complete tells whether the
    root was reached, so that deeper trees and loops are seen."""
    up = nodes.select(F.col("id").alias("_up"), F.col("parent").alias("_next"), F.col("label").alias("_label"))
    out = nodes.select("id", F.col("parent").alias("_at"), F.array("label").alias("_path"))
    for _ in range(depth - 1):
        found = out.join(up, F.col("_at") == F.col("_up"), "left")
        out = found.select("id", F.col("_next").alias("_at"), F.concat(F.array("_label"), "_path").alias("_path"))
    said = F.filter("_path", lambda x: x.isNotNull() & (x != ""))
    return out.select("id", F.array_join(said, mark).alias("path"), F.col("_at").isNull().alias("complete"))


def baseline_proofs(proofs: DataFrame, nodes: DataFrame, baseline: str) -> DataFrame:
    """Proofs with `proved`: all fields stated, of this baseline, and that file has the node and the
    identifier. nodes: (file, node_id, identifier) of the baseline."""
    stated = F.lit(True)
    for name in PROOF_FIELDS:
        stated = stated & (F.trim(F.coalesce(F.col(name), F.lit(""))) != "")
    has_node = nodes.select("file", "node_id").distinct().withColumn("_node", F.lit(True))
    has_identifier = nodes.select("file", "identifier").distinct().withColumn("_identifier", F.lit(True))
    rows = proofs.join(has_node, ["file", "node_id"], "left").join(has_identifier, ["file", "identifier"], "left")
    proved = stated & (F.col("baseline_commit") == baseline) & F.col("_node") & F.col("_identifier")
    return rows.withColumn("proved", F.coalesce(proved, F.lit(False))).drop("_node", "_identifier")


def merged_provisions(final: DataFrame, review: DataFrame, source: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, pos, side, final_pos, how, review_*): the provisions that a law's review (else, where a law has
    none, its source) puts beside the final ones: those of the same ref (of equals the last; a missing ref is
    the position), else those of the same position, else none. Each side: (key, pos from 0, ref, fields)."""
    named = lambda df: df.withColumn("_ref", F.coalesce(F.nullif("ref", F.lit("")), F.col("pos").cast("string")))
    reviewed, has_final = review.select(key).distinct(), final.select(key).distinct()
    rest = source.join(reviewed, key, "left_anti").join(has_final, key, "left_semi")
    incoming = named(review.withColumn("side", F.lit("review")).unionByName(rest.withColumn("side", F.lit("source"))))
    by_ref = named(final).groupBy(key, "_ref").agg(F.max("pos").alias("_by_ref"))
    by_pos = final.select(key, "pos", F.col("pos").alias("_by_pos")).distinct()
    both = incoming.join(by_ref, [key, "_ref"], "left").join(by_pos, [key, "pos"], "left")
    how = F.when(F.col("_by_ref").isNotNull(), "ref").when(F.col("_by_pos").isNotNull(), "position").otherwise("none")
    return both.select(key, "pos", "side", F.coalesce("_by_ref", "_by_pos").alias("final_pos"), how.alias("how"), *[F.col(f).alias(f"review_{f}") for f in fields])


def reconciled(nodes: DataFrame, decisions: DataFrame, laws: DataFrame) -> DataFrame:
    """(file, node_id, law_id, outcome) for the nodes of repealed laws. nodes: (file, node_id, law_id of its
    prefix); decisions: (file, node_id, decision: keep, restore, conflict, remove); laws: (law_id, note_id).
    A law's history note is rewritten, a node that no ledger keeps is removed, and a law without its note gets
    one in the first of its files (outcome add)."""
    own = nodes.join(laws, "law_id").join(decisions.select("file", "node_id", "decision"), ["file", "node_id"], "left")
    outcome = F.when(F.col("decision").isin("keep", "conflict", "restore"), F.col("decision")).when(F.col("node_id") == F.col("note_id"), "rewrite").otherwise("remove")
    out = own.select("file", "node_id", "law_id", outcome.alias("outcome"))
    lacking = own.groupBy("law_id", "note_id").agg(F.min("file").alias("file"), F.max((F.col("node_id") == F.col("note_id")).cast("int")).alias("_has")).where("_has = 0")
    return out.unionByName(lacking.select("file", F.col("note_id").alias("node_id"), "law_id", F.lit("add").alias("outcome")))


def verdicts(outcomes: DataFrame) -> DataFrame:
    """One row a law of `reconciled`: counts and the disposition."""
    n = lambda *names: F.count_if(F.col("outcome").isin(*names))
    said = F.when(n("conflict") > 0, "manual-review-required").when(n("keep") > 0, "repealed-with-later-active-replacement").otherwise("repealed-history-only")
    return outcomes.groupBy("law_id").agg(n("remove").alias("removed"), n("restore").alias("restored"), n("rewrite", "add").alias("notes"), n("keep").alias("retained"), said.alias("disposition"))


def says_repealed(text: Column) -> Column:
    low = F.lower(F.regexp_replace(text, r"\s+", " "))
    return F.coalesce(low.contains(HISTORY_WORDS[0]) & low.contains(HISTORY_WORDS[1]), F.lit(False))


def placed_notes(rows: DataFrame, existing: DataFrame, sections: DataFrame) -> DataFrame:
    """(note_id, file, identifier, how) of one controlling place a note. rows: (note_id, law_id, file,
    identifier), one a note; existing: (note_id, file); sections: (file, identifier, law_id, ord).
    A note that its approved file has is replaced there. Else it goes to the identifier if the file has it, then
    to the first section that the law made there, to the part's section, to the file's first section; none of
    these: unplaced."""
    here = existing.select("note_id", "file").distinct().withColumn("_here", F.lit(True))
    known = sections.select("file", "identifier").distinct()
    parent = F.regexp_extract("identifier", r"^(/us/usc/t\d+[A-Za-z]?/s[0-9A-Za-z.\-]+)", 1)
    by_law = sections.where("law_id is not null").groupBy("file", "law_id").agg(F.min_by("identifier", F.struct("ord", "identifier")).alias("_law"))
    by_file = sections.groupBy("file").agg(F.min_by("identifier", F.struct("ord", "identifier")).alias("_first"))
    found = (
        rows.withColumn("_parent", parent).join(here, ["note_id", "file"], "left").join(known.select("file", "identifier", F.lit(True).alias("_exact")), ["file", "identifier"], "left")
        .join(known.select("file", F.col("identifier").alias("_parent"), F.lit(True).alias("_has_parent")), ["file", "_parent"], "left").join(by_law, ["file", "law_id"], "left").join(by_file, "file", "left")
    )
    steps = [("replaced", F.col("_here"), F.col("identifier")), ("exact", F.col("_exact"), F.col("identifier")), ("law", F.col("_law").isNotNull(), F.col("_law")), ("parent", F.col("_has_parent"), F.col("_parent")), ("first", F.col("_first").isNotNull(), F.col("_first"))]
    how, place = F.lit("unplaced"), F.lit(None).cast("string")
    for name, condition, to in reversed(steps):
        how, place = F.when(condition, F.lit(name)).otherwise(how), F.when(condition, to).otherwise(place)
    return found.select("note_id", "file", place.alias("identifier"), how.alias("how"))


def stale_notes(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """(note_id, file) of copies of a note outside its approved file."""
    return existing.join(rows.select("note_id"), "note_id", "left_semi").join(rows.select("note_id", "file"), ["note_id", "file"], "left_anti").select("note_id", "file").distinct()


def content_audit(nodes: DataFrame, refs: DataFrame, namespace: str) -> DataFrame:
    """(node_id, rule) of what is wrong with the project's nodes. nodes: (node_id, file, section, tag, text,
    num, namespace, credited, reserved, own); refs: (node_id, file, section, href, marker). Rules read the
    project's own nodes, references resolve to any section of the file."""
    own = nodes.where("own")
    text = F.upper(F.coalesce(F.col("text"), F.lit("")))
    empty = F.trim(text) == ""
    placeholder = F.lit(False)
    for token in PLACEHOLDERS:
        placeholder = placeholder | text.contains(token)
    told = checks.failures(own, "node_id", {
        "empty-note": ~((F.col("tag") == "note") & empty), "empty-node": ~(F.col("tag").isin("content", "p") & empty), "placeholder": ~placeholder,
        "missing-number": ~((F.col("tag") == "subsection") & (F.coalesce(F.col("num"), F.lit("")) == "")), "wrong-namespace": F.col("namespace") == namespace,
        "missing-credit": F.col("credited") | F.col("reserved"),
    })
    mine = refs.join(own.select("node_id").distinct(), "node_id", "left_semi")
    known = nodes.select("file", F.col("section").alias("href")).distinct()
    broken = mine.where("href like '/us/usc/%'").join(known, ["file", "href"], "left_anti").select("node_id", F.lit("broken-reference").alias("rule"))
    again = mine.where("marker <> ''").groupBy("file", "section", "marker").agg(F.count("*").alias("n"), F.min("node_id").alias("node_id")).where("n > 1").select("node_id", F.lit("repeated-citation").alias("rule"))
    return told.unionByName(broken).unionByName(again).distinct()


def candidate_gate(laws: DataFrame, plans: DataFrame, fragments: DataFrame) -> DataFrame:
    """(law_id, error) of drafts that can't be promoted. laws: (law_id, title, method); plans: (law_id, status,
    summary, op, fragment), a row an operation, op null without any; fragments: (fragment, parses, text, ids)."""
    due = laws.where("method is null or method <> 'survival_audit_only'").drop("method")
    rows = due.join(plans.withColumn("_plan", F.lit(True)), "law_id", "left").join(fragments.withColumn("_fragment", F.lit(True)), "fragment", "left")
    plan, fragment, parses = F.col("_plan").isNotNull(), F.col("_fragment").isNotNull(), F.coalesce("parses", F.lit(False))
    has_op = plan & F.col("op").isNotNull()
    errors = {
        "missing draft": ~plan, "not a draft": plan & (F.coalesce("status", F.lit("")) != "draft"), "blank": plan & ((F.coalesce("summary", F.lit("")) == "") | F.col("op").isNull()),
        "unsupported operation": has_op & (F.col("op") != "replace_element_xml"), "missing fragment": has_op & ~fragment, "invalid fragment": has_op & fragment & ~parses,
        "missing title": has_op & parses & ~F.coalesce(F.col("text").contains(F.col("title")), F.lit(False)),
    }
    told = rows.select("law_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in errors.items()]))).alias("error"))
    made = rows.where(has_op & parses).select("law_id", F.explode("ids").alias("id")).where("id like 'rp-%'")
    repeated = made.withColumn("n", F.count("*").over(Window.partitionBy("id"))).where("n > 1").select("law_id", F.lit("repeated id").alias("error"))
    return told.unionByName(repeated).distinct()
