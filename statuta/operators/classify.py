"""Dispositions of enactments from what their texts order."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.chunks import shared_folder
from . import edits, match, patch, rules

#: Operations that change existing text, statuses and categories that are certain.
DESTRUCTIVE = ("STRIKE_INSERT", "REPEAL_SECTION", "REPLACE_SECTION", "ADD_NEW_SECTION")
CERTAIN_STATUS = ("repealed", "rescinded", "failed", "expired", "superseded")
CERTAIN_CATEGORY = ("constitutional", "appropriation", "appointment", "treaty", "private")
FACT_TYPES = {"category": pa.string(), "temporary": pa.int32(), "permanent": pa.int32(), "rider": pa.bool_(), "residual": pa.bool_()}


def ordered(docs: DataFrame, sections: DataFrame, chapters: DataFrame) -> DataFrame:
    """(law_id, order, start, hard, sure, n_chars) of everything that texts order: sections added to chapters, sections repealed or restated,
    quoted edits, parts repealed and texts added. order: a hash by which a law's repeated orders are told; hard: it changes existing text; sure:
    of high confidence. Blocks and texts stay where they were found: of them goes on what the counts need."""
    added = edits.with_chapters(edits.added_blocks(docs, "law_id", "text").select("law_id", "start", "title", "section", "chapter", F.col("n_chars").cast("int").alias("n_chars")), chapters)
    added = added.select(
        "law_id", "start", F.lit("ADD_NEW_SECTION").alias("kind"), "title", "section", F.lit(0).cast("long").alias("texts"), (F.col("chapter_exists") & (F.col("n_chars") >= edits.MIN_ADDED)).alias("settled"), "n_chars",
    )
    told = edits.ordered(docs, "law_id", "text").select(
        "law_id", "start", "kind", "title", "section", F.xxhash64("old_text", "new_text", "digest").alias("texts"), edits.settled().alias("settled"), (F.length("block") + F.length("old_text") + F.length("new_text")).alias("n_chars"),
    )
    known = edits.with_sections(added.unionByName(told), sections)
    there = F.when(F.col("kind") == "ADD_NEW_SECTION", ~F.col("section_exists")).otherwise(F.col("section_exists"))
    return known.select("law_id", F.xxhash64("kind", "title", "section", "texts").alias("order"), "start", F.col("kind").isin(*DESTRUCTIVE).alias("hard"), (F.col("settled") & there).alias("sure"), "n_chars")


def counted(orders: DataFrame) -> DataFrame:
    """(law_id, n_direct, n_safe, n_unresolved, n_notes, represented) of the first of each law's orders. They are dealt out by law once."""
    firsts = [F.min_by(c, "start").alias(c) for c in ("hard", "sure", "n_chars")]
    first = orders.repartition("law_id").groupBy("law_id", "order").agg(*firsts)
    hard, sure = F.col("hard"), F.col("sure")
    return first.groupBy("law_id").agg(F.count("*").alias("n_direct"), F.count_if(hard & sure).alias("n_safe"), F.count_if(hard & ~sure).alias("n_unresolved"), F.count_if(~hard).alias("n_notes"), F.sum("n_chars").alias("represented"))


def phrase_facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In place of `low` and `low_name`, a text and its law's name in lower case: category, temporary, permanent, rider, residual. A null text
    has none. Permanent is asked for with a temporary score only, rider of appropriations, and residual where there may be `orders`."""
    for batch in batches:
        rows = []
        # By way of numpy, as to_pylist makes an object of Arrow's for each text first.
        for low, name, orders in zip(*[batch.column(c).to_numpy(zero_copy_only=False) for c in ("low", "low_name", "orders")], strict=True):
            if low is None:
                rows.append(("", 0, 0, False, False))
                continue
            category, temporary = rules.category_of(f"{name}\n{low}" if name else low), rules.weight_of(low, rules.TEMPORARY)
            permanent, rider = temporary and rules.weight_of(low, rules.PERMANENT), category == "appropriation" and rules.how_many(low, rules.RIDER) >= 2
            rows.append((category, temporary, permanent, rider, orders and rules.how_many(low, rules.RESIDUAL) > 0))
        kept = batch.drop_columns(["low", "low_name"])
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), FACT_TYPES.values(), strict=True)] if rows else [pa.array([], t) for t in FACT_TYPES.values()]
        yield pa.record_batch([*kept.columns, *columns], names=[*kept.schema.names, *FACT_TYPES])


def at_rest(docs: DataFrame, name_col: str | None = None) -> DataFrame:
    """(law_id, disposition, sure, open, residual, sections, length): the disposition of every law if it orders nothing, whether that is certain,
    and whether orders change it; for these laws, what else they say (see rules.says_more). What the result doesn't depend on isn't worked out."""
    text, status = F.coalesce("text", F.lit("")), F.col("status")
    told = F.when(F.col("incorporated"), True).when(status != "active", True).otherwise(text == "")
    facts = edits.once(docs.select("law_id", "status", "incorporated", text.alias("text"), *([name_col] if name_col else [])), told=told)
    lower = lambda c: F.when(~F.col("told"), F.lower(c))
    facts = edits.once(facts, low=lower("text"))
    facts = edits.once(facts, orders=~F.col("told") & (edits.may_add(F.col("low")) | edits.may_target(F.col("low"))))
    sections, length = (F.when(F.col("orders"), c).otherwise(0) for c in (rules.numbered_sections(F.col("text")), F.length("text")))
    facts = facts.select(
        "law_id", "status", "incorporated", (F.col("text") != "").alias("has_source"), "told", "orders", sections.alias("sections"), length.alias("length"),
        "low", (lower(name_col) if name_col else F.lit(None).cast("string")).alias("low_name"),
    )
    kind = facts.drop("low", "low_name")
    facts = facts.mapInArrow(phrase_facts, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in kind.schema)}, category string, temporary int, permanent int, rider boolean, residual boolean")
    no = F.lit(False)
    facts = edits.once(facts, disposition=patch.disposition({
        **{c: F.col(c) for c in ("incorporated", "has_source", "category", "rider", "temporary", "permanent")}, "active": F.col("status") == "active", "direct": no, "supplement": no, "unresolved": no,
    }))
    d, category = F.col("disposition"), F.col("category")
    sure = (
        F.when(d == "NONOPERATIVE_OR_REPEALED", status.isin(*CERTAIN_STATUS)).when(d == "NON_CODE", category.isin(*CERTAIN_CATEGORY) & ~((category == "appropriation") & F.col("rider")))
        .when(d == "STATUTORY_NOTE", F.col("permanent") >= F.col("temporary")).otherwise(F.lit(True))
    )
    return facts.select("law_id", "disposition", F.coalesce(sure, no).alias("sure"), (~F.col("told")).alias("open"), "residual", "sections", "length")


def classify(docs: DataFrame, sections: DataFrame, chapters: DataFrame, name_col: str | None = None) -> DataFrame:
    """(law_id, disposition, confidence, n_direct, n_safe, n_unresolved) of every law. docs: (law_id, text, status,
    incorporated), one row a law. A null or empty text is a law without a source. The words of its name, where
    there is one, count for its category as those of its text. No text is moved: what counts of it meets the law's orders."""
    numbers = ["n_direct", "n_safe", "n_unresolved", "n_notes", "represented"]
    known = at_rest(docs, name_col).join(counted(ordered(docs, sections, chapters)), "law_id", "left").na.fill(0, numbers)
    more = rules.says_more(*[F.col(c) for c in ("residual", "sections", "length", "n_direct", "represented")])
    direct = patch.disposition({
        "incorporated": F.lit(False), "active": F.lit(True), "has_source": F.lit(True), "category": F.lit(""), "direct": F.lit(True), "rider": F.lit(False), "temporary": F.lit(0), "permanent": F.lit(0),
        "supplement": more, "unresolved": (F.col("n_unresolved") > 0) | (F.col("n_notes") > 0),
    })
    changed = F.col("open") & (F.col("n_direct") > 0)
    return known.select("law_id", F.when(changed, direct).otherwise(F.col("disposition")).alias("disposition"), F.when(changed | F.col("sure"), "high").otherwise("medium").alias("confidence"), "n_direct", "n_safe", "n_unresolved")


def superseded(classified: DataFrame, edges: DataFrame) -> DataFrame:
    """classified with SUPERSEDED_BEFORE_CODIFICATION, the edge's confidence and `superseded_by` for laws that a later law in
    force repeals or supersedes, and `warnings`: edges to laws that aren't earlier (of the law that has them), and later laws that undo one
    that is incorporated already, which stays so. classified: (law_id, status, disposition, confidence), edges: (source, target, relation,
    confidence). A superseded law still overrides others; of several laws the earliest counts. The edges that count are written once: they
    come from a pass over texts, which each of their four uses would repeat."""
    at = f"{shared_folder(edges.sparkSession)}/edges-{uuid.uuid4().hex}"
    edges.where("relation in ('repeals', 'supersedes')").select("source", "target", "relation", "confidence").write.parquet(at)
    edges = edges.sparkSession.read.parquet(at)
    force = classified.select("law_id", ((F.col("status") == "active") & ~F.col("disposition").isin("NONOPERATIVE_OR_REPEALED", "SOURCE_UNAVAILABLE")).alias("active"))
    key = T.law_sort_key
    strong = edges.join(force.where("active").select(F.col("law_id").alias("source")), "source", "left_semi").join(force.select(F.col("law_id").alias("target")), "target", "left_semi")
    later = key(F.col("source")) > key(F.col("target"))
    by = match.overrides(edges, force).join(strong.select(F.col("source").alias("superseded_by"), F.col("target").alias("law_id"), F.col("confidence").alias("sure")).groupBy("superseded_by", "law_id").agg(F.min("sure").alias("sure")), ["law_id", "superseded_by"])
    not_earlier = strong.where(~later).select(F.col("source").alias("law_id"), F.concat(F.lit("not earlier: "), "relation", F.lit(" "), "target").alias("warning"))
    done = classified.where("disposition = 'ALREADY_INCORPORATED'").select(F.col("law_id").alias("target"))
    undone = strong.where(later).join(done, "target", "left_semi").select(F.col("target").alias("law_id"), F.concat(F.lit("incorporated, but "), "source", F.lit(" "), "relation", F.lit(" it")).alias("warning"))
    warnings = not_earlier.unionByName(undone).groupBy("law_id").agg(F.array_sort(F.collect_set("warning")).alias("warnings"))
    out = classified.join(by, "law_id", "left").join(warnings, "law_id", "left")
    hit = F.col("superseded_by").isNotNull() & (F.col("disposition") != "ALREADY_INCORPORATED")
    return out.withColumns({
        "superseded_by": F.when(hit, F.col("superseded_by")), "confidence": F.when(hit, F.col("sure")).otherwise(F.col("confidence")),
        "disposition": F.when(hit, "SUPERSEDED_BEFORE_CODIFICATION").otherwise(F.col("disposition")), "warnings": F.coalesce("warnings", F.array().cast("array<string>")),
    }).drop("sure")
