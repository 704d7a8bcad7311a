"""From drafts to published text: which plans may be approved, whether their targets still stand as approved, and whether
what was published can be found. Requests, plans and operations meet by law; null laws match nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import markup


def promote(requests: DataFrame, plans: DataFrame, operations: DataFrame) -> DataFrame:
    """(law_id, state, reason) of each request (law_id, confirmed). plans: (law_id, status, summary, source_sha256), one a law, the
    smallest of several; operations: (law_id, ...). The first reason counts: no plan, not a draft, blank summary, no operations, or
    a confirmed hash that isn't the plan's. A request that confirms none (null or blank) isn't held by the hash."""
    one = plans.groupBy("law_id").agg(F.min(F.struct("status", "summary", "source_sha256")).alias("p")).select("law_id", "p.*", F.lit(True).alias("there"))
    counted = operations.groupBy("law_id").agg(F.count("*").alias("n"))
    rows = requests.join(one, "law_id", "left").join(counted, "law_id", "left")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    reason = (
        F.when(F.col("there").isNull(), "no plan").when(~F.col("status").eqNullSafe("draft"), "not a draft").when(blank("summary"), "blank summary").when(F.coalesce("n", F.lit(0)) == 0, "no operations")
        .when(~blank("confirmed") & ~F.col("confirmed").eqNullSafe(F.col("source_sha256")), "source hash differs").otherwise("")
    )
    state = F.when(reason == "", "approved").when(reason == "no plan", "missing").otherwise(F.coalesce("status", F.lit("")))
    return rows.select("law_id", state.alias("state"), reason.alias("reason"))


def expect_targets(promoted: DataFrame, operations: DataFrame, sections: DataFrame) -> DataFrame:
    """(law_id, identifier, expected): the digest of each target of an approved plan as it stands now; null where there is none."""
    approved = promoted.where("state = 'approved'").select("law_id").distinct()
    targets = operations.join(approved, "law_id", "left_semi").select("law_id", "identifier").distinct()
    return targets.join(sections.select("identifier", F.sha2("body", 256).alias("expected")), "identifier", "left").select("law_id", "identifier", "expected")


def moved(expected: DataFrame, sections: DataFrame) -> DataFrame:
    """(law_id, identifier, how) of the targets that no longer stand as they did: `changed`, `gone` or `new`."""
    now = sections.select("identifier", F.sha2("body", 256).alias("now"))
    rows = expected.join(now, "identifier", "left").where(~F.col("expected").eqNullSafe(F.col("now")))
    how = F.when(F.col("now").isNull(), "gone").when(F.col("expected").isNull(), "new").otherwise("changed")
    return rows.select("law_id", "identifier", how.alias("how"))


def unpublished(laws: DataFrame, files: DataFrame) -> DataFrame:
    """(law_id, file) of the laws that their file doesn't show. laws: (law_id, title, file, marker). A law shows by a node with its
    marker, or by its name together with its title. Only laws without a marker meet the texts, each file's text in its own row. Spark takes what comes
    out of files for as small as what they were made of and would ship all of it to each executor, so the joins say to meet by key."""
    rows = markup.index(files)
    at = lambda kind, name: rows.where(kind).select("file", F.col("value").alias(name)).distinct().hint("merge")
    unmarked = laws.join(at(F.col("kind") == "node", "marker"), ["file", "marker"], "left_anti")
    named = unmarked.join(at((F.col("kind") == "law") & (F.col("part") == "name"), "law_id"), ["file", "law_id"], "left_semi")
    shown = named.join(files.select("file", "content").hint("merge"), "file").where(F.col("content").contains(F.col("title"))).select("file", "law_id", "marker")
    return unmarked.join(shown.hint("merge"), ["file", "law_id", "marker"], "left_anti").select("law_id", "file")
