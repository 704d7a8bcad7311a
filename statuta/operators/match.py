"""Joins: existence guards, best section, back-off, overrides, coverage and diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def with_existence(ops: DataFrame, sections: DataFrame) -> DataFrame:
    """Adds section_exists: whether (title, section) is in the statute book."""
    known = sections.select("title", "section").distinct().withColumn("_known", F.lit(True))
    return ops.join(known, ["title", "section"], "left").withColumn("section_exists", F.coalesce("_known", F.lit(False))).drop("_known")


def resolve_section(wanted: DataFrame, sections: DataFrame) -> DataFrame:
    """(want_id, title, asked, section): the section asked for, or without its last `-part`s one after
    another, in the spelling the statute book has; null where none is known."""
    parts = F.split("asked", "-")
    tries = wanted.select("want_id", "title", "asked", F.posexplode(F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "-"))).alias("rank", "try"))
    known = sections.groupBy("title", F.lower("section").alias("key")).agg(F.min("section").alias("section"))
    hit = tries.withColumn("key", F.lower("try")).join(known, ["title", "key"])
    best = hit.groupBy("want_id").agg(F.min_by("section", "rank").alias("section"))
    return wanted.join(best, "want_id", "left")


def overrides(edges: DataFrame, laws: DataFrame) -> DataFrame:
    """(law_id, superseded_by) of laws that a later active law repeals or supersedes. edges: (source,
    target, relation); laws: (law_id, active). Of several the earliest counts, as the last to be applied
    from newest to oldest."""
    key = T.law_sort_key
    strong = edges.where("relation in ('repeals', 'supersedes')")
    by = strong.join(laws.where("active").select(F.col("law_id").alias("source")), "source").join(laws.select(F.col("law_id").alias("target")), "target")
    later = by.where(key(F.col("source")) > key(F.col("target")))
    return later.groupBy(F.col("target").alias("law_id")).agg(F.min_by("source", key(F.col("source"))).alias("superseded_by"))


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: how many keys both sides, only the left and only the right have."""
    a, b = (df.select(key).distinct().withColumn(name, F.lit(True)) for df, name in ((left, "l"), (right, "r")))
    both = a.join(b, key, "full_outer")
    return both.agg(F.count_if(F.expr("l and r")).alias("in_both"), F.count_if(F.expr("l and r is null")).alias("only_left"), F.count_if(F.expr("l is null and r")).alias("only_right"))


def plan_vs_results(plan: DataFrame, results: DataFrame, key: str = "action_id") -> DataFrame:
    """(key, planned, found, state) where state is matched, missing, extra or duplicate."""
    a = plan.groupBy(key).agg(F.count("*").alias("planned"))
    b = results.groupBy(key).agg(F.count("*").alias("found"))
    both = a.join(b, key, "full_outer").na.fill(0, ["planned", "found"])
    state = F.when(F.col("found") == 0, "missing").when(F.col("planned") == 0, "extra").when((F.col("planned") > 1) | (F.col("found") > 1), "duplicate").otherwise("matched")
    return both.withColumn("state", state)


def baseline_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): added, removed, changed or same, by a digest of the value."""
    digest = lambda df, name: df.select(key, F.sha2(F.col(value).cast("string"), 256).alias(name))
    both = digest(old, "was").join(digest(new, "is"), key, "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "changed").otherwise("same")
    return both.select(key, change.alias("change"))


def target_overlap(actions: DataFrame) -> DataFrame:
    """Targets that more than one law acts on: (identifier, n_laws, laws)."""
    hit = actions.groupBy("identifier").agg(F.array_sort(F.collect_set("law_id")).alias("laws"))
    return hit.where(F.size("laws") > 1).select("identifier", F.size("laws").cast("long").alias("n_laws"), F.array_join("laws", ",").alias("laws"))


def consolidate(source: DataFrame, known: DataFrame, strict: list[str], loose: list[str], key: str) -> DataFrame:
    """(key, match, reason) of each source row: exact on the strict columns, else the first on the loose
    ones, else unmatched. match is the smallest key of the known rows."""
    exact = known.groupBy(*strict).agg(F.min(key).alias("match"))
    first = source.join(exact, strict, "left_semi").join(exact, strict).select(source[key], "match", F.lit("exact").alias("reason"))
    rest = source.join(exact, strict, "left_anti")
    near = known.groupBy(*loose).agg(F.min(key).alias("match"))
    second = rest.join(near, loose, "left").select(rest[key], "match", F.when(F.col("match").isNull(), "unmatched").otherwise("loose").alias("reason"))
    return first.unionByName(second)


def expand_titlewide(targets: DataFrame) -> DataFrame:
    """(law_id, title, section): a target that names only a title gives way to the law's sections there."""
    whole, single = targets.where("section = ''"), targets.where("section <> ''")
    kept = whole.join(single, ["law_id", "title"], "left_anti")
    return single.unionByName(kept.select(single.columns)).distinct()


def claim_containment(claims: DataFrame, containers: DataFrame, need: int, min_length: int = 4, first: int = 20) -> DataFrame:
    """(claim_id, container_id, hits): containers that hold `need` of the claim's first distinct long words,
    or all where there are fewer. An equi join on words; words are distinct on both sides."""
    words = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) >= min_length))
    asked = claims.select("claim_id", F.slice(words("claim"), 1, first).alias("w")).select("claim_id", F.least(F.lit(need), F.size("w")).alias("need"), F.explode("w").alias("word"))
    held = containers.select("container_id", F.explode(words("content")).alias("word"))
    hits = asked.join(held, "word").groupBy("claim_id", "container_id").agg(F.count("*").alias("hits"), F.first("need").alias("need"))
    return hits.where("hits >= need").select("claim_id", "container_id", "hits")


def neighbours(sections: DataFrame, by: str, order: str, key: str) -> DataFrame:
    """Adds prev_key and next_key within `by` in document order."""
    w = Window.partitionBy(by).orderBy(order)
    return sections.withColumns({"prev_key": F.lag(key).over(w), "next_key": F.lead(key).over(w)})
