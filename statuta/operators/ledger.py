"""Ledgers: controlling and latest reports, numbering, batching, ownership, rollups and exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def controlling(reports: DataFrame, key: str, preference: list[Column], tie: list[Column]) -> DataFrame:
    """One row of each key, the greatest by the preferences; `others` counts the superseded."""
    w = Window.partitionBy(key)
    ranked = reports.withColumns({"_n": F.row_number().over(w.orderBy(*[p.desc() for p in preference], *tie)), "others": F.count("*").over(w) - 1})
    return ranked.where("_n = 1").drop("_n")


def latest_valid(reviews: DataFrame, key: str = "law_id") -> DataFrame:
    """The valid review of the greatest group; of equals the later row."""
    pick = F.struct("group_index", "ord")
    best = reviews.where("status = 'valid'").groupBy(key).agg(F.max_by(F.struct(*[c for c in reviews.columns if c != key]), pick).alias("r"))
    return best.select(key, "r.*")


def numbered(rows: DataFrame, group: str, order: list[str], prefix: str = "ACTION-", width: int = 4) -> DataFrame:
    """Numbers rows in one total order without one task over all of them: rows are numbered within each
    group, and a group's offset is the size of the groups before it, from one row a group."""
    inside = rows.withColumn("_i", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    sizes = rows.groupBy(group).agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = inside.join(sizes.withColumn("_before", before), group).withColumn("number", F.col("_before") + F.col("_i"))
    text = F.col("number").cast("string")
    padded = F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)
    return out.withColumn("label", F.concat(F.lit(prefix), padded)).drop("_i", "_size", "_before")


def batches(rows: DataFrame, group: str, order: list[str], size: int, parts: int) -> DataFrame:
    """Adds batch (of a fixed size) and part (an even split, first parts larger) within each group."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumns({"batch": F.floor((F.row_number().over(w) - 1) / size) + 1, "part": F.ntile(parts).over(w)})


def node_ownership(events: DataFrame) -> DataFrame:
    """(node_id, law_id, decision) for each law's own claim on a node. events: (node_id, law_id, idx, active).
    A later active action of the same law keeps the node, another active owner is a conflict, else the node
    is removed."""
    node, own = Window.partitionBy("node_id"), Window.partitionBy("node_id", "law_id")
    out = events.withColumns({
        "last_own": F.max("idx").over(own), "own_active": F.max(F.when(F.col("active"), F.col("idx"))).over(own),
        "active_laws": F.size(F.collect_set(F.when(F.col("active"), F.col("law_id"))).over(node)), "own_is_active": F.max(F.col("active").cast("int")).over(own),
    })
    decision = F.when(F.col("own_active") == F.col("last_own"), "keep").when(F.col("active_laws") - F.col("own_is_active") > 0, "conflict").otherwise("remove")
    return out.select("node_id", "law_id", decision.alias("decision")).distinct()


def exceptions(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(rule, n, first_key): how many rows break each rule, and the smallest of them. One pass."""
    flagged = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))
    hit = rows.select(key, F.explode(flagged).alias("rule"))
    return hit.groupBy("rule").agg(F.count("*").alias("n"), F.min(key).alias("first_key"))


def capped_summary(items: Column, limit: int = 5) -> Column:
    """The first `limit` distinct items, and how many more there are."""
    distinct = F.array_sort(F.array_distinct(items))
    said = F.array_join(F.slice(distinct, 1, limit), " | ")
    return F.when(F.size(distinct) > limit, F.concat(said, F.lit(" | "), (F.size(distinct) - limit).cast("string"), F.lit(" additional"))).otherwise(said)


def merged_runs(stored: DataFrame, new: DataFrame, key: str, run: str) -> DataFrame:
    """The stored records with those of a new run in their place: the greatest run of each key."""
    both = stored.unionByName(new)
    return both.groupBy(key).agg(F.max_by(F.struct(*[c for c in both.columns if c != key]), run).alias("r")).select(key, "r.*")
