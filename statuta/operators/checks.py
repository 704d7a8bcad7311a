"""A constraint framework: rules are conditions, failures are rows, gates are counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def failures(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) of every broken rule; a rule is a condition that must hold, null counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]))
    return df.select(key, F.explode(broken).alias("rule"))


def gate(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """One row a rule: how many rows break it, and whether it passes."""
    names = df.sparkSession.createDataFrame([(n,) for n in rules], "rule string")
    counts = failures(df, key, rules).groupBy("rule").agg(F.count("*").alias("broken"))
    return names.join(counts, "rule", "left").select("rule", F.coalesce("broken", F.lit(0)).alias("broken"), F.col("broken").isNull().alias("passed"))


def duplicated(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def set_mismatch(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one side has, with `side`."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def forbidden(notes: DataFrame, key: str, text_col: str, tokens: list[str]) -> DataFrame:
    """(key, token): the first forbidden token each text holds, in the order given."""
    low = F.lower(text_col)
    first = F.coalesce(*[F.when(low.contains(t.lower()), F.lit(t)) for t in tokens])
    return notes.select(key, first.alias("token")).where("token is not null")
