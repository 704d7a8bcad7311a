"""Corpus preparation as a chain of stages over `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from statuta.llm import decontaminate, near_dup, packing, quality, substrings
from statuta.llm.common import table, written

#: (name, function); each function takes (spark, docs, sf_dir).
STAGES = [
    ("quality classifier", quality.keep_good),
    ("MinHash near-dedup", near_dup.drop_near_duplicates),
    ("suffix-array dedup", substrings.remove_repeats),
    ("benchmark decontamination", decontaminate.drop_contaminated),
    ("packing", packing.packed_stage),
]

#: SQL can't express a learnt classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage; each stage's rows are written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
