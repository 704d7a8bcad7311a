"""A published book of section chunks: an ordered chunk a section, partitioned by title, an index of their digests and a
manifest of counts. What is written is read back and proved before it counts as published.

A title's chunks are numbered in document order by two passes: rows are ranged and numbered within their partition, and a
partition's offset in a title is the sum over one row for each partition before it. So neither a title nor the book is in
one task. Chunks are rows of Parquet under title=..., with the file name each would have, as a file a section doesn't
suit a store of many millions.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; a folder of its own where that is unset and Spark runs on this machine alone."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return at or tempfile.mkdtemp(prefix="statuta-")


def file_name(ordinal: Column, identifier: Column) -> Column:
    """The number in five digits or more, and the identifier's last part without characters that files may not have."""
    base = F.btrim(F.regexp_replace(F.element_at(F.split(F.coalesce(identifier, F.lit("")), "/"), -1), "[^A-Za-z0-9_.-]+", "_"), F.lit("._"))
    digits = F.lpad(ordinal.cast("string"), F.greatest(F.lit(5), F.length(ordinal.cast("string"))), F.lit("0"))
    return F.concat(digits, F.lit("-"), F.when(base == "", F.concat(F.lit("section-"), digits)).otherwise(base), F.lit(".xml"))


def ordinals(staged: DataFrame) -> DataFrame:
    """staged (title, part, place, ...) with `ordinal`: its number in the title, by part and place."""
    sizes = staged.groupBy("title", "part").agg(F.count("*").alias("_n"), F.min("place").alias("_first"))
    before = Window.partitionBy("title").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return staged.join(offsets, ["title", "part"]).withColumn("ordinal", F.col("_before") + F.col("place") - F.col("_first") + 1).drop("_n", "_first", "_before")


def write_chunks(sections: DataFrame, path: str, order: list[Column], source_hash: Column | None = None) -> str:
    """Writes sections (title, identifier, content) as a new version under `path` and gives its folder. Order must tell a title's sections apart;
    equal ones are in any order. source_hash: a digest of what a section was made from, by default of its content."""
    version = f"{path}/versions/{uuid.uuid4().hex}"
    spark = sections.sparkSession
    keys = [F.col("title"), *order]
    ranged = sections.select("title", "identifier", F.coalesce("content", F.lit("")).alias("content"), (source_hash if source_hash is not None else F.sha2(F.coalesce("content", F.lit("")), 256)).alias("source_sha256"), *[c.alias(f"_k{i}") for i, c in enumerate(order)])
    by = ["title", *[f"_k{i}" for i in range(len(order))]]
    # Number the rows once and write them: what follows reads the same partitions and places.
    ranged.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by).select(
        "title", "identifier", "content", "source_sha256", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")
    ).write.parquet(f"{version}/staged")
    staged = spark.read.parquet(f"{version}/staged")
    named = ordinals(staged).withColumn("name", file_name(F.col("ordinal"), F.col("identifier")))
    named.select("title", "ordinal", "name", "identifier", "content").write.partitionBy("title").parquet(f"{version}/chunks")
    index = named.select("title", "ordinal", "name", "identifier", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size"), "source_sha256")
    index.write.parquet(f"{version}/index")
    return version


def read_chunks(spark: SparkSession, version: str, title_type: str = "int") -> DataFrame:
    return spark.read.schema(f"ordinal long, name string, identifier string, content string, title {title_type}").parquet(f"{version}/chunks")


def read_index(spark: SparkSession, version: str) -> DataFrame:
    return spark.read.parquet(f"{version}/index")


def manifest(index: DataFrame) -> DataFrame:
    """A row a title: sections, bytes, first and last name, and an order-free digest of the chunks' and of their sources' digests."""
    bits = lambda c: F.expr(f"bit_xor(xxhash64(name, {c}))")
    return index.groupBy("title").agg(F.count("*").alias("sections"), F.sum("size").alias("bytes"), F.min("name").alias("first_name"), F.max_by("name", "ordinal").alias("last_name"), bits("sha256").alias("digest"), bits("source_sha256").alias("source_digest"))


def broken(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """(title, name, state) of every chunk that is missing, extra, twice or changed, and of every title whose numbers have a gap (name null)."""
    there = chunks.groupBy("title", "name").agg(F.count("*").alias("n"), F.min(F.sha2("content", 256)).alias("is"), F.max(F.sha2("content", 256)).alias("also"))
    both = index.select("title", "name", F.col("sha256").alias("was")).join(there, ["title", "name"], "full_outer")
    state = F.when(F.col("n").isNull(), "missing").when(F.col("was").isNull(), "extra").when(F.col("n") > 1, "twice").when(F.col("is") != F.col("was"), "changed")
    gaps = index.groupBy("title").agg(F.count("*").alias("n"), F.countDistinct("ordinal").alias("d"), F.min("ordinal").alias("low"), F.max("ordinal").alias("high")).where("n <> d or low <> 1 or high <> n")
    return both.withColumn("state", state).where("state is not null").select("title", "name", "state").unionByName(gaps.select("title", F.lit(None).cast("string").alias("name"), F.lit("numbers").alias("state")))


def publish(spark: SparkSession, path: str, version: str, title_type: str = "int") -> DataFrame:
    """Proves a version by reading it back, writes its manifest, and only then points `path` to it."""
    index = read_index(spark, version)
    wrong = broken(index, read_chunks(spark, version, title_type)).limit(5).collect()
    if wrong:
        raise ValueError(f"not published: {[tuple(r) for r in wrong]}")
    manifest(index).write.parquet(f"{version}/manifest")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").parquet(f"{path}/current")
    return spark.read.parquet(f"{version}/manifest")


def published(spark: SparkSession, path: str) -> str:
    """The folder of the version that counts."""
    return spark.read.schema("version string").parquet(f"{path}/current").first().version
