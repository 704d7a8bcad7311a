"""The book of chunks: numbers, proof and what isn't published."""

import pytest
from pyspark.sql import functions as F

from statuta.sources import chunks


def book(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "title int, identifier string, content string, n int").repartition(3)
    path = str(tmp_path / "book")
    return path, chunks.write_chunks(df, path, [F.col("n")])


def test_numbers_run_through_partitions(spark, tmp_path):
    rows = [(1, f"/us/usc/t1/s{i} x", f"text {i}", i) for i in range(200)] + [(2, None, None, 1), (2, "/us/usc/t2/._", "", 2), (3, "a/é", "é", 1)]
    path, version = book(spark, tmp_path, rows)
    told = {r.title: r for r in chunks.publish(spark, path, version).collect()}
    assert (told[1].sections, told[1].first_name, told[1].last_name, told[2].last_name, told[3].bytes) == (200, "00001-s0_x.xml", "00200-s199_x.xml", "00002-section-00002.xml", 2)
    back = chunks.read_chunks(spark, chunks.published(spark, path))
    assert [r.content for r in back.where("title = 1").orderBy("ordinal").collect()] == [f"text {i}" for i in range(200)]
    assert [r.name for r in back.where("title in (2, 3)").orderBy("title", "ordinal").collect()] == ["00001-section-00001.xml", "00002-section-00002.xml", "00001-_.xml".replace("_", "section-00001")]


def test_a_broken_version_is_not_published(spark, tmp_path):
    path, version = book(spark, tmp_path, [(1, f"s{i}", f"t{i}", i) for i in range(9)])
    chunks.publish(spark, path, version)
    _, second = book(spark, tmp_path, [(1, f"s{i}", f"u{i}", i) for i in range(9)])
    kept = chunks.read_chunks(spark, second).where("ordinal <> 4").collect()
    spark.createDataFrame(kept, "ordinal long, name string, identifier string, content string, title int").write.mode("overwrite").partitionBy("title").parquet(f"{second}/chunks")
    with pytest.raises(ValueError, match="missing"):
        chunks.publish(spark, path, second)
    assert chunks.published(spark, path) == version


def test_no_sections(spark, tmp_path):
    path, version = book(spark, tmp_path, [])
    assert chunks.publish(spark, path, version).count() == 0
