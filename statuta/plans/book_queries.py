"""Published chunks of sections."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import chunks
from .base import query

_CONTENT = "'<section identifier=\"' || identifier || '\"><heading>' || heading || '</heading><content>' || body || '</content></section>'"
_NUMBERED = f"(select title, identifier, {_CONTENT} as content, row_number() over (partition by title order by cast(section as bigint), section) as ordinal, regexp_replace(split_part(identifier, '/', -1), '[^A-Za-z0-9_.-]+', '_', 'g') as base from {{sections}})"
_NAME = "lpad(ordinal::varchar, 5, '0') || '-' || base || '.xml'"


def _written(sections):
    rows = sections.withColumn("content", F.expr(_CONTENT))
    path = f"{chunks.shared_folder(sections.sparkSession)}/book-{uuid.uuid4().hex}"
    return path, chunks.write_chunks(rows, path, [F.col("section").cast("long"), F.col("section")])


@query(f"select title, count(*) as sections, sum(strlen(content))::bigint as bytes, min({_NAME}) as first_name, max({_NAME}) as last_name from {_NUMBERED} group by title")
def snk8_section_chunks(sections):
    path, version = _written(sections)
    return chunks.publish(sections.sparkSession, path, version).select("title", "sections", "bytes", "first_name", "last_name")


@query(f"select title, {_NAME} as name, identifier, sha256(content) as sha256 from {_NUMBERED}")
def snk8_chunks_read_back(sections):
    spark = sections.sparkSession
    path, version = _written(sections)
    chunks.publish(spark, path, version)
    return chunks.read_chunks(spark, chunks.published(spark, path)).select("title", "name", "identifier", F.sha2("content", 256).alias("sha256"))


@query(f"""select title, name, case when ordinal % 5 = 0 then 'missing' when ordinal % 5 = 1 then 'changed' else 'twice' end as state from (select *, {_NAME} as name from {_NUMBERED}) where ordinal % 5 in (0, 1, 2)
 union all select title, 'extra-' || {_NAME}, 'extra' from {_NUMBERED} where ordinal % 5 = 3""")
def snk8_broken_chunks(sections):
    spark = sections.sparkSession
    _, version = _written(sections)
    kept = chunks.read_chunks(spark, version).withColumn("m", F.col("ordinal") % 5)
    tampered = kept.where("m <> 0").withColumn("content", F.when(F.col("m") == 1, F.concat("content", F.lit(" "))).otherwise(F.col("content")))
    more = kept.where("m = 2").unionByName(kept.where("m = 3").withColumn("name", F.concat(F.lit("extra-"), "name")))
    return chunks.broken(chunks.read_index(spark, version), tampered.unionByName(more))
