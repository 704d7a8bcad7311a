"""Board exports, marked-up titles, review reports and law folders as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOARD = """lists array<struct<id:string,name:string>>,
 cards array<struct<id:string,shortLink:string,name:string,desc:string,idList:string,labels:array<struct<name:string>>,closed:boolean,dateLastActivity:string,
  attachments:array<struct<id:string,name:string,url:string,mimeType:string,date:string>>,url:string>>,
 actions array<struct<type:string,date:string,data:struct<card:struct<id:string>,attachment:struct<id:string,name:string,url:string>>>>"""


def board(spark: SparkSession, path: str) -> DataFrame:
    """One row a board export; the schema is given, nothing is inferred."""
    return spark.read.schema(BOARD).option("multiLine", True).json(path)


def cards_from_board(boards: DataFrame, *more: str) -> DataFrame:
    """One row a card: list id to list name (missing: UNKNOWN), blank labels dropped."""
    lists = F.map_from_entries(F.transform("lists", lambda x: F.struct(x["id"], x["name"])))
    rows = boards.select(*more, lists.alias("names"), F.explode("cards").alias("c"))
    labels = F.filter(F.transform("c.labels", lambda x: x["name"]), lambda n: F.trim(n) != "")
    return rows.select(
        F.col("c.id").alias("card_id"), F.col("c.name").alias("name"), F.coalesce(F.col("names")[F.col("c.idList")], F.lit("UNKNOWN")).alias("list_name"), F.array_join(F.coalesce(labels, F.array().cast("array<string>")), " | ").alias("label"),
        F.left("c.dateLastActivity", F.lit(10)).try_cast("date").alias("last_activity"), F.coalesce("c.desc", F.lit("")).alias("description"),
        F.coalesce(F.nullif(F.col("c.url"), F.lit("")), F.concat(F.lit("https://example.test/c/"), "c.shortLink")).alias("url"), *more,
    )


def counted_cards(boards: DataFrame) -> DataFrame:
    """What cards_from_board gives, with the number of a card's different attachment addresses, counted in the export's own row, so that it
    works on a stream."""
    rows = boards.select("*", F.posexplode("cards").alias("_n", "_c"))
    own = F.transform("_c.attachments", lambda a: a["url"])
    later = F.transform(F.filter("actions", lambda a: (a["type"] == "addAttachmentToCard") & (a["data"]["card"]["id"] == F.col("_c.id"))), lambda a: a["data"]["attachment"]["url"])
    none = F.array().cast("array<string>")
    n = F.size(F.array_distinct(F.filter(F.concat(F.coalesce(own, none), F.coalesce(later, none)), lambda u: u != ""))).cast("long")
    return cards_from_board(rows.select("lists", F.array("_c").alias("cards"), n.alias("n_attachments")), "n_attachments")


def board_attachments(boards: DataFrame) -> DataFrame:
    """(card_id, ordinal, name, url, source): a card's own attachments, then those of its events."""
    own = boards.select(F.explode("cards").alias("c")).select(F.col("c.id").alias("card_id"), F.posexplode("c.attachments").alias("ordinal", "a"), F.lit("board").alias("source"))
    events = F.filter("actions", lambda a: a["type"] == "addAttachmentToCard")
    later = boards.select(F.posexplode(events).alias("ordinal", "e")).select(F.col("e.data.card.id").alias("card_id"), (F.col("ordinal") + 1_000_000).alias("ordinal"), F.struct("e.data.attachment.id", "e.data.attachment.name", "e.data.attachment.url").alias("a"), F.lit("action").alias("source"))
    pick = lambda df: df.select("card_id", "ordinal", F.coalesce("a.name", F.lit("")).alias("name"), F.coalesce("a.url", F.lit("")).alias("url"), "source")
    return pick(own).unionByName(pick(later))


def sections(spark: SparkSession, path: str) -> DataFrame:
    """(identifier, heading, reserved) of every section of marked-up titles. The schema is given, since
    inference fails on mixed content."""
    rows = spark.read.format("xml").option("rowTag", "section").schema("_identifier string, num string, heading string").load(path)
    heading = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("heading", F.lit("")), "<[^>]+>", " "), r"\s+", " "))
    return rows.where("_identifier is not null").select(F.col("_identifier").alias("identifier"), F.coalesce("num", F.lit("")).alias("num"), heading.alias("heading"), F.lower(heading).isin("repealed", "reserved", "[repealed]", "[reserved]").alias("reserved"))


def title_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(file, kind, identifier, number, heading) of each title file; a pointer file is only marked."""
    text = spark.read.text(path, wholetext=True).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    kind = F.when(F.col("value").startswith("version https://git-lfs"), "pointer").otherwise("text")
    plain = F.when(kind == "text", F.regexp_replace("value", r"^\s*<\?xml[^>]*\?>", ""))
    take = lambda p: F.when(plain.isNotNull(), F.xpath_string(plain, F.lit(p)))
    return text.select("file", kind.alias("kind"), take("//title/@identifier").alias("identifier"), take("//docNumber").alias("number"), F.coalesce(F.nullif(take("//title/heading"), F.lit("")), take("//*[local-name()='title' and not(@identifier)]")).alias("heading"))


STRUCTURAL = ("title", "subtitle", "part", "subpart", "division", "chapter", "subchapter", "article", "appendix", "section", "subsection", "paragraph")


def structure(spark: SparkSession, path: str) -> DataFrame:
    """(file, node, parent, ordinal, depth, type, identifier) of the structural elements, one file a task:
    the tree of a file streams, and only its nodes come out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io
        import xml.etree.ElementTree as ET

        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                out, stack, n = [], [], 0
                for event, element in ET.iterparse(io.BytesIO(content), events=("start", "end")):
                    tag = element.tag.rpartition("}")[2]
                    if tag in STRUCTURAL:
                        if event == "start":
                            out.append((file, n, stack[-1] if stack else None, n, len(stack), tag, element.get("identifier")))
                            stack.append(n)
                            n += 1
                        else:
                            stack.pop()
                    if event == "end":
                        element.clear()
                if out:
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["file", "node", "parent", "ordinal", "depth", "type", "identifier"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, node long, parent long, ordinal long, depth int, type string, identifier string")


def reports(spark: SparkSession, path: str) -> DataFrame:
    """(file, group_index, report VARIANT): review reports of any shape. What doesn't parse is an empty
    report, not a failure; a repair report's index is 1000 + base * 10 + part."""
    text = spark.read.text(path, wholetext=True).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    part = lambda i: F.regexp_extract("file", r"(?:review|repair)-(\d+)(?:-(\d+))?\.json$", i)
    index = F.when(F.col("file").startswith("repair"), 1000 + part(1).try_cast("int") * 10 + F.coalesce(part(2).try_cast("int"), F.lit(0))).otherwise(part(1).try_cast("int"))
    return text.select("file", index.alias("group_index"), F.coalesce(F.try_parse_json("value"), F.parse_json(F.lit("{}"))).alias("report"))


def report_laws(found: DataFrame) -> DataFrame:
    """(file, group_index, law_id, status, treatment) from the laws of each report, by the names that
    reports use for them."""
    sql = "select file, group_index, value from {found}, lateral variant_explode(try_variant_get(report, '$.laws', 'variant'))"
    laws = found.sparkSession.sql(sql, found=found)
    first = lambda *names: F.coalesce(*[F.nullif(F.trim(F.try_variant_get("value", f"$.{n}", "string")), F.lit("")) for n in names], F.lit(""))
    return laws.select("file", "group_index", first("law_id", "law", "id").alias("law_id"), first("status", "legal_status", "current_status", "conclusion").alias("status"), first("treatment", "approved_treatment", "code_treatment").alias("treatment"))


def law_files(spark: SparkSession, path: str) -> DataFrame:
    """(law_id, file, format, size, sha256) of the files of law folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.regexp_extract("path", r"(PL-\d+-\d+)", 1).alias("law_id"), name.alias("file"), F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)).alias("format"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def staged_publish(df: DataFrame, target: str, checks: dict) -> str:
    """Writes a new version beside the old ones, and points to it only if every check (a function from the
    written rows to a count of failures) gives 0. The pointer is a one-row table, replaced last."""
    import uuid

    spark, version = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{target}/versions/{version}")
    staged = spark.read.parquet(f"{target}/versions/{version}")
    broken = {name: n for name, f in checks.items() if (n := f(staged))}
    if broken:
        raise ValueError(f"not published: {broken}")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").parquet(f"{target}/current")
    return version


def published(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(f"{target}/versions/{spark.read.parquet(f'{target}/current').first().version}")
