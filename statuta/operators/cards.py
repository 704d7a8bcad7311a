"""Cards of a board: law identity, status, canonical card, pooled attachments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import rules


def identified(cards: DataFrame) -> DataFrame:
    """Adds law_id, congress, number, title and status to cards (name, description, list_name, label)."""
    law = T.bound(F.struct("name", "description"), lambda c: T.extract_law_number(c["name"], c["description"]))
    out = cards.withColumn("_law", law)
    return out.select(
        *cards.columns, "_law.law_id", "_law.congress", "_law.number", T.title_from_card_name(F.col("name")).alias("title"),
        rules.status(F.col("list_name"), F.col("label"), F.col("name"), F.col("description")).alias("status"),
    )


def suspected_unparsed(cards: DataFrame) -> DataFrame:
    """Cards without a law number that still look like enactments."""
    said = F.lower(F.concat_ws("\n", "name", "description"))
    return cards.where("law_id is null").where(said.contains("public law") | said.contains("be it enacted") | F.col("name").rlike(r"^\s*[0-9]{1,3}\s*[-–—]\s*[0-9]{1,4}"))


def canonical(cards: DataFrame) -> DataFrame:
    """One card a law: the best by status, number of attachments, length of description and last activity,
    then by card_id; `duplicates` counts the others. cards need n_attachments."""
    order = [rules.status_rank(F.col("status")).desc(), F.col("n_attachments").desc(), F.length("description").desc(), F.col("last_activity").desc(), F.col("card_id")]
    by_law = Window.partitionBy("law_id")
    ranked = cards.where("law_id is not null").withColumns({"_rank": F.row_number().over(by_law.orderBy(*order)), "duplicates": F.count("*").over(by_law) - 1})
    return ranked.where("_rank = 1").drop("_rank")


def first_url_wins(attachments: DataFrame) -> DataFrame:
    """Drops empty addresses and keeps the first of each (card, url) in ordinal order. Ties by name."""
    w = Window.partitionBy("card_id", "url").orderBy("ordinal", "name", "added", "source", "part_no")
    return attachments.where("url <> ''").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def description_links(cards: DataFrame) -> DataFrame:
    """Addresses in descriptions as attachments: (card_id, n, url, name)."""
    found = cards.select("card_id", F.posexplode(F.regexp_extract_all("description", F.lit(T.URL_PATTERN), F.lit(0))).alias("n", "raw"))
    url = F.rtrim(F.col("raw"), F.lit(".,;"))
    return found.select("card_id", (F.col("n") + 1).alias("n"), url.alias("url"), F.element_at(F.split(F.substring_index(url, "?", 1), "/"), -1).alias("name"))


def ranked_attachments(attachments: DataFrame) -> DataFrame:
    """Adds points and the rank of each attachment within its card."""
    scored = attachments.withColumn("points", rules.attachment_points(F.col("name"), F.col("url"), F.col("source")))
    w = Window.partitionBy("card_id").orderBy(F.col("points").desc(), F.col("added").desc(), "url", "ordinal", "name", "part_no")
    return scored.withColumn("rank", F.row_number().over(w))
