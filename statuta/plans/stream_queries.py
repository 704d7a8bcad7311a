"""Streams over the given tables in several batches, with restarts and new checkpoints."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources.chunks import shared_folder
from ..streaming import keyed
from .base import query
from .ledger_queries import _CANONICAL

_SAID = "select concat(event_type, ':', user_id) as marker, event_type || ' by ' || user_id as text from {events}"


def _folder(df):
    return f"{shared_folder(df.sparkSession)}/stream-{uuid.uuid4().hex}"


@query(f"select law_id, card_id, status, n_attachments, duplicates, last_activity::varchar as last_activity from ({_CANONICAL})")
def sm1_intake_stream(cards, attachments):
    """Three turns of one checkpoint: each is a restart that meets the cards of the turns before."""
    n = attachments.where("url <> ''").groupBy("card_id").agg(F.count_distinct("url").alias("n_attachments"))  # as many as `C.first_url_wins` keeps
    rows = cards.join(n, "card_id", "left").na.fill(0, ["n_attachments"])
    at = _folder(cards)
    turn = F.pmod(F.xxhash64("card_id"), F.lit(3))
    keyed.in_batches(rows, f"{at}/in", [turn == i for i in range(3)], lambda stream, _: keyed.competing_cards(stream, f"{at}/out", f"{at}/checkpoint"))
    return keyed.current(cards.sparkSession, f"{at}/out").select("law_id", "card_id", "status", "n_attachments", "duplicates", "last_activity")


@query(f"select marker, min(text) as text, 1 as n from ({_SAID}) group by marker")
def sm2_outbox_stream(events):
    """A first run, a restart, and then a new checkpoint over all that has landed: nothing is said twice."""
    marker = F.concat("event_type", F.lit(":"), F.col("user_id").cast("string"))
    rows = events.select(marker.alias("marker"), F.concat("event_type", F.lit(" by "), F.col("user_id").cast("string")).alias("text"), F.col("event_id").alias("turn"))
    at = _folder(events)
    keyed.in_batches(rows, f"{at}/in", [F.pmod("turn", F.lit(3)) == i for i in range(3)], lambda stream, n: keyed.say_once(stream, f"{at}/out", f"{at}/checkpoint-{n // 2}"))
    return keyed.said(events.sparkSession, f"{at}/out").groupBy("marker", "text").agg(F.count("*").cast("int").alias("n"))
