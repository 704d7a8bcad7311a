"""Streams with keyed state: the cards of each law compete with all that were seen before, and each comment is said once.

State lives in the state store by key (law or marker). A card or id has no call to the store of its own: they are kept in chunks of
up to CHUNK (and about CHUNK_CHARS characters). A batch writes the cards it brings and reads, of each law it touches, the best card and the ids; stored cards are read again
only where the best one got worse or most are outdated. A restart goes on from its checkpoint. A new checkpoint begins from what was written before: stored cards and said
markers are its initial state. Each query writes under its own id, so that batches of another checkpoint are never
overwritten, and a batch that runs twice replaces itself.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import cards as C
from ..operators import rules

_PROVIDER, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CARD = "name string, list_name string, label string, status string, rank int, n_attachments long, size long, last_activity string, description string"
_FIELDS = [f.split()[0] for f in CARD.split(", ")]
CANONICAL = f"law_id string, card_id string, {CARD}, duplicates long"
CHUNK, CHUNK_CHARS = 1000, 1 << 21


@contextmanager
def _keyed_state(spark: SparkSession) -> Iterator[None]:
    """Keyed state needs the store with column families; a query takes the setting as it starts."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def _order(card: str) -> tuple:
    """Cards (JSON) by status, attachments, length and last activity; what is null comes last."""
    c = json.loads(card)
    low = lambda v, zero: (v is not None, zero if v is None else v)
    return low(c.get("rank"), 0), low(c.get("n_attachments"), 0), low(c.get("size"), 0), low(c.get("last_activity"), "")


def _best(cards: dict[str, str], orders: dict[str, tuple]) -> tuple[str, str]:
    """The best card and its id; of equals the first by id."""
    card_id = max(sorted(cards, key=lambda i: i or ""), key=orders.__getitem__)
    return card_id, cards[card_id]


class _Competing(StatefulProcessor):
    """All cards of a law; each batch that touches it gives the best of them. head: the best card, and how many cards, versions of cards and
    chunks of versions there are. The last version of a card counts."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "card_id string, card string, cards long, versions long, chunks long")
        self.ids = handle.getMapState("ids", "chunk long", "ids array<string>")
        self.versions = handle.getMapState("versions", "chunk long", "ids array<string>, cards array<string>")

    def _new_ids(self, ids: Iterable[str], cards: int) -> int:
        """Stores the ids that aren't yet among the law's, and tells how many these are. All chunks are full but the last."""
        fresh, tail = set(ids), []
        for chunk in range(-(-cards // CHUNK)):
            tail = list(self.ids.getValue((chunk,))[0])
            fresh.difference_update(tail)
        if fresh:
            full, rest = divmod(cards, CHUNK)
            tail = (tail if rest else []) + list(fresh)
            for i in range(0, len(tail), CHUNK):
                self.ids.updateValue((full + i // CHUNK,), (tail[i : i + CHUNK],))
        return len(fresh)

    def _append(self, cards: dict[str, str], chunks: int) -> int:
        """Stores versions behind the chunks there are, and tells how many chunks there are then."""
        ids, texts, chars, left = [], [], 0, len(cards)
        for card_id, card in cards.items():
            ids.append(card_id)
            texts.append(card)
            chars, left = chars + len(card), left - 1
            if not left or len(ids) == CHUNK or chars >= CHUNK_CHARS:
                self.versions.updateValue((chunks,), (ids, texts))
                ids, texts, chars, chunks = [], [], 0, chunks + 1
        return chunks

    def _latest(self, chunks: int) -> dict[str, str]:
        latest: dict[str, str] = {}
        for chunk in range(chunks):
            latest.update(zip(*self.versions.getValue((chunk,)), strict=True))
        return latest

    def _take(self, rows: Iterable[tuple[str, str]]) -> tuple[str, str, int]:
        """Stores cards (id, JSON), and gives the law's best card and the number of its cards."""
        # Of two versions of a card in one batch the later one counts.
        said = sorted(((i, card, _order(card)) for i, card in rows), key=lambda r: (r[2][3][1], r[2][2][1]))
        new, orders = {i: card for i, card, _ in said}, {i: order for i, _, order in said}
        before = self.head.get()
        *held, cards, versions, chunks = before or (None, None, 0, 0, 0)
        cards += self._new_ids(new, cards)
        versions, chunks = versions + len(new), self._append(new, chunks)
        best, fell = _best(new, orders), False
        if before:
            ours, theirs = orders[best[0]], _order(held[1])
            if ours < theirs or (ours == theirs and (best[0] or "") > (held[0] or "")):
                # What was the best stays ahead, unless it came again and is worse now: then any stored card may follow it.
                fell, best = held[0] in new, tuple(held)
        outdated = versions > 2 * cards + CHUNK
        if fell or outdated:
            latest = self._latest(chunks)
            best = _best(latest, {i: _order(card) for i, card in latest.items()})
            if outdated:
                used, versions, chunks = chunks, len(latest), self._append(latest, 0)
                for chunk in range(chunks, used):
                    self.versions.removeKey((chunk,))
        self.head.update((*best, cards, versions, chunks))
        return *best, cards

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._take((c["card_id"], c["card"]) for c in initialState["seen"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        card_id, card, cards = self._take((r["card_id"], r["card"]) for r in rows)
        yield Row(law_id=key[0], card_id=card_id, card=card, duplicates=cards - 1)

    def close(self) -> None:
        pass


class _Once(StatefulProcessor):
    """Whether a marker was said."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.said = handle.getValueState("said", "said boolean")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.said.update((True,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        texts = [r["text"] for r in rows]
        if not self.said.exists():
            self.said.update((True,))
            yield Row(marker=key[0], text=min((t for t in texts if t is not None), default=None))

    def close(self) -> None:
        pass


def _started(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Each batch as Parquet under the query's id and its number."""
    known, box = threading.Event(), []

    def apply(batch: DataFrame, number: int) -> None:
        known.wait()
        batch.write.mode("overwrite").parquet(f"{target}/query={box[0]}/batch={number}")

    with _keyed_state(stream.sparkSession):
        query = stream.writeStream.foreachBatch(apply).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    box.append(query.id)
    known.set()
    return query


def _written(spark: SparkSession, target: str, schema: str) -> DataFrame | None:
    """What was written before; None if nothing was."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(f"{schema}, query string, batch long").parquet(target)


def competing_cards(cards: DataFrame, target: str, checkpoint: str, seen: DataFrame | None = None) -> StreamingQuery:
    """For a stream of cards (card_id, name, list_name, label, description, last_activity, n_attachments), writes the canonical card of each law that a
    batch touches, chosen among all its cards so far. seen: cards (CARD with law_id and card_id) that a new checkpoint begins with."""
    rows = C.identified(cards).where("law_id is not null")
    said = rows.select(
        "law_id", "card_id", "name", "list_name", "label", "status", rules.status_rank(F.col("status")).cast("int").alias("rank"), F.col("n_attachments").cast("long").alias("n_attachments"),
        F.length("description").cast("long").alias("size"), F.col("last_activity").cast("string").alias("last_activity"), "description",
    )
    packed = lambda df: df.select("law_id", "card_id", F.to_json(F.struct(*_FIELDS)).alias("card"))
    initial = None
    if seen is not None:
        place = F.row_number().over(Window.partitionBy("law_id").orderBy("card_id"))
        chunks = packed(seen).withColumn("chunk", F.floor((place - 1) / CHUNK)).groupBy("law_id", "chunk")
        initial = chunks.agg(F.collect_list(F.struct("card_id", "card")).alias("seen")).select("law_id", "seen").groupBy("law_id")
    with _keyed_state(cards.sparkSession):
        best = packed(said).groupBy("law_id").transformWithState(_Competing(), "law_id string, card_id string, card string, duplicates long", "Update", "None", initialState=initial)
    return _started(best.select("law_id", "card_id", F.from_json("card", CARD).alias("card"), "duplicates").select("law_id", "card_id", "card.*", "duplicates"), target, checkpoint)


def current(spark: SparkSession, target: str, queries: list[str] | None = None) -> DataFrame:
    """The last row of each law. queries: ids of the queries from first to last; by default there is one."""
    rows = _written(spark, target, CANONICAL)
    order = F.array_position(F.array(*[F.lit(q) for q in queries]), F.col("query")) if queries else F.lit(0)
    last = F.max_by(F.struct(*[c for c in rows.columns if c not in ("law_id", "query", "batch")]), F.struct(order, "batch"))
    return rows.groupBy("law_id").agg(last.alias("r")).select("law_id", "r.*")


def say_once(comments: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """For a stream of comments (marker, text), writes each marker once, with the smallest of the texts its batch has. What stands in
    `target` was said; a new checkpoint begins with that."""
    spark = comments.sparkSession
    before = _written(spark, target, "marker string, text string")
    initial = before.select("marker").distinct().groupBy("marker") if before is not None else None
    rows = comments.where("marker is not null").select("marker", "text")
    with _keyed_state(spark):
        out = rows.groupBy("marker").transformWithState(_Once(), "marker string, text string", "Update", "None", initialState=initial)
    return _started(out, target, checkpoint)


def said(spark: SparkSession, target: str) -> DataFrame:
    return _written(spark, target, "marker string, text string").select("marker", "text")


def in_batches(df: DataFrame, folder: str, parts: list, run: Callable[[DataFrame, int], StreamingQuery]) -> list[str]:
    """Hands a table to a stream in turns: the rows of each part (a condition) are written to `folder`, and `run` starts a stream over the folder and
    is waited for. Gives the ids of the queries. The table is worked out once, to a folder beside it."""
    turns = F.array_compact(F.array(*[F.when(part, F.lit(n)) for n, part in enumerate(parts)]))
    df.withColumn("_turn", F.explode(turns)).write.partitionBy("_turn").parquet(f"{folder}-turns")
    kept = df.sparkSession.read.schema(df.select("*", F.lit(0).alias("_turn")).schema).parquet(f"{folder}-turns")
    ids = []
    for n in range(len(parts)):
        kept.where(F.col("_turn") == n).drop("_turn").write.mode("append").parquet(folder)
        query = run(df.sparkSession.readStream.schema(df.schema).parquet(folder), n)
        query.awaitTermination()
        ids.append(query.id)
    return list(dict.fromkeys(ids))
