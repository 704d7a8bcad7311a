"""Operator 1, document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is split into paragraphs at line ends and, so that a long line isn't one unit, after `.`, `!`
or `?` before a space. The digest of a paragraph also holds how many equal ones came before it, so a
text is a set of digests. A sketch of m cells adds every digest to three cells, one in each third:
cells hold the count, the sum of digests and the sum of their checks, all modulo 2^64 (2^32 for
checks). The cells of two versions subtract, which cancels the digests both hold; a cell left with
one digest (count of 1 or -1 whose check fits) gives it up, and taking it from its other cells frees
further ones. If that doesn't empty all cells the difference was too large for m: both texts are
sketched again with four times the cells and another seed, until it does.

likeness = digests in common / digests in either (1 for two texts without digests).

The fingerprint column is the base64 of the smallest sketch (`CELLS` cells), so equal texts have equal
fingerprints. Peeling runs for all pairs of a batch at once.

Null text: empty, with an empty sketch. The next document is that of the next doc_id (null first,
equal ids by text), after the last the first, so a table of one row meets itself. An empty table
gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import corpus, mix, partitions, ragged, table

CELLS = 24
BATCH_CHARS = 1 << 20
COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def paragraphs(text: str) -> list[str]:
    for end in (". ", "! ", "? "):
        text = text.replace(end, end[0] + "\n")
    return [x for x in text.split("\n") if x]


def digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The different digests of each text, and their offsets."""
    parts = [paragraphs(t) for t in texts]
    n = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.fromiter((xxhash.xxh3_64_intdigest(x) for p in parts for x in p), np.uint64, int(n.sum()))
    row = np.repeat(np.arange(len(parts)), n)
    order = np.lexsort((flat, row))
    sorted_row, sorted_flat = row[order], flat[order]
    first = np.ones(len(flat), bool)
    first[1:] = (sorted_row[1:] != sorted_row[:-1]) | (sorted_flat[1:] != sorted_flat[:-1])
    begin = np.flatnonzero(first)
    rank = np.arange(len(flat)) - begin[np.cumsum(first) - 1] if len(flat) else np.zeros(0, np.int64)
    return mix(sorted_flat + rank.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), np.concatenate(([0], np.cumsum(n)))


def checks(keys: np.ndarray) -> np.ndarray:
    return mix(keys ^ np.uint64(0xA0761D6478BD642F)) & np.uint64(0xFFFFFFFF)


def places(keys: np.ndarray, first_cell: np.ndarray, cells: np.ndarray, seed: int) -> list[np.ndarray]:
    """The three cells of each key, in a table that begins at first_cell and has `cells` cells."""
    third = (cells // 3).astype(np.uint64)
    salts = [np.uint64((3 * seed + j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for j in range(3)]
    return [first_cell + j * (cells // 3) + (mix(keys + salt) % third).astype(np.int64) for j, salt in enumerate(salts)]


def add(table_: tuple[np.ndarray, np.ndarray, np.ndarray], at: list[np.ndarray], keys: np.ndarray, sign: np.ndarray | int) -> None:
    count, total, check = table_
    signs = np.broadcast_to(np.asarray(sign, np.int64), keys.shape)
    key, mark = keys * signs.astype(np.uint64), checks(keys) * signs.astype(np.uint64)
    for where in at:
        np.add.at(count, where, signs)
        np.add.at(total, where, key)
        np.add.at(check, where, mark)


def sketches(keys: np.ndarray, offsets: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """count, sum and check of the cells of every row, one row after another."""
    rows = len(offsets) - 1
    made = np.zeros(rows * cells, np.int64), np.zeros(rows * cells, np.uint64), np.zeros(rows * cells, np.uint64)
    first = np.repeat(np.arange(rows) * cells, np.diff(offsets))
    add(made, places(keys, first, np.full(len(keys), cells), 0), keys, 1)
    return made


def as_text(made: tuple[np.ndarray, np.ndarray, np.ndarray], cells: int = CELLS) -> list[str]:
    packed = np.zeros(len(made[0]), np.dtype([("n", "<i4"), ("sum", "<u8"), ("check", "<u4")]))
    packed["n"], packed["sum"], packed["check"] = made[0], made[1], made[2] & np.uint64(0xFFFFFFFF)
    raw, size = packed.tobytes(), cells * packed.itemsize
    return [base64.b64encode(raw[i : i + size]).decode() for i in range(0, len(raw), size)]


def _try(left, right, cells: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Subtracts the sketches of pairs of rows and peels. left, right: (keys, offsets) by pair.
    Gives for each pair the digests found, and whether all cells were emptied."""
    first = np.cumsum(cells) - cells
    made = np.zeros(int(cells.sum()), np.int64), np.zeros(int(cells.sum()), np.uint64), np.zeros(int(cells.sum()), np.uint64)
    for (keys, offsets), sign in ((left, 1), (right, -1)):
        n = np.diff(offsets)
        add(made, places(keys, np.repeat(first, n), np.repeat(cells, n), seed), keys, sign)
    pair_of = np.repeat(np.arange(len(cells)), cells)
    found = np.zeros(len(cells), np.int64)
    count, total, check = made
    mask = np.uint64(0xFFFFFFFF)
    while True:
        at = np.flatnonzero(np.abs(count) == 1)
        sign = count[at]
        keys = total[at] * sign.astype(np.uint64)
        true = checks(keys) == ((check[at] * sign.astype(np.uint64)) & mask)
        at, sign, keys = at[true], sign[true], keys[true]
        pair = pair_of[at]
        home = places(keys, first[pair], cells[pair], seed)
        own = (at == home[0]) | (at == home[1]) | (at == home[2])
        if not own.any():
            break
        sign, keys, pair = sign[own], keys[own], pair[own]
        # A key may lie alone in two of its cells at once; take it once.
        _, once = np.unique(keys ^ mix(pair.astype(np.uint64) + np.uint64(1)), return_index=True)
        sign, keys, pair = sign[once], keys[once], pair[once]
        add(made, places(keys, first[pair], cells[pair], seed), keys, -sign)
        found += np.bincount(pair, minlength=len(cells))
    left_over = np.bincount(pair_of, weights=(count != 0) | (total != 0), minlength=len(cells))
    return found, left_over == 0


def differences(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], cells: int = CELLS) -> np.ndarray:
    """How many digests each pair of rows doesn't share, as peeling recovers them."""
    n = len(left[1]) - 1
    out = np.zeros(n, np.int64)
    todo, seed = np.arange(n), 0
    size = np.full(n, cells)
    # Set sizes come with the sketches (a third of their counts); their difference bounds the digests
    # to recover from below, so tables that must fail aren't tried.
    gap = np.abs(np.diff(left[1]) - np.diff(right[1]))
    while len(todo):
        while (small := size[todo] < gap[todo]).any():
            size[todo[small]] *= 4
        pick = [(keys[ragged(offsets[todo], np.diff(offsets)[todo])], np.concatenate(([0], np.cumsum(np.diff(offsets)[todo])))) for keys, offsets in (left, right)]
        found, whole = _try(*pick, size[todo], seed)
        out[todo[whole]] = found[whole]
        todo, seed = todo[~whole], seed + 1
        size[todo] *= 4
    return out


def likeness(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    both, apart = np.diff(left[1]) + np.diff(right[1]), differences(left, right)
    return np.where(both == 0, 1.0, (both - apart) / np.maximum(both + apart, 1))


def edited(text: str, following: str) -> str:
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut] if cut else text


def compare(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
    changed = [edited(a, b) for a, b in zip(texts, following, strict=True)]
    own, new, after = digests(texts), digests(changed), digests(following)
    n = len(texts)
    both = np.concatenate((own[0], own[0])), np.concatenate((own[1], own[1][-1] + own[1][1:]))
    other = np.concatenate((new[0], after[0])), np.concatenate((new[1], new[1][-1] + after[1][1:]))
    near = likeness(both, other)
    hashed = [hashlib.sha256(x.encode()).hexdigest() for x in changed]
    return pa.record_batch(
        {"doc_id": pa.array(ids, pa.int64()), "n_chars": pa.array(list(map(len, texts)), pa.int64()), "edited_sha256": hashed, "fingerprint": as_text(sketches(*own)),
         "edited_fingerprint": as_text(sketches(*new)), "near_edited": near[:n], "near_next": near[n:]}
    )


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (bucket, halo, doc_id, text); the row after a document is its next one, and
    halo rows are only there to be the next one of a bucket's last document."""
    held: tuple | None = None
    ids, texts, following, size = [], [], [], 0
    for batch in batches:
        for bucket, halo, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "halo", "doc_id", "text")), strict=True):
            if held is not None and held[0] == bucket and not held[1]:
                ids.append(held[2])
                texts.append(held[3])
                following.append(text)
                size += len(held[3])
                if size >= BATCH_CHARS or len(ids) >= 2000:
                    yield compare(ids, texts, following)
                    ids, texts, following, size = [], [], [], 0
            held = bucket, halo, doc_id, text
    if ids:
        yield compare(ids, texts, following)


def _bucket(key: Column, bounds: list[int], low: int = 0) -> Column:
    """The number of bounds below or at key, by binary search."""
    if not bounds:
        return F.lit(low)
    k = len(bounds) // 2
    return F.when(key < bounds[k], _bucket(key, bounds[:k], low)).otherwise(_bucket(key, bounds[k + 1 :], low + k + 1))


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, halo, doc_id, text) sorted within partitions: buckets are ranges of doc_id of like
    size, and the first documents of a bucket come again, as halo, after the bucket before it.

    Only doc_id is read to find the ranges; three a partition and their first ids reach the driver.
    """
    n = 3 * partitions(docs.sparkSession)
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    rows = corpus(docs).withColumn("key", key)
    bounds = rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 100 * n).alias("at")).first()["at"] or []
    rows = rows.withColumn("bucket", _bucket(F.col("key"), sorted(set(bounds))))
    firsts = sorted((r.bucket, r.first) for r in rows.groupBy("bucket").agg(F.min("key").alias("first")).collect())
    before = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
    halo_of = docs.sparkSession.createDataFrame(before, "key long, halo_bucket int")
    marked = rows.join(F.broadcast(halo_of), "key", "left")
    homes = F.array(F.struct(F.col("bucket"), F.lit(False).alias("halo")), F.struct(F.col("halo_bucket").alias("bucket"), F.lit(True).alias("halo")))
    spread = marked.select("doc_id", "text", F.inline(F.filter(homes, lambda x: x["bucket"].isNotNull())))
    return spread.repartition(partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket", "halo", "doc_id", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    return with_next(docs).mapInArrow(_run, COLUMNS)


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
