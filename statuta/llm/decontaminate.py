"""Operator 3, benchmark decontamination with SimHash, in DataFrame functions alone.

Words are runs without ASCII white space, in lower case; an item's shingles are its runs of `width`
(5) words, all its words where there are fewer. A window of a document has as many words as an item, or
is the whole text where that is shorter. A document leaks an item if one of its windows of the item's
size has weighted shingle similarity (sum of lesser counts over sum of greater counts) of at least 0.8
with it.

1. Windows of every item size slide over the texts. One can only be similar to an item of its size if so
   many of its shingles, `k`, are shingles of items of that size that their common count may reach the
   threshold; where there are fewer, no fingerprint is made. Of the windows that differ only by shingles
   of no such item before the first one that counts, the last is made: shifting a window to the right
   over such shingles takes nothing from what it shares, so the best similarity is that of all windows.
2. Each window and item has a 64-bit SimHash of its weighted shingles. The index holds, for each of 8
   blocks of 8 bits of an item's fingerprint, all block values within 2 bits. Two fingerprints within
   radius 23 differ by at most floor(23 / 8) = 2 bits in some block, so a lookup of the window's 8
   blocks among the items of its size finds every fingerprint within the radius; the whole distance is
   checked after it. At similarity 0.8 a distance over 23 has a chance of about 1e-6.
3. The exact weighted-shingle similarity decides.

The item side is broadcast if it has at most `BROADCAST_ROWS` rows, which is counted first; beyond it Spark
chooses the join. What a document gathers are places of its own shingles. Documents with enough of them are written
with their words in blocks that overlap by a window; windows are rows that carry one block at most, and equal windows
of a document share one fingerprint, so that a long text that repeats an item costs what one repetition does.

Null and empty texts leak nothing, and an item without words is leaked by nothing. A null doc_id is a
document like others; rows of one id give one result for each item. Empty tables give no rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import corpus, of_ids, table, written

WIDTH, LEAST = 5, 0.8
BLOCKS, BLOCK_BITS, RADIUS = 8, 8, 23
BROADCAST_ROWS = 4_000_000
#: Windows that start in one block of words, unless an item is longer.
BLOCK_WORDS = 1024
_LANES = 0x0000000100000001


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[ \\x09-\\x0D]+"), "")


def shingle_array(hashes: Column, width: Column | int) -> Column:
    """Hashes of the runs of `width` words of an array of word hashes; empty where it is shorter."""
    n = width if isinstance(width, Column) else F.lit(width)
    last = F.size(hashes) - n
    each = lambda i: F.xxhash64(*[F.when(F.lit(j) < n, F.get(hashes, i + j)) for j in range(WIDTH)])
    if isinstance(width, int):
        each = lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(width)], *[F.lit(None).cast("long")] * (WIDTH - width))
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), each)).otherwise(F.array().cast("array<long>"))


def simhash(shingles: Column) -> Column:
    """The 64 majority bits of an array of hashes. Two bits are counted at once, in lanes of 32 bits."""
    n = F.size(shingles)
    parts = []
    counted = lambda k: F.aggregate(shingles, F.lit(0).cast("long"), lambda a, x: a + F.shiftrightunsigned(x, k).bitwiseAND(F.lit(_LANES)))
    for k in range(32):
        sums = counted(k)
        for lane in range(2):
            count = F.shiftrightunsigned(sums, 32 * lane).bitwiseAND(F.lit(0xFFFFFFFF))
            parts.append(F.shiftleft(F.when(count * 2 > n, F.lit(1)).otherwise(F.lit(0)).cast("long"), 32 * lane + k))
    out = parts[0]
    for part in parts[1:]:
        out = out.bitwiseOR(part)
    return out


def blocks(fingerprint: Column) -> list[Column]:
    return [F.shiftrightunsigned(fingerprint, BLOCK_BITS * j).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int") for j in range(BLOCKS)]


def near_values() -> list[int]:
    """Masks of at most floor(RADIUS / BLOCKS) bits of a block."""
    most = RADIUS // BLOCKS
    return [sum(1 << b for b in bits) for k in range(most + 1) for bits in combinations(range(BLOCK_BITS), k)]


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of lesser counts over sum of greater counts. Where a's elements all differ, the lesser counts are
    those of a set."""
    count = lambda array, e: F.size(F.filter(array, lambda x: x == e))
    each = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, e: s + F.least(count(a, e), count(b, e)))
    common = F.when(F.size(F.array_distinct(a)) == F.size(a), F.size(F.array_intersect(a, b))).otherwise(each)
    return common / (F.size(a) + F.size(b) - common)


def item_table(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, length, width, item_shingles, item_print) of the items that have words."""
    rows = items.select(F.col(item_col).cast("long").alias("item_id"), F.transform(word_array(F.coalesce(F.col(text_col), F.lit(""))), lambda w: F.xxhash64(w)).alias("hashes"))
    sized = rows.where(F.size("hashes") > 0).select("item_id", "hashes", F.size("hashes").alias("length"), F.least(F.size("hashes"), F.lit(WIDTH)).alias("width"))
    made = sized.select("item_id", "length", "width", shingle_array(F.col("hashes"), F.col("width")).alias("item_shingles"))
    return made.withColumn("item_print", simhash(F.col("item_shingles")))


def windows(docs: DataFrame, known: DataFrame, bounded, least: float) -> DataFrame:
    """(doc_id, length, width, start, n_same, own): the words of the windows that may reach the threshold. Those of a
    document with the same words are made once, at the first start."""
    widths = [r.width for r in known.select("width").distinct().collect()] or [WIDTH]  # WIDTH of them at most
    classes = known.select("length", "width", F.explode("item_shingles").alias("shingle")).distinct()
    rows = corpus(docs)
    hashed = rows.select("doc_id", F.transform(word_array(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"))
    placed = lambda w: F.transform(shingle_array(F.col("hashes"), w), lambda x, i: F.struct(F.lit(w).alias("own_width"), i.alias("at"), x.alias("own")))
    if len(widths) == 1:
        own = hashed.select("doc_id", F.lit(widths[0]).alias("own_width"), F.posexplode(shingle_array(F.col("hashes"), widths[0])).alias("at", "own"))
    else:
        own = hashed.select("doc_id", F.inline(F.concat(*map(placed, sorted(widths)))))
    found = own.join(bounded(classes), (F.col("own") == F.col("shingle")) & (F.col("own_width") == F.col("width")))
    whole = F.col("length") - F.col("width") + 1  # the item's shingles
    spots = found.groupBy(F.col("doc_id").alias("spot_id"), "length", "width").agg(F.sort_array(F.collect_set("at")).alias("hits")).where(F.size("hits") >= least * whole)

    # Written, so that neither lambdas nor the two uses below make the words of a text again.
    met = rows.join(spots, F.col("doc_id").eqNullSafe(F.col("spot_id"))).select("doc_id", "length", "width", "hits", F.transform(word_array(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"))
    met = written(met)
    sized = met.withColumn("n", F.least(F.col("length"), F.size("hashes"))).where("n >= width").withColumn("last", F.size("hashes") - F.col("n"))
    enough = sized.withColumn("k", F.ceil(least * (whole + F.col("n") - F.col("width") + 1) / (1 + least) - 1e-9).cast("int")).where("size(hits) >= k")
    inside = lambda i: (F.get("hits", i + F.col("k") - 1) <= F.get("hits", i) + F.col("n") - F.col("width")) & (F.get("hits", i) <= F.col("last"))
    at_hits = F.transform(F.filter(F.sequence(F.lit(0), F.size("hits") - F.col("k")), inside), lambda i: F.get("hits", i))
    at_end = F.when(F.get("hits", F.size("hits") - F.col("k")) >= F.col("last"), F.array("last")).otherwise(F.array().cast("array<int>"))
    begun = enough.select("doc_id", "length", "width", "n", "last", "hashes", F.xxhash64("hashes").alias("of_text"), F.array_union(at_hits, at_end).alias("starts")).where("size(starts) > 0")

    # Words in blocks that overlap by a window, and starts as rows: a row holds a block, whatever the text's length.
    step = F.greatest(F.col("n"), F.lit(BLOCK_WORDS))
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.col("last") / step).cast("int")), lambda b: F.struct(b.alias("block"), F.slice(F.col("hashes"), b * step + 1, step + F.col("n") - 1).alias("words")))
    key = F.struct("doc_id", "length", "width", "n", "of_text").alias("key")
    kept = begun.select(key, "starts")
    blocks_of = begun.select(key, F.inline(pieces))
    base = F.col("block") * F.greatest(F.col("key.n"), F.lit(BLOCK_WORDS))
    cutout = F.slice(F.col("words"), F.col("start") - base + 1, F.col("key.n"))
    at = kept.select("key", F.explode("starts").alias("start")).withColumn("block", F.floor(F.col("start") / F.greatest(F.col("key.n"), F.lit(BLOCK_WORDS))).cast("int"))
    grouped = at.groupBy("key", "block").agg(F.collect_set("start").alias("starts"))
    named = blocks_of.join(grouped, ["key", "block"]).select("key", "block", "words", F.explode("starts").alias("start"))
    # Windows of one document with the same words are one: its first, with their number.
    one = named.select("key", "start", "block", F.xxhash64(cutout).alias("a"), F.xxhash64(F.lit(1), cutout).alias("b"))
    first = one.groupBy("key", "a", "b").agg(F.min(F.struct("start", "block")).alias("first"), F.count_distinct("start").alias("n_same"))
    firsts = first.groupBy("key", F.col("first.block").alias("block")).agg(F.collect_list(F.struct(F.col("first.start").alias("start"), "n_same")).alias("starts"))
    told = blocks_of.join(firsts, ["key", "block"]).select("key", "block", "words", F.inline("starts"))
    return told.select("key.doc_id", "key.length", "key.width", "start", "n_same", cutout.alias("own"))


def leaks(docs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, item_id, similarity (of the best window), word_start (its first word, from 0), n_words (its
    length) and n_windows (how many of the windows made reach the threshold)."""
    known = item_table(items)
    masks = near_values()
    size = known.agg(F.coalesce(F.sum(F.size("item_shingles") + BLOCKS * len(masks)), F.lit(0)).alias("n")).first()["n"]
    bounded = F.broadcast if size <= BROADCAST_ROWS else (lambda df: df)
    made = windows(docs, known, bounded, least)
    prints = made.select("doc_id", "length", "start", "n_same", F.size("own").alias("n_words"), shingle_array(F.col("own"), F.col("width")).alias("shingles"))
    prints = prints.withColumn("print", simhash(F.col("shingles")))

    near = F.array(*[F.lit(m) for m in masks])
    index = known.select("item_id", "length", "item_print", F.posexplode(F.array(*blocks(F.col("item_print")))).alias("block", "value"))
    index = index.select("item_id", "length", "item_print", "block", F.explode(F.transform(near, lambda m: F.col("value").bitwiseXOR(m))).alias("value"))
    looked = prints.select("*", F.posexplode(F.array(*blocks(F.col("print")))).alias("block", "value"))
    candidates = looked.join(bounded(index), ["length", "block", "value"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    # A window found by several blocks is one candidate: the first that would find it counts.
    closeness = [F.bit_count(x.bitwiseXOR(y)) <= RADIUS // BLOCKS for x, y in zip(blocks(F.col("print")), blocks(F.col("item_print")), strict=True)]
    first = F.coalesce(*[F.when(near_by, F.lit(j)) for j, near_by in enumerate(closeness)])
    once = candidates.where(F.col("block") == first).join(bounded(known.select(F.col("item_id").alias("of_item"), "item_shingles")), F.col("item_id").eqNullSafe(F.col("of_item")))
    scored = once.select("doc_id", "item_id", "start", "n_same", "n_words", weighted_similarity(F.col("item_shingles"), F.col("shingles")).alias("similarity")).where(F.col("similarity") >= least)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("at"), "n_words")).alias("best")
    return (
        scored.groupBy("doc_id", "item_id")
        .agg(best, F.sum("n_same").alias("n_windows"))
        .select("doc_id", "item_id", "best.similarity", (-F.col("best.at")).cast("long").alias("word_start"), F.col("best.n_words").cast("long").alias("n_words"), "n_windows")
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that leak a benchmark item go. Rows of one id, and those without one, have
    one fate."""
    return of_ids(docs, leaks(docs, table(spark, sf_dir, "benchmark")), "left_anti")
