"""Operator 7, MinHash near-dedup with SetSketch registers.

A document's set holds its distinct word shingles (all words as one shingle where there are fewer).
Register i of its sketch is max over the set of floor(1 - log_b h_i) for exponentially distributed
hash values h_i of rate a, cut to 0..q+1: a minimum on an exponentially spaced scale. Sketches of two
sets merge by the greater register. With b close to 1 two registers agree about as often as the sets'
Jaccard similarity, so bands of `rows` registers are locality-sensitive.

1. Documents of equal sets are one class (by size and two 64-bit sums over the set), known by its
   smallest doc_id; the rest works on one representative a class.
2. Bands: representatives that agree on a band share a bucket. Each member is a candidate of its
   bucket's smallest member; of its candidates the likeliest (joint maximum-likelihood estimate from
   the registers) is confirmed on the full sets, and confirmed links give first components.
3. Documents that share a bucket but not a component are compared by the exact prefix rule: two sets of
   at least the threshold share one of the first n - ceil(threshold * n) + 1 shingles of each, in any
   order that all sets keep, and the first they share must leave enough shingles after it on both
   sides. Rare shingles come first in the order, so what is left over of a crowd of near copies, whose
   edits are its own, meets nobody. Only pairs of different components are listed, those that pass are
   confirmed on the full sets, and no link is left out.
4. The components of all confirmed links: those of the second kind join components of the first.

The estimate only chooses among candidates; it drops those `SLACK` below the threshold, over five
standard errors. With 32 bands of 4 registers a pair at the threshold misses every band with a chance
under 1e-7.

Null and empty texts have an empty set and link with nothing. Rows of one doc_id are one document to
the components. A null doc_id has no component and is kept. Repeated rows get equal results; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, corpus, cut, hash_spans, mix, of_ids, slices, table, utf8, words, written

BANDS, ROWS = 32, 4
BASE, RATE, TOP = 1.001, 20.0, 65_534
SLACK = 0.2
#: Slots of the table of shingle counts that orders shingles: a bounded size, whatever the corpus.
SLOTS = 1 << 18
_EDGE = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text in ascending order, and their offsets."""
    low = LOWER[data]
    starts, ends, at = words(low, offsets)
    h = hash_spans(low, starts, ends)
    n = np.diff(at)
    # Place i of `order` of a shingle's words has its own odd factor.
    made = np.zeros(max(len(h) - width + 1, 0), np.uint64)
    for j in range(width):
        made += h[j : j + len(made)] * _EDGE[j]
    made = mix(made)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    total = int(count.sum())
    row = np.repeat(np.arange(len(n)), count)
    out = np.zeros(total, np.uint64)
    first = np.cumsum(count) - count
    whole = n >= width
    index = np.arange(total) - np.repeat(first, count) + np.repeat(at[:-1], count)
    from_made = np.repeat(whole, count)
    out[from_made] = made[index[from_made]]
    for r in np.flatnonzero(~whole & (n > 0)):
        mine = h[at[r] : at[r + 1]]
        out[first[r]] = mix(np.sum(mine * np.array(_EDGE[: len(mine)]), keepdims=True) + np.uint64(len(mine)))[0]
    order = np.lexsort((out, row))
    row, out = row[order], out[order]
    new = np.ones(total, bool)
    new[1:] = (row[1:] != row[:-1]) | (out[1:] != out[:-1])
    return out[new], np.concatenate(([0], np.cumsum(np.bincount(row[new], minlength=len(n))))).astype(np.int64)


def registers(sets: np.ndarray, offsets: np.ndarray, m: int = BANDS * ROWS) -> np.ndarray:
    """The SetSketch of each set: rows x m, 16 bits each; 0 everywhere for an empty set."""
    out = np.zeros((len(offsets) - 1, m), np.uint16)
    some = np.flatnonzero(np.diff(offsets))
    if not len(some):
        return out
    begin = offsets[some]
    factors = mix(np.arange(1, m + 1, dtype=np.uint64)) | np.uint64(1)
    salts = mix(np.arange(m + 1, 2 * m + 1, dtype=np.uint64))
    for i in range(m):
        x = sets * factors[i]
        x ^= x >> np.uint64(32)
        x *= salts[i] | np.uint64(1)
        least = np.minimum.reduceat(x, begin)
        u = (least.astype(np.float64) + 0.5) / 2.0**64
        k = np.floor(1 - np.log(-np.log1p(-u) / RATE) / np.log(BASE))
        out[some, i] = np.clip(k, 0, TOP + 1)
    return out


def merged(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(left, right)


def estimate(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """Jaccard similarities of pairs of sets of known sizes: the maximum of the joint likelihood of how
    many registers are greater, smaller and equal."""
    m = left.shape[1]
    more, less = (left > right).sum(1), (left < right).sum(1)
    same = m - more - less
    u, v = n_left / (n_left + n_right), n_right / (n_left + n_right)
    chance = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        a, b = chance(u - v * j), chance(v - u * j)
        return more * np.log(a) + less * np.log(b) + same * np.log(np.maximum(1 - a - b, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood has one peak
        third = (high - low) / 3
        rising = likelihood(low + third) < likelihood(high - third)
        low, high = np.where(rising, low + third, low), np.where(rising, high, high - third)
    return (low + high) / 2


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets, at = shingles(*utf8(part.column("text")), width)
            regs = registers(sets, at)
            sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(sets + np.uint64(salt)), dtype=np.uint64))) for salt in (1, 2)]
            a, b = ((s[at[1:]] - s[at[:-1]]).astype(np.int64) for s in sums)
            yield pa.record_batch({"doc_id": part.column("doc_id"), "n_shingles": pa.array(np.diff(at)), "set_a": pa.array(a), "set_b": pa.array(b), "regs": pa.array([r.tobytes() for r in regs], pa.binary())})

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets, at = shingles(*utf8(part.column("text")), width)
            raw = sets.tobytes()
            yield pa.record_batch({"id": part.column("doc_id"), "set": pa.array([raw[8 * a : 8 * b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())})

    return run


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            left, right = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(b.num_rows, -1) for c in ("regs_a", "regs_b"))
            j = estimate(left, right, b.column("n_a").to_numpy(), b.column("n_b").to_numpy())
            yield pa.record_batch({"a": b.column("a"), "b": b.column("b"), "likeness": pa.array(j)})


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("set_a").to_pylist(), b.column("set_b").to_pylist(), strict=True):
                left, right = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * both >= percent * (len(left) + len(right) - both))
            yield pa.record_batch({"a": b.column("a"), "b": b.column("b")}).filter(pa.array(keep, pa.bool_()))

    return run


def _slots(sets: np.ndarray) -> np.ndarray:
    return (sets >> np.uint64(20) & np.uint64(SLOTS - 1)).astype(np.int64)


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SLOTS, np.int64)
    for b in batches:
        if b.num_rows:
            total += np.bincount(_slots(np.frombuffer(b"".join(b.column("set").to_pylist()), np.uint64)), minlength=SLOTS)
    some = np.flatnonzero(total)
    yield pa.record_batch({"slot": pa.array(some), "n": pa.array(total[some])})


def _prefixes(common: np.ndarray, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, component, blob in zip(*(b.column(c).to_pylist() for c in ("id", "component", "set")), strict=True):
                own = np.frombuffer(blob, np.uint64)
                own = own[np.lexsort((own, common[_slots(own)]))]
                n = len(own)
                first = own[: n + (-percent * n // 100) + 1].view(np.int64)
                k = len(first)
                yield pa.record_batch(
                    {"token": pa.array(first), "id": pa.array(np.full(k, i)), "component": pa.array(np.full(k, component)), "n": pa.array(np.full(k, n)), "place": pa.array(np.arange(k))}
                )

    return run


def prefix_pairs(members: DataFrame, percent: int) -> DataFrame:
    """(a, b) of different components that the prefix rule can't rule out. members: (id, component, set)."""
    counts = members.mapInArrow(_slot_counts, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # SLOTS rows at most
    common = np.zeros(SLOTS, np.int64)
    common[counts.column("slot").to_numpy()] = counts.column("n").to_numpy()
    prefixes = cut(members.mapInArrow(_prefixes(common, percent), "token long, id long, component long, n long, place long"))
    shares = prefixes.groupBy("token", "component").count().groupBy("token").agg(F.max(F.struct("count", "component")).alias("top"), F.count("*").alias("parts"))
    mixed = prefixes.join(shares.where("parts > 1").select("token", F.col("top.component").alias("largest")), "token")
    x = mixed.where("component <> largest").select("token", *[F.col(c).alias(f"{c}_x") for c in ("id", "component", "n", "place")])
    y = mixed.select("token", *[F.col(c).alias(f"{c}_y") for c in ("id", "component", "n", "place")])
    enough = (100 + percent) * F.least(F.col("n_x") - F.col("place_x"), F.col("n_y") - F.col("place_y")) >= percent * (F.col("n_x") + F.col("n_y"))
    met = x.join(y, "token").where((F.col("component_x") != F.col("component_y")) & enough)
    return met.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def likely(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """(a, b, likeness) of the pairs whose estimate reaches `least`. reps: (id, n, regs)."""
    side = lambda c: reps.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("regs").alias(f"regs_{c}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "regs_a", "regs_b")
    return rows.mapInArrow(_estimated, "a long, b long, likeness double").where(F.col("likeness") >= least)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The different pairs whose full sets reach the threshold. sets: (id, set), where an id may have several."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("set").alias(f"set_{c}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(_confirmed(percent), "a long, b long").distinct()


def roots(parents: DataFrame) -> DataFrame:
    """(id, component) of a forest (id, parent) in which every id has one parent, a smaller one: each id's
    label is replaced by its label's label until none has one."""
    labels = cut(parents.select("id", F.col("parent").alias("component")))
    while True:
        above = labels.select(F.col("id").alias("component"), F.col("component").alias("next"))
        after = cut(labels.join(above, "component", "left").select("id", F.coalesce("next", "component").alias("component"), F.col("next").isNotNull().alias("moved")))
        labels = after.select("id", "component")
        if after.where("moved").isEmpty():
            return labels


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each vertex of the edges (a, b) reaches. Labels pass to
    neighbours and then jump to their label's label until none changes."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        heard = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("heard"))
        near = labels.join(heard, "id").select("id", F.col("component").alias("was"), F.least("component", "heard").alias("component"))
        target = labels.select(F.col("id").alias("component"), F.col("component").alias("jump"))
        after = cut(near.join(target, "component", "left").select("id", "was", F.least("component", F.coalesce("jump", "component")).alias("component")))
        labels = after.select("id", "component")
        if after.where("component <> was").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (whether the row's id is its component's) of each row."""
    texts = corpus(docs)
    sketched = cut(texts.mapInArrow(_sketch(width), "doc_id long, n_shingles long, set_a long, set_b long, regs binary"))
    same = ["set_a", "set_b", "n_shingles"]
    classes = cut(sketched.where("n_shingles > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("id"), F.first("regs").alias("regs")))
    reps = classes.select("id", F.col("n_shingles").alias("n"), "regs")
    size = 2 * ROWS
    buckets = F.array(*[F.xxhash64(F.lit(j), F.substring("regs", 1 + j * size, size)) for j in range(BANDS)])
    banded = reps.select("id", F.explode(buckets).alias("bucket"))
    crowds = banded.groupBy("bucket").agg(F.min("id").alias("pivot"), F.count("*").alias("members")).where("members > 1")
    crowded = cut(banded.join(crowds, "bucket").select("bucket", "id", "pivot"))
    least = percent / 100 - SLACK
    sets = written(texts.join(crowded.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(_sets(width), "id long, set binary"))

    stars = likely(crowded.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), reps, least)
    best = stars.groupBy("b").agg(F.max(F.struct("likeness", -F.col("a"))).alias("top")).select((-F.col("top.col2")).alias("a"), "b")
    labels = roots(confirmed(best, sets, percent).select(F.col("b").alias("id"), F.col("a").alias("parent")))

    named = crowded.join(labels, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    parts = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("bucket")
    apart = cut(named.join(parts, "bucket").select("id", "component").distinct())
    final = labels
    if not apart.isEmpty():
        second = confirmed(prefix_pairs(sets.join(apart, "id"), percent), sets, percent)
        name = lambda c: apart.select(F.col("id").alias(c), F.col("component").alias(f"component_{c}"))
        met = cut(second.join(name("a"), "a").join(name("b"), "b").select(F.col("component_a").alias("a"), F.col("component_b").alias("b")).distinct())
        if not met.isEmpty():
            joined = components(met)  # a component is named by one of its ids, which has no label of its own
            further = joined.select(F.col("id").alias("component"), F.col("component").alias("whole"))
            final = labels.join(further, "component", "left").select("id", F.coalesce("whole", "component").alias("component")).union(joined)

    placed = classes.select(*same, "id").join(final, "id", "left").select(*same, F.coalesce("component", "id").alias("component_id"))
    out = sketched.select("doc_id", *same).join(placed, same, "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group stays, the one of the smallest id. Rows of one id have one
    fate, and those without an id stay."""
    return of_ids(docs, near_duplicates(docs, width=5).where("kept"))
