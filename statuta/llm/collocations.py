"""Operator 11, phrase collocation mining with weighted acyclic automata.

A count transducer is an acyclic automaton over words whose paths are n-grams of one length and whose last arcs carry
their counts. It is laid out by layers: the labels of each layer's arcs in sorted order, and for each arc the number
of arcs that follow it, or at the end the count.

Length by length, from 2 words to `LONGEST`, a task sorts the different n-grams of its shard and builds
transducers from them, one for each range of prefixes (the leading bits of the first words, up to three of them, so
that a frequent first word is spread over many ranges). Those of a range meet in one task, which unites them and
sums the weights of equal paths; what occurs `least` times stays. An n-gram is only counted if its first and last
n-1 words stay at the length before (all its parts occur as often, so nothing is lost); tasks learn that from a
Bloom filter of at most 2^`FILTER_BITS` bits, whatever the size of the corpus: its errors cost work, not
results. Words are counted first, and texts are then kept as numbers with breaks at pieces' ends and at words
that are too rare.

Part lookups: the parts of all candidates form request transducers, which are composed with the counts of the
same range; a part's count is the weight on the common path.

Words are told apart by 63-bit hashes of word and lang. That no two frequent ones have the same is checked, else
another salt is taken; that a rare word has the hash of a frequent one is as likely as (rare words) * (frequent
words) / 2^63. Scores are exact: products are decimals of 38 digits, quotients are floored integers.

Null texts count as empty, a null lang as `und`; doc_id isn't read; repeated rows count as often as they occur; an
empty table gives no rows; further columns are ignored. Ties in score and frequency are ranked by phrase.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, hash_spans, mix, partitions, ragged, slices, table, utf8, words, written
from .suffix_tree import pack_numbers, pack_sorted, unpack_numbers, unpack_sorted

LEAST, LONGEST, TOP, SHARE = 100, 5, 2000, 100
#: Bytes of text in a shard's chunk; words of the corpus for each range of prefixes.
CHUNK, RANGE_WORDS = 8 << 20, 1 << 20
FILTER_BITS = 27
_SEGMENT = 19  # bits of a filter's segment
_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[list(b".,;:!?\n\x0b\x0c\r")] = True
_WORD = ~_SEPARATORS
_WORD[[9, 32]] = False


def symbols(word_hashes: np.ndarray, lang_hashes: np.ndarray, salt: int) -> np.ndarray:
    """63-bit hashes of (lang, word)."""
    return (mix(word_hashes + mix(lang_hashes + np.uint64(salt))) >> np.uint64(1)).view(np.int64)


def _hashes(column: pa.Array) -> np.ndarray:
    """A hash for every value, also of the empty string."""
    data, offsets = utf8(column)
    out = np.zeros(len(offsets) - 1, np.uint64)
    some = np.flatnonzero(np.diff(offsets))
    out[some] = hash_spans(data, offsets[some], offsets[some + 1])
    return out


class Words:
    """The words of a slice of rows: bounds, row, piece and symbol."""

    def __init__(self, batch: pa.RecordBatch, salt: int) -> None:
        data, offsets = utf8(batch.column("text"))
        self.low = LOWER[data]
        self.starts, self.ends, at = words(self.low, offsets, _WORD)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
        cut = np.cumsum(_SEPARATORS[self.low])[self.starts] if len(self.starts) else np.zeros(0, np.int64)
        # The first word of a piece: of a row, or after a separator.
        self.first = np.concatenate(([True], (cut[1:] != cut[:-1]) | (self.row[1:] != self.row[:-1])))[: len(self.starts)]
        self.symbol = symbols(hash_spans(self.low, self.starts, self.ends), _hashes(batch.column("lang"))[self.row], salt)


COUNTED = "lang string, word string, n long"


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, most=CHUNK):
        w = Words(batch, 0)
        _, where, n = np.unique(w.symbol, return_index=True, return_counts=True)
        starts, lengths = w.starts[where], (w.ends - w.starts)[where]
        offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
        said = pa.StringArray.from_buffers(len(where), pa.py_buffer(offsets.tobytes()), pa.py_buffer(w.low[ragged(starts, lengths)].tobytes()))
        yield pa.record_batch({"lang": batch.column("lang").take(pa.array(w.row[where])), "word": said, "n": pa.array(n.astype(np.int64))})


def _name(salt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                symbol = symbols(_hashes(batch.column("word")), _hashes(batch.column("lang")), salt)
                yield pa.record_batch([*batch.columns, pa.array(symbol), _keys(symbol[:, None])], names=[*batch.schema.names, "symbol", "key"])

    return run


def _keys(sequences: np.ndarray) -> pa.Array:
    """A sequence of symbols as bytes, 8 for each."""
    n, k = sequences.shape
    return pa.Array.from_buffers(pa.binary(8 * k), n, [None, pa.py_buffer(sequences.astype(">i8").tobytes())]).cast(pa.binary())


# Filters ------------------------------------------------------------------------------------------
def gram_hashes(columns: list[np.ndarray]) -> np.ndarray:
    out = columns[0].view(np.uint64)
    for c in columns[1:]:
        out = mix(mix(out) + c.view(np.uint64))
    return out


def _places(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    hashes = mix(hashes)
    step = mix(hashes) | np.uint64(1)
    for i in range(4):
        yield ((hashes + step * np.uint64(i)) >> np.uint64(64 - bits)).astype(np.int64)


def passes(raw: bytes, bits: int, hashes: np.ndarray) -> np.ndarray:
    table_ = np.frombuffer(raw, np.uint8)
    out = np.ones(len(hashes), bool)
    for p in _places(hashes, bits):
        out &= (table_[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
    return out


def _set_bits(bits: int):
    """The segments of the filter that hold a bit of this task's n-grams."""
    segment = min(bits, _SEGMENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            for sequences, _ in opened(batch):
                for p in _places(gram_hashes(list(np.ascontiguousarray(sequences.T))), bits):
                    np.bitwise_or.at(table_, p >> 3, np.uint8(1) << (p & 7).astype(np.uint8))
        parts = table_.reshape(1 << (bits - segment), -1)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.record_batch({"segment": pa.array(some), "part": pa.array([parts[i].tobytes() for i in some], pa.binary())})

    return run


def _or(rows: pa.Table) -> pa.Table:
    parts = [np.frombuffer(x, np.uint8) for x in rows.column("part").to_pylist()]
    return pa.table({"segment": rows.column("segment").slice(0, 1), "part": pa.array([np.bitwise_or.reduce(parts).tobytes()], pa.binary())})


def bloom(automata: DataFrame, n: int) -> tuple[bytes, int]:
    """A filter of the n-grams of the automata, 16 bits for each as far as FILTER_BITS goes."""
    bits = min(FILTER_BITS, max(10, int(16 * n).bit_length()))
    schema = "segment long, part binary"
    size = 1 << (min(bits, _SEGMENT) - 3)
    out = bytearray(1 << (bits - 3))
    for r in automata.mapInArrow(_set_bits(bits), schema).groupBy("segment").applyInArrow(_or, schema).collect():
        out[r.segment * size : (r.segment + 1) * size] = r.part
    return bytes(out), bits


# Transducers --------------------------------------------------------------------------------------
AUTOMATA = "range long, sizes array<int>, labels array<long>, follows array<long>"


def ranges(sequences: np.ndarray, spread: int) -> np.ndarray:
    """The range of prefixes: leading bits of up to three first words; the length stands above them."""
    k = sequences.shape[1]
    used = min(k, 3)
    out = np.full(len(sequences), k, np.int64)
    for j in range(used):
        bits = spread // used + (j < spread % used)
        out = (out << bits) | (sequences[:, j] >> (63 - bits))
    return out


def automata(sequences: np.ndarray, counts: np.ndarray, spread: int) -> pa.RecordBatch:
    """Count transducers of sorted, different sequences, one for each range."""
    at = ranges(sequences, spread)
    order = np.argsort(at, kind="stable")  # sorted within each range
    at, sequences, counts = at[order], sequences[order], counts[order]
    n, k = sequences.shape
    new = np.concatenate(([True], at[1:] != at[:-1]))[:n]
    starts = np.flatnonzero(new)
    label, follow, owner = [], [], []
    for j in range(k):
        new = new | np.concatenate(([True], sequences[1:, j] != sequences[:-1, j]))[:n]
        arcs = np.flatnonzero(new)
        if label:  # arcs of this layer after each arc of the one before
            follow.append(np.diff(np.append(np.searchsorted(arcs, before), len(arcs))))
        label.append(sequences[arcs, j])
        owner.append(at[arcs])
        before = arcs
    follow.append(counts)
    sizes = np.stack([np.diff(np.append(np.searchsorted(o, at[starts]), len(o))) for o in owner], axis=1) if n else np.zeros((0, k), np.int64)
    owned = np.concatenate(owner)
    order = np.argsort(owned, kind="stable")  # by range, then layer
    ends = pa.array(np.concatenate(([0], np.cumsum(sizes.sum(axis=1)))).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x)[order].astype(np.int64))) for x in (label, follow)]
    by_layer = pa.ListArray.from_arrays(pa.array(np.arange(0, k * (len(starts) + 1), k).astype(np.int32)), pa.array(sizes.reshape(-1).astype(np.int32)))
    return pa.record_batch([pa.array(at[starts]), by_layer, *lists], names=[x.split()[0] for x in AUTOMATA.split(", ")])


def opened(rows: pa.RecordBatch | pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sequences and counts of each transducer."""
    for i in range(rows.num_rows):
        sizes, labels, follows = (rows.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("sizes", "labels", "follows"))
        ends = np.cumsum(sizes)
        columns: list[np.ndarray] = []
        for j, end in enumerate(ends):
            if j:
                columns = [np.repeat(c, times) for c in columns]
            columns.append(labels[end - sizes[j] : end])
            times = follows[end - sizes[j] : end]
        yield np.stack(columns, axis=1), times


def united(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All paths of the transducers of one range in order, weights of equal ones summed."""
    parts = list(opened(rows))
    sequences, counts = np.concatenate([s for s, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.lexsort(sequences.T[::-1])
    sequences, counts = sequences[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], (sequences[1:] != sequences[:-1]).any(axis=1))))
    return sequences[first], np.add.reduceat(counts, first)


def _unite(least: int, spread: int):
    def run(rows: pa.Table) -> pa.Table:
        sequences, counts = united(rows)
        often = counts >= least
        return pa.Table.from_batches([automata(sequences[often], counts[often], spread)])

    return run


def _compose(requests: pa.Table, counts: pa.Table) -> pa.Table:
    """The weight of each requested path in the count transducer of the range; 0 where it has none. Both
    automata are walked in step: paths that have taken the same labels are in one state of the product."""
    if not requests.num_rows:
        return pa.table({"part": pa.array([], pa.binary()), "f": pa.array([], pa.int64())})
    asked = united(requests)[0]
    paths, weights = united(counts) if counts.num_rows else (asked[:0], np.zeros(0, np.int64))
    both = np.concatenate((paths, asked))
    state = np.zeros(len(both), np.int64)
    for column in both.T:
        labels, label = np.unique(column, return_inverse=True)
        state = np.unique(state * len(labels) + label, return_inverse=True)[1]
    weight = np.zeros(len(both), np.int64)
    weight[state[: len(paths)]] = weights
    return pa.table({"part": _keys(asked), "f": pa.array(weight[state[len(paths) :]])})


# Passes -------------------------------------------------------------------------------------------
def _words_as_automata(spread: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbol, n = (batch.column(c).to_numpy() for c in ("symbol", "n"))
            order = np.argsort(symbol)
            yield automata(symbol[order][:, None], n[order], spread)

    return run


ENCODED = "names binary, tokens binary"


def _encode(raw: bytes, bits: int, salt: int):
    """The words of a chunk as places among its different frequent ones, from 1; 0 before each stretch of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=CHUNK):
            w = Words(batch, salt)
            use = np.flatnonzero(passes(raw, bits, gram_hashes([w.symbol])))
            new = w.first[use] | (np.diff(use, prepend=-2) != 1)
            alone = new & np.append(new[1:], True)[: len(new)]
            use, new = use[~alone], new[~alone]
            names, which = np.unique(w.symbol[use], return_inverse=True)
            tokens = np.zeros(len(use) + int(new.sum()), np.int64)
            tokens[np.arange(len(use)) + np.cumsum(new)] = which + 1
            yield pa.record_batch({"names": pa.array([pack_sorted(names.view(np.uint64))], pa.binary()), "tokens": pa.array([pack_numbers(tokens.view(np.uint64))], pa.binary())})

    return run


def _grams(k: int, raw: bytes, bits: int, spread: int):
    """Transducers of a chunk's n-grams of k words whose first and last k-1 words are in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                names, tokens = unpack_sorted(batch.column("names")[i].as_py()).view(np.int64), unpack_numbers(batch.column("tokens")[i].as_py()).view(np.int64)
                n = len(tokens) - k + 2  # places of k-1 words
                if n < 2:
                    continue
                often = np.ones(n, bool)
                for j in range(k - 1):
                    often &= tokens[j : j + n] > 0
                if k > 2:
                    some = np.flatnonzero(often)
                    often[some] = passes(raw, bits, gram_hashes([names[tokens[some + j] - 1] for j in range(k - 1)]))
                at = np.flatnonzero(often[:-1] & often[1:])
                if not len(at):
                    continue
                number = tokens[at]  # of the different beginnings, in order
                for j in range(1, k):
                    _, where, number, times = np.unique((number << 32) | tokens[at + j], return_index=True, return_inverse=True, return_counts=True)
                sequences = np.stack([names[tokens[at[where] + j] - 1] for j in range(k)], axis=1)
                yield automata(sequences, times.astype(np.int64), spread)

    return run


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for sequences, counts in opened(batch):
            yield pa.record_batch({"key": _keys(sequences), "k": pa.array(np.full(len(counts), sequences.shape[1], np.int32)), "a": pa.array(counts)})


def _parts(spread: int):
    """Request transducers of all first and last parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_length: dict[int, list[np.ndarray]] = {}
            for sequences, _ in opened(batch):
                for j in range(1, sequences.shape[1]):
                    by_length.setdefault(j, []).extend((sequences[:, :j], sequences[:, -j:]))
            for parts in by_length.values():
                every = np.unique(np.concatenate(parts), axis=0)
                yield automata(every, np.ones(len(every), np.int64), spread)

    return run


def _named(frequent: DataFrame) -> tuple[DataFrame, int]:
    """The frequent words with their symbols, and the first salt under which no two have the same."""
    for salt in range(16):
        named = written(frequent.mapInArrow(_name(salt), COUNTED + ", symbol long, key binary"))
        if named.groupBy("symbol").count().where("count > 1").isEmpty():
            return named, salt
    raise ValueError("words whose hashes are equal under every salt")


RESULT = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, share: int = SHARE, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """RESULT: of each lang the first `top` phrases by the score of their lowest cut."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    counted = written(rows.mapInArrow(_count_words, COUNTED).groupBy("lang", "word").agg(F.sum("n").alias("n")))
    size = counted.agg(F.sum("n").alias("n")).first()["n"] or 0
    spread = min(40, max(partitions(spark), size // RANGE_WORDS).bit_length())
    named, salt = _named(counted.where(F.col("n") >= least))
    levels = [written(named.select("symbol", "n").mapInArrow(_words_as_automata(spread), AUTOMATA).groupBy("range").applyInArrow(_unite(1, spread), AUTOMATA))]
    raw, bits = bloom(levels[0], named.count())
    encoded = written(rows.mapInArrow(_encode(raw, bits, salt), ENCODED))
    for k in range(2, longest + 1):
        sent = encoded.mapInArrow(_grams(k, raw, bits, spread), AUTOMATA)
        level = written(sent.groupBy("range").applyInArrow(_unite(least, spread), AUTOMATA))
        n = level.agg(F.sum(F.element_at("sizes", -1).cast("long")).alias("n")).first()["n"] or 0
        if not n:
            break
        levels.append(level)
        raw, bits = bloom(level, n)
    if len(levels) == 1:
        return spark.createDataFrame([], RESULT)
    counts = levels[0]
    long = levels[1]
    for level in levels[2:]:
        long = long.unionAll(level)
    counts = counts.unionAll(long)
    grams = long.mapInArrow(_listed, "key binary, k int, a long")
    f = written(long.mapInArrow(_parts(spread), AUTOMATA).groupBy("range").cogroup(counts.groupBy("range")).applyInArrow(_compose, "part binary, f long"))
    cuts = grams.select("key", "k", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).withColumns({"left": F.expr("substring(key, 1, 8 * cut)"), "right": F.expr("substring(key, 8 * cut + 1, 8 * (k - cut))")})
    cuts = cuts.join(f.select(F.col("part").alias("left"), F.col("f").alias("l")), "left").join(f.select(F.col("part").alias("right"), F.col("f").alias("r")), "right")
    langs = named.select(F.col("key").alias("head"), "lang").join(counted.groupBy("lang").agg(F.sum("n").alias("n")), "lang")
    cuts = cuts.withColumn("head", F.expr("substring(key, 1, 8)")).join(langs, "head")
    wide = lambda c, digits=17: f"cast({c} as decimal({digits}, 0))"
    score = F.expr(f"({wide(1000, 4)} * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})")
    best = cuts.withColumn("score", score).groupBy("key", "k", "a", "lang", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    inside = grams.where("k > 2").select(F.explode(F.expr("array(substring(key, 1, 8 * (k - 1)), substring(key, 9, 8 * (k - 1)))")).alias("key"), "a").groupBy("key").agg(F.max("a").alias("longer"))
    # What lies in a longer candidate lies in one that is longer by a word and no rarer than it.
    kept = best.join(inside, "key", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).select("key", "k", "lang", "a", "n", "best.score", "best.l", "best.r")
    order = [F.col("score").desc(), F.col("a").desc()]
    first = kept.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= top)
    at = first.select("key", F.posexplode(F.expr("transform(sequence(0, k - 1), i -> substring(key, 8 * i + 1, 8))")).alias("i", "head"))
    said = at.join(named.select(F.col("key").alias("head"), "word"), "head").groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = first.join(said, "key").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(table(spark, sf_dir, "documents"))
