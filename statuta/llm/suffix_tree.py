"""Operator 2, LM scoring with a probabilistic suffix tree over words.

A node of the tree is a context: the last 0, 1 or 2 tokens. The root predicts by add-half counts. A
longer context is retained if it passes a divergence test: predicting each of its training
occurrences from the others (leave one out) must gain at least `LEAST_GAIN` nats in all over predicting
them by its suffix, and it must occur `LEAST_COUNT` times. A retained context s predicts
P(a|s) = (c(s,a) + SMOOTH * P(a|suffix of s)) / (c(s) + SMOOTH), so next-symbol distributions are smoothed
by those of shorter contexts and sum to one. A token is scored by its longest retained suffix.

Counts cover all training text and no table of them is gathered anywhere. Texts are read in chunks of
`CHUNK` bytes. A chunk sends the hashes of its different words, pairs and triples, sorted, with their
training counts, to buckets of the hash space; a bucket adds up equal hashes of all chunks and
answers each chunk in the chunk's order. Three passes over the texts: count; gather the gains of
contexts (each different pair or triple is summed once, by the first chunk that has it) and decide which
are retained; score. Words have hashes of 63 bits. Those of pairs and triples have as many bits as
make a false match of one in about 2^22 likely, whatever the size of the corpus. A frequent word is one
entry of a chunk, so no key is hot.

Null and empty texts hold the end token alone. A null doc_id counts as training. Repeated rows count
and are scored as often as they occur; with no training text all counts are 0; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, corpus, cut, hash_spans, mix, partitions, slices, table, utf8, words
from .quality import fold

CHUNK = 4 << 20
LEAST_COUNT, LEAST_GAIN, SMOOTH = 3, 3.0, 2.0
_END, _PAIR, _TRIPLE = np.uint64(0x452821E638D01377), np.uint64(0xBE5466CF34E90C6C), np.uint64(0xC0AC29B7C97C50DD)
_NONE = np.int64(-1)
WORD_BITS = 63


def _zip(raw: bytes, level: int = 1) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(raw)


def _unzip(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(raw)


def pack_numbers(values: np.ndarray) -> bytes:
    """Non-negative numbers, one byte plane after another, compressed."""
    values = np.ascontiguousarray(values, "<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + _zip(values.view(np.uint8).reshape(-1, 8).T[:width].tobytes())


def unpack_numbers(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(_unzip(raw[1:]), np.uint8).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.reshape(-1).view("<u8").astype(np.uint64)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack_numbers(np.diff(keys, prepend=np.uint64(0))) if len(keys) else pack_numbers(keys)


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack_numbers(raw), dtype=np.uint64)


class Chunk:
    """The tokens of some texts and their keys: sorted hashes of the different pairs and triples, then
    those of the words. word, pair and triple hold each token's place among the keys."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, bits: int) -> None:
        low = LOWER[data]
        starts, ends, at = words(low, offsets)
        rows = len(offsets) - 1
        self.row_at = at + np.arange(rows + 1)
        n = int(self.row_at[-1])
        token = np.full(n, _END, np.uint64)
        word = np.ones(n, bool)
        word[self.row_at[1:] - 1] = False
        token[word] = hash_spans(low, starts, ends)
        self.row = np.repeat(np.arange(rows), np.diff(self.row_at))
        place = np.arange(n) - self.row_at[self.row]
        one, two = np.flatnonzero(place >= 1), np.flatnonzero(place >= 2)
        down = np.uint64(64 - bits)
        pair = mix(mix(token[one - 1] ^ _PAIR) + token[one])
        triple = mix(mix(mix(token[two - 2] ^ _TRIPLE) + token[two - 1]) + token[two])
        grams, which = np.unique(np.concatenate((pair, triple)) >> down, return_inverse=True)
        names, which_word = np.unique(mix(token) >> np.uint64(64 - WORD_BITS), return_inverse=True)
        self.keys, self.grams = np.concatenate((grams, names)), len(grams)
        self.word = which_word + len(grams)
        self.pair, self.triple = np.full(n, _NONE), np.full(n, _NONE)
        self.pair[one], self.triple[two] = which[: len(one)], which[len(one) :]

    def before(self, values: np.ndarray) -> np.ndarray:
        """values of the token before each one; of the first token of a text, none."""
        out = np.roll(values, 1)
        out[self.row_at[:-1]] = _NONE
        return out


CHUNKS = "block long, doc_ids array<long>, train binary, sizes binary, text binary"


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every CHUNK bytes of text, named by place in the scan, which is the same each time."""
    from pyspark import TaskContext

    part, n = TaskContext.get().partitionId(), 0
    held: list[pa.RecordBatch] = []
    size = 0

    def flush() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        data, offsets = utf8(rows.column("text"))
        train = rows.column("train").combine_chunks().to_numpy(zero_copy_only=False).astype(np.uint8)
        names = [x.split()[0] for x in CHUNKS.split(", ")]
        values = [[(part << 32) + n], [rows.column("doc_id").to_pylist()], [train.tobytes()], [np.diff(offsets).astype("<i8").tobytes()], [_zip(data.tobytes(), 6)]]
        return pa.record_batch([pa.array(v, k) for v, k in zip(values, (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=names)

    for piece in slices(batches):
        held.append(piece)
        size += len(utf8(piece.column("text"))[0])
        if size >= CHUNK:
            yield flush()
            held, size, n = [], 0, n + 1
    if held:
        yield flush()


def _open(row: dict, bits: int) -> tuple[Chunk, np.ndarray]:
    offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.frombuffer(row["sizes"], "<i8"))))
    return Chunk(np.frombuffer(_unzip(row["text"]), np.uint8), offsets, bits), np.frombuffer(row["train"], np.uint8).astype(bool)


SENT = "bucket long, block long, keys binary, counts binary"


def _send(block: int, chunk: Chunk, at: np.ndarray, values: np.ndarray, bits: int, spread: int) -> pa.RecordBatch:
    """The keys at ascending places and their values, a row for each bucket: 2^spread buckets of pairs
    and triples, then as many of words."""
    keys, is_word = chunk.keys[at], at >= chunk.grams
    bucket = (keys >> np.where(is_word, WORD_BITS - spread, bits - spread).astype(np.uint64)).astype(np.int64) + (is_word.astype(np.int64) << spread)
    names, first = np.unique(bucket, return_index=True)
    ends = np.append(first[1:], len(keys))
    blobs = [(pack_sorted(keys[a:b]), pack_numbers(values[a:b])) for a, b in zip(first, ends, strict=True)]
    return pa.record_batch({"bucket": pa.array(names, pa.int64()), "block": pa.array([block] * len(names), pa.int64()), "keys": pa.array([x for x, _ in blobs], pa.binary()), "counts": pa.array([x for _, x in blobs], pa.binary())})


def _count(bits: int, spread: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunked(batches):  # the same chunks as in the other passes
            for row in batch.to_pylist():
                chunk, train = _open(row, bits)
                counted = train[chunk.row]
                times = np.zeros(len(chunk.keys), np.int64)
                for kind in (chunk.word, chunk.pair, chunk.triple):
                    times += np.bincount(kind[counted & (kind >= 0)], minlength=len(times))
                yield _send(row["block"], chunk, np.arange(len(times)), times, bits, spread)

    return run


ANSWER = "block long, bucket long, answer binary, tokens long, types long"


def _sum_counts(spread: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """For each key of each chunk: twice the sum over all chunks, plus 1 for the first chunk that has it."""
        rows = rows.sort_values("block")
        keys = [unpack_sorted(x) for x in rows["keys"]]
        values = np.concatenate([unpack_numbers(x) for x in rows["counts"]]).astype(np.int64)
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        new = np.concatenate(([True], every[order][1:] != every[order][:-1]))
        first = np.flatnonzero(new)
        total = np.add.reduceat(values[order], first)
        out = np.zeros(len(every), np.int64)
        out[order] = total[np.cumsum(new) - 1] * 2
        out[order[first]] += 1
        ends = np.cumsum([len(k) for k in keys])
        words_here = rows["bucket"].iloc[0] >> spread == 1
        made = pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"], "answer": [pack_numbers(x) for x in np.split(out, ends[:-1])], "tokens": 0, "types": 0})
        if words_here:
            made.iloc[0, 3:] = int(total.sum()), int((total > 0).sum())
        return made

    return run


def _sum_gains(rows: pd.DataFrame) -> pd.DataFrame:
    """For each context of each chunk: 1 if the sum of its gains reaches the threshold."""
    keys = [unpack_sorted(x) for x in rows["keys"]]
    every = np.concatenate(keys)
    gains = np.concatenate([unpack_numbers(x) for x in rows["counts"]]).astype(np.int64)
    gains = (gains >> 1) ^ -(gains & 1)
    _, which = np.unique(every, return_inverse=True)
    total = np.zeros(int(which.max()) + 1, np.int64)
    np.add.at(total, which, gains)
    kept = (total >= 1000 * LEAST_GAIN)[which].astype(np.int64)
    ends = np.cumsum([len(k) for k in keys])
    return pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"], "answer": [pack_numbers(x) for x in np.split(kept, ends[:-1])], "tokens": 0, "types": 0})


class Counts:
    """A chunk with the corpus counts of its words, pairs and triples."""

    def __init__(self, chunk: Chunk, answers: list, tokens: int, types: int) -> None:
        told = np.concatenate([unpack_numbers(x["answer"]) for x in answers]).astype(np.int64)
        if len(told) != len(chunk.keys):
            raise ValueError("a chunk has changed between two passes over the texts")
        self.total, self.owned = told >> 1, (told & 1).astype(bool)
        look = lambda which: np.where(which >= 0, self.total[which], 0)
        self.word, self.pair, self.triple = look(chunk.word), look(chunk.pair), look(chunk.triple)
        # Contexts: the token before, and the pair before.
        self.one, self.two = chunk.before(chunk.word), chunk.before(chunk.pair)
        self.n_one, self.n_two = look(self.one), look(self.two)
        self.floor = tokens + 0.5 * (types + 1)

    def contexts(self) -> np.ndarray:
        """Indices of the keys that are contexts frequent enough to be retained."""
        some = np.concatenate((self.one[self.n_one >= LEAST_COUNT], self.two[self.n_two >= LEAST_COUNT]))
        return np.unique(some)


def _gains(bits: int, spread: int, tokens: int, types: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                chunk, _ = _open(row, bits)
                c = Counts(chunk, row["answers"], tokens, types)
                asked = c.contexts()
                sums = np.zeros(len(chunk.keys))
                root = np.maximum(c.word - 0.5, 0.5) / c.floor
                one = (np.maximum(c.pair - 1, 0) + SMOOTH * root) / (np.maximum(c.n_one - 1, 0) + SMOOTH)
                two = (np.maximum(c.triple - 1, 0) + SMOOTH * one) / (np.maximum(c.n_two - 1, 0) + SMOOTH)
                for which, n, context, size, own, short in ((chunk.pair, c.pair, c.one, c.n_one, one, root), (chunk.triple, c.triple, c.two, c.n_two, two, one)):
                    first = np.full(len(chunk.keys), _NONE)
                    use = np.flatnonzero((which >= 0) & (n > 0) & (size >= LEAST_COUNT))
                    use = use[c.owned[which[use]]]
                    first[which[use]] = use
                    use = first[first >= 0]
                    np.add.at(sums, context[use], n[use] * (np.log(own[use]) - np.log(short[use])))
                gain = np.rint(1000 * sums[asked]).astype(np.int64)
                if len(asked):
                    yield _send(row["block"], chunk, asked, (gain << 1) ^ (gain >> 63), bits, spread)

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(bits: int, tokens: int, types: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                chunk, train = _open(row, bits)
                c = Counts(chunk, row["answers"], tokens, types)
                asked = c.contexts()
                retained = np.zeros(len(chunk.keys) + 1, bool)  # the last is that of no context
                if len(asked):
                    retained[asked] = np.concatenate([unpack_numbers(x["answer"]) for x in row["kept"]]).astype(bool)
                root = (c.word + 0.5) / c.floor
                one = np.where(retained[c.one], (c.pair + SMOOTH * root) / (c.n_one + SMOOTH), root)
                two = np.where(retained[c.two], (c.triple + SMOOTH * one) / (c.n_two + SMOOTH), one)
                begin = chunk.row_at[:-1]
                rows = len(begin)
                values = [row["doc_ids"], ~train, np.diff(chunk.row_at), np.add.reduceat((c.word > 0).astype(np.int64), begin), np.full(rows, tokens), np.add.reduceat(np.log10(root), begin), np.add.reduceat(np.log10(two), begin)]
                kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.record_batch([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=[x.split()[0] for x in SCORES.split(", ")])

    return run


def scored(docs: DataFrame) -> DataFrame:
    rows = corpus(docs).withColumn("train", F.coalesce(fold(F.col("doc_id"), 5) != 1, F.lit(True)))
    size = rows.agg(F.sum(F.octet_length("text").cast("long") + 1).alias("n")).first()["n"] or 1
    bits = min(63, int(size).bit_length() - 2 + 22)
    buckets = max(partitions(docs.sparkSession), size >> 22)
    spread = min(bits, int(buckets - 1).bit_length())
    chunks = rows.mapInArrow(_chunked, CHUNKS)

    def answered(sent: DataFrame, how) -> DataFrame:
        return sent.groupBy("bucket").applyInPandas(how, ANSWER)

    def told(answers: DataFrame, name: str) -> DataFrame:
        return answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "answer"))).alias(name))

    counts = cut(answered(rows.mapInArrow(_count(bits, spread), SENT), _sum_counts(spread)))
    n = counts.agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).first()
    tokens, types = n["tokens"] or 0, n["types"] or 0
    informed = chunks.join(told(counts, "answers"), "block", "left")
    kept = answered(informed.mapInArrow(_gains(bits, spread, tokens, types), SENT), _sum_gains)
    return informed.join(told(kept, "kept"), "block", "left").mapInArrow(_scores(bits, tokens, types), SCORES)


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
