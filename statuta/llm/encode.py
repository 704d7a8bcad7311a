"""Token ids of whole texts in document order, shared by the binary output and packing.

A text is cut where the tokenizer's own pre-tokenizer always cuts: before an ASCII space that stands
between two bytes that are no white space, and between an ASCII letter and ASCII punctuation other
than the apostrophe. Pieces therefore encode by themselves to the same ids,
and a worker process encodes each different piece once: pieces are found by a 64-bit hash and their
length in a table of bounded size, which the process keeps for its next tasks. Everything else is
encoded anew.

Added tokens of the tokenizer (<|endoftext|>) that stand in a text become their own ids, as the
library has it by default: it splits a text at them before anything else, so each is a piece.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACED, corpus, hash_spans, partitions, quiet_tokenizers, ragged, slices, utf8

#: Pieces that a worker remembers, and their longest size; longer ones are encoded each time.
MEMORY, LONGEST = 1_500_000, 64


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True
_MARK[39] = False


class Encoder:
    """encode(data, offsets) gives the ids of many texts and the offsets of each text's ids."""

    def __init__(self, tokenizer_file: str) -> None:
        quiet_tokenizers()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        self.added = sorted((t.content.encode() for t in added), key=len, reverse=True)
        self.marker = re.compile(b"|".join(map(re.escape, self.added)))
        # Tokens that take in white space, ask for word edges or are sought in normalised text: no cuts at all.
        self.uncut = any(t.lstrip or t.rstrip or t.single_word or (t.normalized and self.tokenizer.normalizer is not None) for t in added)
        self._forget()

    def _markers(self, text: bytes, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
        """Where added tokens stand, within rows."""
        if any(x in text for x in self.added):
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                yield from (m.span() for m in self.marker.finditer(text, a, b))

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.n = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        if len(self.keys) + len(keys) > MEMORY:
            self._forget()
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        n = np.fromiter(map(len, got), np.int64, len(got))
        at = len(self.ids) + np.cumsum(n) - n
        self.ids = np.concatenate((self.ids, np.fromiter((i for ids in got for i in ids), np.uint32, int(n.sum()))))
        where = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.n = (np.insert(old, where, new) for old, new in ((self.keys, keys), (self.at, at), (self.n, n)))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        solid = SPACED[data]
        cut = np.zeros(len(data), bool)
        cut[1:-1] = (data[1:-1] == 32) & solid[:-2] & solid[2:]
        mark = np.zeros(len(data), bool)
        mark[1:] = _LETTER[data[:-1]] & _MARK[data[1:]]
        begins = offsets[:-1][np.diff(offsets) > 0]
        ends_of = offsets[1:][np.diff(offsets) > 0]
        cut[ends_of - 1] = False  # a space at the end of a text isn't followed by a word of it
        cut |= mark
        text = data.tobytes()
        if self.uncut:
            cut[:] = False
        else:
            for a, b in self._markers(text, offsets):
                cut[max(a - 1, 0) : b + 1] = False  # nor is a space before an added token
                cut[a] = True
                if b < len(cut):
                    cut[b] = True
        cut[begins] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        keys = hash_spans(data, starts, ends)
        short = ends - starts <= LONGEST
        different, first, which = np.unique(keys[short], return_index=True, return_inverse=True)
        first = np.flatnonzero(short)[first]
        for _ in range(2):
            where = np.searchsorted(self.keys, different)
            known = np.zeros(len(different), bool)
            if len(self.keys):
                known = self.keys[np.minimum(where, len(self.keys) - 1)] == different
            if known.all():
                break
            before = len(self.keys)
            self._learn(different[~known], [text[a:b].decode() for a, b in zip(starts[first[~known]], ends[first[~known]], strict=True)])
            if len(self.keys) < before:  # the table was emptied: learn the rest of this slice too
                continue
        where = np.searchsorted(self.keys, different)[which]
        at, n = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        at[short], n[short] = self.at[where], self.n[where]
        pool = self.ids
        if not short.all():
            long = np.flatnonzero(~short)
            got = [e.ids for e in self.tokenizer.encode_batch_fast([text[a:b].decode() for a, b in zip(starts[long], ends[long], strict=True)], add_special_tokens=False)]
            n[long] = np.fromiter(map(len, got), np.int64, len(got))
            at[long] = len(pool) + np.cumsum(n[long]) - n[long]
            pool = np.concatenate((pool, np.fromiter((i for ids in got for i in ids), np.uint32, int(n[long].sum()))))
        ids = pool[ragged(at, n)]
        total = np.concatenate(([0], np.cumsum(n)))
        return ids, total[np.searchsorted(starts, offsets)]


@functools.lru_cache(maxsize=1)
def encoder_of(tokenizer_file: str) -> Encoder:
    """This process's encoder, with what it has learnt so far."""
    return Encoder(tokenizer_file)


def with_end(ids: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with end_id after each document's."""
    rows = len(at) - 1
    out = np.full(len(ids) + rows, end_id, np.uint32)
    new = at + np.arange(rows + 1)
    out[ragged(new[:-1], np.diff(at))] = ids
    return out, new


Rows = Callable[[int, pa.Array, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]]


def encoded(docs: DataFrame, tokenizer_file: str, end_id: int, make: Rows, schema: str) -> DataFrame:
    """What `make` makes of the documents' ids, in ascending doc_id order (null ids first, equal ids by a
    hash of the text) within and across partitions; the hash also splits an id of very many rows.
    make(partition) gives a function of (doc_ids, ids, offsets) that gets slices in order, then None.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, partition = encoder_of(tokenizer_file), TaskContext.get().partitionId()
        state = make(partition)
        for part in slices(batches):
            ids, at = with_end(*encoder.encode(*utf8(part.column("text"))), end_id)
            yield from state(part.column("doc_id"), ids, at)
        yield from state(None, None, None)

    rows = corpus(docs).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    return ordered.select("doc_id", "text").mapInArrow(run, schema)


def running_totals(df: DataFrame, tokens: str = "n_tokens") -> DataFrame:
    """(part, part_start): the tokens of all partitions before each. One row a partition, so a task
    count bounds both the window and what is broadcast."""
    from pyspark.sql import Window

    sums = df.groupBy("part").agg(F.sum(tokens).alias("part_tokens"))
    before = F.sum("part_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return sums.select("part", F.coalesce(before, F.lit(0)).alias("part_start"))
