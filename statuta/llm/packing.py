"""Operator 10, packing: concatenate and cut.

The ids of all documents, each with the end id after it, form one stream in ascending doc_id order.
A first pass writes the ids with their place in their partition; prefix sums over the partitions'
token totals turn that into places in the stream; a second pass cuts the stream into windows of
`length` ids. Every piece of a document in a window is one boundary record; windows are full but for
the last, so no more than one is padded.

Null and empty texts are documents of the end id alone; repeated rows are repeated documents (null ids
first, equal ids in order of a hash of the text); an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .encode import encoded, running_totals

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def token_rows(docs: DataFrame, tokenizer_file: str, end_id: int) -> DataFrame:
    """(part, part_before, doc_id, n_tokens, ids): a row a document, ids as little-endian bytes of
    16 or 32 bits (`wide`)."""

    def make(part: int):
        before = 0

        def take(doc_ids, ids, at) -> Iterator[pa.RecordBatch]:
            nonlocal before
            if doc_ids is None:
                return
            wide = bool(len(ids)) and int(ids.max()) >= 1 << 16
            n, raw = np.diff(at), ids.astype("<u4" if wide else "<u2").tobytes()
            width = 4 if wide else 2
            blobs = [raw[a * width : b * width] for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.record_batch(
                {"part": pa.array(np.full(len(n), part, np.int32)), "part_before": pa.array(before + at[:-1]), "doc_id": doc_ids, "n_tokens": pa.array(n), "wide": pa.array(np.full(len(n), wide)), "ids": pa.array(blobs, pa.binary())}
            )
            before += int(at[-1])

        return take

    return encoded(docs, tokenizer_file, end_id, make, "part int, part_before long, doc_id long, n_tokens long, wide boolean, ids binary")


def cut_pieces(doc_ids: list, starts: np.ndarray, blobs: list[bytes], wide: list[bool], length: int) -> Iterator[tuple]:
    for doc_id, at, blob, big in zip(doc_ids, starts, blobs, wide, strict=True):
        ids = np.frombuffer(blob, "<u4" if big else "<u2").astype("<u4")
        at, n = int(at), len(ids)
        begin = 0
        while begin < n:
            here = (at + begin) % length
            size = min(length - here, n - begin)
            yield doc_id, begin, size, zlib.crc32(ids[begin : begin + size].tobytes()), n, (at + begin) // length, here
            begin += size


def pack(docs: DataFrame, tokenizer_file: str, end_id: int, length: int = 1024) -> DataFrame:
    """One row a piece: where it lies in its document and in its sequence, and the CRC-32 of its ids
    as little-endian unsigned 32-bit integers."""
    rows = written(token_rows(docs, tokenizer_file, end_id))
    placed = rows.join(F.broadcast(running_totals(rows)), "part").select("doc_id", (F.col("part_start") + F.col("part_before")).alias("at"), "wide", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, at, wide, blobs = (c.to_pylist() for c in batch.columns)
            columns = list(zip(*cut_pieces(doc_ids, at, blobs, wide, length), strict=True))
            if columns:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in PIECES.split(", ")])

    return placed.mapInArrow(run, PIECES)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0)


def packed_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: pieces of all documents that are left."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 0)
