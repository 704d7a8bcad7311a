"""Pieces that several corpus operators share: clean input columns, Arrow slices of bounded size and
vectorised word hashing over UTF-8 buffers.

Operators read only the columns they name, so further columns (also ones whose names clash with
those made here) do no harm. A null text counts as the empty text. A null id stays null; where ids
are ordered, null comes first.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task handles at once.
SLICE_BYTES = 1 << 20
#: Bytes that make words under `[^\x20\x09-\x0D]+`.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Bytes that make words under `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z is in lower case.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

UPPER_AZ, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string without nulls) of any table that has the two columns."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def wrapped(docs: DataFrame, *without: str) -> DataFrame:
    """(doc_id, text, row): what corpus() gives, and each row whole but for some columns, so that no name
    clashes with the columns of a table that a stage passes on."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in without]).alias("row")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), whole)


def unwrapped(rows: DataFrame, names: list[str], **changed: Column) -> DataFrame:
    """The columns `names` of what wrapped() took in; some are given anew."""
    return rows.select(*[(changed[c] if c in changed else F.col("row").getField(c)).alias(c) for c in names])


def of_ids(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The documents whose id is among `ids` (doc_id), or with how="left_anti" is not; a null id equals another."""
    named = ids.select(F.col("doc_id").alias("id")).distinct()
    return unwrapped(wrapped(docs).join(named, F.col("doc_id").eqNullSafe(F.col("id")), how), docs.columns)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: what spark.checkpoint.dir says, or one of its
    own where that is unset and Spark runs on this machine alone."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return at or tempfile.mkdtemp(prefix="statuta-")


def cut(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the shared folder: what follows neither repeats nor loses this work."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/statuta-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def quiet_tokenizers() -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the int64 offsets of its rows in them."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice holds at most `most` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(text))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def mix(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64: spreads every input bit over the 64."""
    x = np.asarray(x).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the base of the polynomial hashes, modulo 2^64."""
    global _powers
    if len(_powers) < n:
        base = np.full(max(n, 4096), 0x9E3779B97F4A7C55, np.uint64)
        base[0] = 1
        _powers = np.multiply.accumulate(base)
    return _powers[:n]


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each row the number of words before it (one more
    than rows). Words never cross rows."""
    mask = kind[data]
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before = np.concatenate(([False], mask[:-1]))
    before[offsets[:-1][offsets[:-1] < len(mask)]] = False
    after = np.concatenate((mask[1:], [False]))
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(mask & ~before)
    return starts, np.flatnonzero(mask & ~after) + 1, np.searchsorted(starts, offsets)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every (start, length), one after another."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each (non-empty) byte span."""
    lengths = ends - starts
    if not len(lengths):
        return np.zeros(0, np.uint64)
    first = np.cumsum(lengths) - lengths
    where = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    value = _BYTE[data[np.repeat(starts, lengths) + where]] * powers(int(lengths.max()))[where]
    return mix(np.add.reduceat(value, first) + lengths.astype(np.uint64))


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values within each row; rows may be empty."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    return total[offsets[1:]] - total[offsets[:-1]]
