"""Operator 8, token-ID binary output with a shared zstandard dictionary.

Ids are serialised as little-endian unsigned 16-bit numbers where they all fit, else 32-bit; each
document is compressed by itself with one dictionary that was trained on serialised id arrays of a
bounded sample. A shard (a row of the Parquet table that is the file format, so that any store Spark
can write to will do) holds:

- `dict_hash`: SHA-256 of the dictionary. A reader refuses a dictionary of another hash.
- `offsets`: little-endian unsigned 64-bit, one more than documents: where each document's frame
  begins in `payload`. One document is read by decompressing its frame alone.
- `counts`: the tokens of each document; `doc_ids`; `payload`; `part`, `shard`: the place in order.

The dictionary is a table of its own beside the shards. Documents come in ascending doc_id order
(null first, equal ids by a hash of the text).

Null and empty texts are documents that hold the end id alone. Repeated rows are repeated documents.
An empty table gives no shards.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import corpus, shared_folder, table
from .encode import encoded, encoder_of, running_totals, with_end

SHARD_BYTES = 2 << 20
SHARD = "part int, shard int, dict_hash string, wide boolean, doc_ids array<long>, counts binary, offsets binary, payload binary"


def serialise(ids: np.ndarray, wide: bool) -> bytes:
    return ids.astype("<u4" if wide else "<u2").tobytes()


def train_dictionary(docs: DataFrame, tokenizer_file: str, end_id: int, sample_docs: int = 2000, sample_chars: int = 4000, size: int = 64 << 10) -> bytes:
    """A dictionary from about sample_docs documents (every m-th by hash of doc_id, at most twice as
    many), of which the training reads sample_chars characters each; both bound what reaches the
    driver. Empty where there is too little to train on."""
    import zstandard

    every = max(1, docs.count() // sample_docs)
    chosen = corpus(docs).where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    rows = chosen.select("doc_id", F.substring("text", 1, sample_chars).alias("text")).limit(2 * sample_docs).collect()
    rows.sort(key=lambda r: (r.doc_id is not None, r.doc_id, r.text))
    encoder = encoder_of(tokenizer_file)
    data = [r.text.encode() for r in rows]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in data], dtype=np.int64))).astype(np.int64)
    ids, at = with_end(*encoder.encode(np.frombuffer(b"".join(data), np.uint8), offsets), end_id)
    wide = encoder.tokenizer.get_vocab_size() > 1 << 16
    samples = [serialise(ids[a:b], wide) for a, b in zip(at[:-1], at[1:], strict=True)]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, end_id: int, level: int = 3) -> None:
    """Writes all documents to path/shards and the dictionary to path/dictionary."""
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, tokenizer_file, end_id)
    digest = hashlib.sha256(dictionary).hexdigest()

    def make(part: int):
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        wide, size, shard = vocabulary > 1 << 16, 0, 0
        held: list[tuple[object, int, bytes]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size, shard, held
            offsets = np.concatenate(([0], np.cumsum([len(x[2]) for x in held]))).astype("<u8")
            counts = np.array([x[1] for x in held], "<u8")
            values = [[part], [shard], [digest], [wide], [[x[0] for x in held]], [counts.tobytes()], [offsets.tobytes()], [b"".join(x[2] for x in held)]]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            yield pa.record_batch([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=[x.split()[0] for x in SHARD.split(", ")])
            held, size, shard = [], 0, shard + 1

        def take(doc_ids, ids, at) -> Iterator[pa.RecordBatch]:
            nonlocal size
            if doc_ids is None:
                if held:
                    yield from flush()
                return
            for doc_id, a, b in zip(doc_ids.to_pylist(), at[:-1], at[1:], strict=True):
                one = squeeze.compress(serialise(ids[a:b], wide))
                held.append((doc_id, int(b - a), one))
                size += len(one)
                if size >= SHARD_BYTES:
                    yield from flush()

        return take

    vocabulary = encoder_of(tokenizer_file).tokenizer.get_vocab_size()
    encoded(docs, tokenizer_file, end_id, make, SHARD).write.option("compression", "uncompressed").parquet(f"{path}/shards")
    spark.createDataFrame([(digest, bytearray(dictionary))], "dict_hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")


def read_dictionary(spark: SparkSession, path: str) -> bytes:
    row = spark.read.parquet(f"{path}/dictionary").first()
    dictionary = bytes(row.dictionary)
    if hashlib.sha256(dictionary).hexdigest() != row.dict_hash:
        raise ValueError(f"{path}: the dictionary does not have the hash it is stored under")
    return dictionary


def document(shard, i: int, dictionary: bytes) -> np.ndarray:
    """The ids of the i-th document of one shard row, by its frame alone."""
    import zstandard

    if shard["dict_hash"] != hashlib.sha256(dictionary).hexdigest():
        raise ValueError("the shard was written with another dictionary")
    offsets = np.frombuffer(shard["offsets"], "<u8").astype(np.int64)
    frame = memoryview(shard["payload"])[offsets[i] : offsets[i + 1]]
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).decompress(frame)
    return np.frombuffer(plain, "<u4" if shard["wide"] else "<u2").astype(np.uint32)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 and ids_before (within its shard) of every document of the files,
    with part and shard."""
    dictionary = read_dictionary(spark, path)
    digest = hashlib.sha256(dictionary).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for batch in batches:
            for row in batch.to_pylist():
                if row["dict_hash"] != digest:
                    raise ValueError("a shard was written with another dictionary")
                offsets = np.frombuffer(row["offsets"], "<u8").astype(np.int64)
                payload, kind = memoryview(row["payload"]), "<u4" if row["wide"] else "<u2"
                n, crc = [], []
                for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                    ids = np.frombuffer(plain.decompress(payload[a:b]), kind)
                    n.append(len(ids))
                    crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                before = np.cumsum([0, *n[:-1]])
                yield pa.record_batch(
                    {"part": pa.array([row["part"]] * len(n), pa.int32()), "shard": pa.array([row["shard"]] * len(n), pa.int32()), "doc_id": pa.array(row["doc_ids"], pa.int64()),
                     "n_tokens": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "ids_before": pa.array(before, pa.int64())}
                )

    shards = spark.read.parquet(f"{path}/shards")
    return shards.mapInArrow(run, "part int, shard int, doc_id long, n_tokens long, ids_crc32 long, ids_before long")


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, shard, shard_start): the tokens of all documents before each shard, from the stored
    counts: first within the parts, then over one row a part."""
    from pyspark.sql import Window

    shards = spark.read.parquet(f"{path}/shards").select("part", "shard", "counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [int(np.frombuffer(x, "<u8").sum()) for x in batch.column("counts").to_pylist()]
            yield pa.record_batch({"part": batch.column("part"), "shard": batch.column("shard"), "n_tokens": pa.array(n, pa.int64())})

    sizes = shards.mapInArrow(run, "part int, shard int, n_tokens long")
    before = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    inside = sizes.withColumn("before", F.coalesce(before, F.lit(0)))
    return inside.join(F.broadcast(running_totals(sizes)), "part").select("part", "shard", (F.col("part_start") + F.col("before")).alias("shard_start"))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), 2)
    rows = read_tokens(spark, path).join(shard_starts(spark, path), ["part", "shard"])
    return rows.select("doc_id", (F.col("shard_start") + F.col("ids_before")).alias("start"), "n_tokens", "ids_crc32")
