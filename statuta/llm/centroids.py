"""Operator 13, centroid clustering: Lloyd's rounds over vectors that are sharded by dimension.

Vectors are cut into chunks of `CHUNK` rows and each chunk into column blocks of `WIDTH` components, a row
for each (chunk, block). A round has three steps, and none needs a whole vector in one place:
a column-block task computes the exact partial squared distances of its rows from its slice of the
centroids; the blocks of a chunk are added by key and the argmin taken; the assignments, one number a
vector, go back to the column blocks, which add up their own components by cluster and so update their
own slice. The blocks lie partitioned by (chunk, block) through all rounds, so only partial distances and
assignments are shuffled. What reaches the driver is k x d integers a round. All arithmetic is in
integers: 64 bits in a task, decimals across tasks.

Kept are vectors of exactly `components` components, none null, NaN or infinite; component x becomes
floor(SCALE * x). A null vector isn't kept. The ids of vectors may be null (hashed last when centroids are
chosen) or repeat: each row is a vector of its own, and of equal hashes the smaller vector comes first.
With fewer than k kept vectors there are as many centroids as vectors; without any, the result is empty. A
component of 2^17 or more in absolute value would make distances that pass 64 bits; it stops the job
with an error that says so. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, shared_folder, table, written
from .suffix_tree import pack_numbers, unpack_numbers

COMPONENTS, CLUSTERS, ROUNDS, SCALE = 64, 8, 10, 1024
#: Components of a column block; vectors of a chunk.
WIDTH, CHUNK = 16, 4096
#: Components of this size in absolute value or more are refused.
TOO_LARGE = 1 << 17


def kept(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id long, q array<long>) of the vectors that count."""
    x = F.col("x")
    whole = (F.size(x) == components) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    integer = lambda v: F.when(F.abs(v) < TOO_LARGE, F.floor(v * SCALE)).otherwise(F.raise_error(F.lit("a component of 2^17 or more: distances would pass 64 bits")).cast("long"))
    named = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("x"))
    return named.where(F.coalesce(whole, F.lit(False))).select("vec_id", F.transform(x, integer).alias("q"))


def _pack(values: np.ndarray) -> bytes:
    """Integers of any sign."""
    values = values.reshape(-1)
    return pack_numbers(((values << 1) ^ (values >> 63)).view(np.uint64))


def _unpack(raw: bytes, columns: int) -> np.ndarray:
    values = unpack_numbers(raw)
    return ((values >> np.uint64(1)) ^ (np.uint64(0) - (values & np.uint64(1)))).view(np.int64).reshape(-1, columns)


BLOCKS = "chunk long, block int, width int, ids binary, data binary"


def _blocks(components: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 32
        edges = list(range(0, components, width))
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                piece = batch.slice(start, CHUNK)
                q = piece.column("q").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, components)
                ids = piece.column("vec_id").fill_null(0).to_numpy().astype("<i8").tobytes() + piece.column("vec_id").is_valid().to_numpy(zero_copy_only=False).tobytes()
                parts = [np.ascontiguousarray(q[:, e : e + width]) for e in edges]
                yield pa.record_batch(
                    {
                        "chunk": pa.array([at] * len(edges), pa.int64()), "block": pa.array(range(len(edges)), pa.int32()), "width": pa.array([p.shape[1] for p in parts], pa.int32()),
                        "ids": pa.array([ids] + [None] * (len(edges) - 1), pa.binary()), "data": pa.array([_pack(p) for p in parts], pa.binary()),
                    }
                )
                at += 1

    return run


PARTS = "chunk long, ids binary, part binary"


def _partial(slices: list[np.ndarray], with_ids: bool):
    """Exact squared distances of a block's rows from each centroid's slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, width = batch.column("block")[i].as_py(), batch.column("width")[i].as_py()
                x = _unpack(batch.column("data")[i].as_py(), width)
                part = np.empty((len(x), len(slices[block])), np.int64)
                for j, c in enumerate(slices[block]):
                    off = x - c
                    part[:, j] = np.einsum("ij,ij->i", off, off)
                ids = batch.column("ids")[i].as_py() if with_ids else None
                yield pa.record_batch([batch.column("chunk").slice(i, 1), pa.array([ids], pa.binary()), pa.array([_pack(part)], pa.binary())], names=["chunk", "ids", "part"])

    return run


def _nearest(k: int, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    total = sum(_unpack(raw, k) for raw in rows["part"])
    near = np.argmin(total, axis=1)  # of equal ones the first
    return near, total[np.arange(len(near)), near]


def _assign(k: int, blocks: int):
    """The assignment of a chunk, once for each column block."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        near, _ = _nearest(k, rows)
        raw = pack_numbers(near.astype(np.uint64))
        return pd.DataFrame({"chunk": [rows["chunk"].iloc[0]] * blocks, "block": np.arange(blocks, dtype=np.int32), "near": [raw] * blocks})

    return run


def _last(k: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        near, distance = _nearest(k, rows)
        raw = next(x for x in rows["ids"] if x is not None)
        ids, valid = np.frombuffer(raw, "<i8", len(near)), np.frombuffer(raw, bool, offset=8 * len(near))
        return pd.DataFrame({"vec_id": pd.arrays.IntegerArray(ids.astype(np.int64), ~valid), "cluster": near.astype(np.int32), "distance": distance})

    return run


SUMS = "block int, place int, cluster int, total long, n long"


def _sums(k: int):
    """Sums of a task's components by block, component and cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                x, near = _unpack(row["data"], row["width"]), unpack_numbers(row["near"]).astype(np.int64)
                total, n = held.setdefault(row["block"], (np.zeros((k, row["width"]), np.int64), np.zeros(k, np.int64)))
                n += np.bincount(near, minlength=k)
                for j in np.unique(near):
                    total[j] += x[near == j].sum(axis=0)
        for block, (total, n) in held.items():
            cluster, place = (a.reshape(-1) for a in np.indices(total.shape))
            yield pa.record_batch([pa.array(np.full(total.size, block), pa.int32()), pa.array(place, pa.int32()), pa.array(cluster, pa.int32()), pa.array(total.reshape(-1)), pa.array(n[cluster])], names=[x.split()[0] for x in SUMS.split(", ")])

    return run


def first_centroids(vectors: DataFrame, k: int, prefix: str) -> np.ndarray:
    """The k vectors with the smallest hashes of their ids; what comes to the driver is k rows."""
    name = F.sha2(F.concat(F.lit(prefix), F.col("vec_id").cast("string")), 256)
    return np.array([r.q for r in vectors.orderBy(name.asc_nulls_last(), "q").limit(k).collect()], np.int64)


def clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS, prefix: str = "3:", width: int = WIDTH, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, a row for each vector that counts."""
    spark = vectors.sparkSession
    vectors = kept(vectors, id_col, vec_col, components)
    centroids = first_centroids(vectors, k, prefix)
    k = len(centroids)
    if not k:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    edges = list(range(0, components, width))
    path = f"{shared_folder(spark)}/statuta-{uuid.uuid4().hex}"
    vectors.mapInArrow(_blocks(components, width), BLOCKS).write.parquet(path)
    blocks = spark.read.schema(BLOCKS).parquet(path).repartition(partitions(spark), "chunk", "block").persist(StorageLevel.MEMORY_AND_DISK)
    slices = lambda: [centroids[:, e : e + width].copy() for e in edges]
    for _ in range(rounds):
        near = blocks.mapInArrow(_partial(slices(), False), PARTS).groupBy("chunk").applyInPandas(_assign(k, len(edges)), "chunk long, block int, near binary")
        sums = blocks.join(near, ["chunk", "block"]).select("block", "width", "data", "near").mapInArrow(_sums(k), SUMS)
        total = sums.groupBy("block", "place", "cluster").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").cast("decimal(38,0)").alias("n")).where("n > 0")
        for r in total.select("block", "place", "cluster", F.expr("cast((total - pmod(total, n)) div n as long)").alias("x")).collect():  # k x d numbers
            centroids[r.cluster, edges[r.block] + r.place] = r.x
    rows = written(blocks.mapInArrow(_partial(slices(), True), PARTS).groupBy("chunk").applyInPandas(_last(k), "vec_id long, cluster int, distance long"))
    blocks.unpersist()
    inertia = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    told = [(j, inertia.get(j, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(centroids)]
    by_cluster = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(by_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))
