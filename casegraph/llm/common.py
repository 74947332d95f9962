"""Helpers that several text operators share: folders, shards and rolling hashes."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Text that one shard should hold; a shard is what one Python call sees.
SHARD_BYTES = 8 << 20


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, or below a temporary one where that is unset on a single machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="casegraph-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shard_count(docs: DataFrame) -> int:
    """Shards of about SHARD_BYTES, and enough of them to occupy every shuffle partition."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(math.ceil(total / SHARD_BYTES), least)


def sharded(docs: DataFrame, n: int) -> DataFrame:
    """(shard, doc_id, text) with rows dealt evenly over n shards by a hash of the id.

    Rows without an id are dealt by their text, so they don't meet in one shard.
    """
    key = F.coalesce(F.xxhash64("doc_id", F.lit(7)), F.lit(0))
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(key)
    return docs.select(F.pmod(key, F.lit(n)).cast("int").alias("shard"), F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def hash_words(texts: pa.ChunkedArray | pa.Array, fold_case: bool, keys: tuple[str, ...] = ("0123456789123456",)) -> tuple[np.ndarray, ...]:
    """Hashes of all words [^\\x20\\x09-\\x0D]+ of the texts in one run, one array for each key, and for each text where its words start (one more at the end)."""
    texts = pc.cast(texts, pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
    if fold_case:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    coded = words.dictionary_encode()
    if len(coded.dictionary) == 0:
        return *(np.zeros(0, np.uint64) for _ in keys), np.zeros(len(texts) + 1, np.int64)
    distinct = coded.dictionary.to_pandas().to_numpy(dtype=object)
    hashes = [pd.util.hash_array(distinct, hash_key=k, categorize=False) for k in keys]
    codes = coded.indices.to_numpy(zero_copy_only=False)
    full = pc.not_equal(pc.binary_length(coded.dictionary), 0).to_numpy(zero_copy_only=False)
    if not full.all():  # blanks at the ends of a text give empty words
        keep = full[codes]
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
    return *(h[codes] for h in hashes), offsets


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of a 64-bit hash (the finaliser of a well-known mixer)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def rolling(h: np.ndarray, size: int, base: int) -> np.ndarray:
    """The hash of h[i:i+size] at each i where it fits, as a polynomial modulo 2**64; base is odd."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    b = np.uint64(base)
    with np.errstate(over="ignore"):
        # doubling: the hash of a run of 2k words comes from two runs of k
        done, run, length, power, rest = 0, h, 1, b, size
        while rest:
            if rest & 1:
                out = out * power + run[done:done + n]
                done += length
            rest >>= 1
            if rest:
                run = run[:-length] * power + run[length:]
                power = power * power
                length *= 2
        return mixed(out)


def owner(offsets: np.ndarray) -> np.ndarray:
    """For each word, the index of its text."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def inside(offsets: np.ndarray, size: int) -> np.ndarray:
    """The starts of all windows of size words that stay within a text."""
    total = int(offsets[-1])
    if total < size:
        return np.zeros(0, np.int64)
    own = owner(offsets)
    starts = np.arange(total - size + 1)
    return starts[own[starts] == own[starts + size - 1]]


def cells(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash as bucket << 32 | key, for n buckets."""
    return (((h >> np.uint64(32)) % np.uint64(n)) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def bucket_runs(sorted_cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets present in sorted cells, and where each one's run starts (one more at the end)."""
    b = (sorted_cells >> np.uint64(32)).astype(np.int32)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(b)) + 1, [len(b)]]) if len(b) else np.zeros(1, np.int64)
    return (b[starts[:-1]] if len(b) else b), starts


def pieces(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """values cut at starts, each run as binary."""
    raw = np.ascontiguousarray(values).view(np.uint8).tobytes()
    width = values.dtype.itemsize
    at = starts.astype(np.int64) * width
    return pa.array([raw[a:b] for a, b in zip(at[:-1], at[1:])], pa.binary())


def joined(column: pa.ChunkedArray, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """All binary values of a column as one array, and the length of each."""
    parts = [np.frombuffer(x, dtype) for x in column.to_pylist() if x is not None]
    return (np.concatenate(parts) if parts else np.zeros(0, dtype)), np.array([len(p) for p in parts], np.int64)


def packed(**columns: pa.Array) -> bytes:
    """Columns of one length as a compressed Arrow stream."""
    batch = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(body).read_all()


def grouped(keys: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys in order, how many there are of each, and the sums of further integers by key."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(keys) else np.zeros(0, np.int64)
    return ordered[first], np.diff(np.append(first, len(keys))), *(np.add.reduceat(x[order], first) if len(keys) else x for x in sums)


def release() -> None:
    """Gives memory that is free back to the system: workers live on, and would keep what their largest task took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def key_of(*columns: str) -> Column:
    return F.xxhash64(*columns)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) for each id in edges (a, b): component is the smallest id reachable.

    Every round each node takes the smallest label among itself and its neighbours, then the label of its label
    (pointer jumping), so the number of rounds follows the logarithm of a chain's length rather than the length. A round is
    a join and a map-side-combined minimum; its result is written to the shared folder.
    """
    spark = edges.sparkSession
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{name}-edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), f"{name}-0")
    for k in range(1, 200):
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", "component", F.least("component", "near").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("component").alias("jumped"))
        step = step.join(jump, "next", "left").select("id", F.col("component").alias("was"), F.least("next", F.coalesce("jumped", "next")).alias("component"))
        step = written(step, f"{name}-{k}")
        labels = step.select("id", "component")
        if step.where("was <> component").isEmpty():
            return labels
    raise RuntimeError("components did not settle in 200 rounds")
