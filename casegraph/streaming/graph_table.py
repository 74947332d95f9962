"""A graph that grows with each micro-batch: entities and edges in buckets of their ids, of which a batch rewrites those it touches.

A table is a folder: data of a kind at kind/version=V/bucket=B, and a log with one entry for each batch that says which version of which
buckets it wrote. A bucket's content is that of its last version. A batch first writes its versions, then its log entry; what has
no entry is not part of the table, so a batch that fails leaves no trace, and a batch that comes again is recognised by its entry.
One stream writes a table at a time, as foreachBatch does.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.graph import edges, entities

BUCKETS = 64
LOG = "batch long, kind string, bucket int, version string, n_rows long, n_new long"
#: How two states of one id become one.
MERGE = {
    "entities": ("entity_id", {"case_id": F.first, "entity_type": F.first, "entity_key": F.first, "first_seen": F.min, "last_seen": F.max, "seen_count": F.sum, "internal": F.first}),
    "edges": ("edge_id", {"case_id": F.first, "from_id": F.first, "to_id": F.first, "edge_type": F.first, "timestamp": F.min}),
}


def log_of(spark: SparkSession, path: str) -> DataFrame:
    """(batch, kind, bucket, version, n_rows, n_new): a row for each bucket that a batch wrote, and one with a null bucket for the batch itself."""
    try:
        return spark.read.schema(LOG).json(f"{path}/log/batch_*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


def read_graph(spark: SparkSession, path: str, kind: str, buckets: list[int] | None = None) -> DataFrame | None:
    """The present rows of a kind, or of some of its buckets; None if there are none."""
    log = log_of(spark, path).where((F.col("kind") == kind) & F.col("bucket").isNotNull())
    last = log.groupBy("bucket").agg(F.max_by("version", "batch").alias("version"))
    folders = [f"{path}/{kind}/version={r['version']}/bucket={r['bucket']}" for r in last.collect() if buckets is None or r["bucket"] in buckets]  # at most as many as buckets
    key, how = MERGE[kind]
    return spark.read.parquet(*folders).select(key, *how) if folders else None


def merge_graph(events: DataFrame, batch: int, path: str, buckets: int = BUCKETS, any_process: bool = True) -> dict[str, int]:
    """Merges the entities and edges of canonical events into the table at path, once for each number of batch.

    Of an entity the earliest first_seen, the latest last_seen and the sum of the counts stay; equal edges are one. Returns how many
    entities and edges were new, and how many were there; a batch that comes again changes nothing and returns what its log entry says.
    """
    spark = events.sparkSession
    done = log_of(spark, path).where(F.col("batch") == batch)
    if done.isEmpty():
        version, entries = f"{batch:010d}-{uuid.uuid4().hex[:8]}", [(batch, "batch", None, None, 0, 0)]
        for kind, rows in (("entities", entities(events, any_process)), ("edges", edges(events, any_process))):
            entries += _merge(spark, rows, kind, batch, version, path, buckets)
        spark.createDataFrame(entries, LOG).coalesce(1).write.json(f"{path}/log/batch_{batch:010d}")
        done = log_of(spark, path).where(F.col("batch") == batch)
    sums = {r["kind"]: (r["n"], r["old"]) for r in done.where("bucket IS NOT NULL").groupBy("kind").agg(F.sum("n_new").alias("n"), F.sum(F.col("n_rows") - F.col("n_new")).alias("old")).collect()}
    return {f"{kind}_{what}": sums.get(kind, (0, 0))[k] for kind in MERGE for k, what in enumerate(("new", "seen"))}


def _merge(spark: SparkSession, rows: DataFrame, kind: str, batch: int, version: str, path: str, buckets: int) -> list[tuple]:
    """Writes the touched buckets anew. Returns their entries of the log: rows of the batch, and how many of those were new."""
    key, how = MERGE[kind]
    number = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    rows = rows.withColumns({"bucket": number, "fresh": F.lit(True)})
    touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most as many as buckets
    if not touched:
        return []
    before = read_graph(spark, path, kind, touched)
    if before is not None:
        rows = rows.unionByName(before.withColumns({"bucket": number, "fresh": F.lit(False)}))
    merged = rows.groupBy("bucket", key).agg(*[f(c).alias(c) for c, f in how.items()], F.max("fresh").alias("hit"), F.min("fresh").alias("new"))
    folder = f"{path}/{kind}/version={version}"
    merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
    counts = spark.read.parquet(folder).groupBy("bucket").agg(F.sum(F.col("hit").cast("long")).alias("n_rows"), F.sum(F.col("new").cast("long")).alias("n_new"))
    return [(batch, kind, int(r["bucket"]), version, r["n_rows"], r["n_new"]) for r in counts.collect()]


def graph_of(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The table's entities or edges, in the columns of entities() or edges()."""
    rows = read_graph(spark, path, kind)
    if rows is None:
        raise ValueError(f"no {kind} at {path}")
    return rows


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes the versions of buckets that a later batch has replaced, or that no batch has entered in the log. Not while a batch runs."""
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    log = log_of(spark, path).where("bucket IS NOT NULL").groupBy("kind", "bucket").agg(F.max_by("version", "batch").alias("version")).collect()  # at most two for each bucket
    keep, gone = {(r["kind"], r["version"], r["bucket"]) for r in log}, 0
    for kind in MERGE:
        for f in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}/version=*/bucket=*")) or []:
            at = f.getPath()
            if (kind, at.getParent().getName().split("=", 1)[1], int(at.getName().split("=", 1)[1])) not in keep:
                gone += fs.delete(at, True)
    return gone


def stream_graph(stream: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS):
    """Merges every micro-batch of canonical events into the table at path."""
    return stream.writeStream.foreachBatch(lambda df, batch: merge_graph(df, batch, path, buckets) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
