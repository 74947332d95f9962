"""The same operators over arriving files, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators.cluster import trigger_hits
from ..operators.rules import FAMILIES, Family


def stream_ingest(spark: SparkSession, path: str, schema: StructType | str, form: str = "json", files: int = 100) -> DataFrame:
    """Records that land in a folder, some files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(form).load(path)


def once(stream: DataFrame, key: str = "doc_id", time: str = "timestamp", late: str = "1 hour") -> DataFrame:
    """Each document once, as long as its copies come within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def stream_hits(stream: DataFrame, families: tuple[Family, ...] = FAMILIES, late: str = "1 hour") -> DataFrame:
    """Trigger groups for each constructor, host and bucket; families of one window length above 0 at a time."""
    sizes = {f.window for f in families}
    if len(sizes) != 1 or not min(sizes):
        raise ValueError("stream_hits takes families with one and the same window above 0")
    hits = trigger_hits(stream.withWatermark("timestamp", late), families)
    groups = hits.groupBy("constructor", "host_name", "who", F.window("timestamp", f"{sizes.pop()} seconds"))
    return groups.agg(F.array_sort(F.collect_set("trigger")).alias("triggers_fired"), F.max("base").alias("base_score"), F.count(F.lit(1)).alias("n")).select("constructor", "host_name", "who", F.unix_timestamp("window.start").alias("bucket"), "triggers_fired", "base_score", "n")


def stream_burst(stream: DataFrame, keys: list[str], size: str, step: str, least: int, late: str = "1 hour") -> DataFrame:
    """Sliding windows with more than least events of their keys."""
    out = stream.withWatermark("timestamp", late).groupBy(*keys, F.window("timestamp", size, step)).agg(F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n") > least).select(*keys, F.unix_timestamp("window.start").alias("start"), "n")


def stream_sessions(stream: DataFrame, keys: list[str], gap: str, late: str = "1 hour") -> DataFrame:
    out = stream.withWatermark("timestamp", late).groupBy(*keys, F.session_window("timestamp", gap)).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*keys, F.unix_timestamp("session_window.start").alias("start"), F.unix_timestamp("session_window.end").alias("end"), "n")


def merge_each_batch(stream: DataFrame, merge: Callable[[DataFrame], None], checkpoint: str):
    """Runs merge on every micro-batch, such as a graph upsert."""
    return stream.writeStream.foreachBatch(lambda df, _: merge(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Takes what is there, writes it as Parquet and reads it back."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
