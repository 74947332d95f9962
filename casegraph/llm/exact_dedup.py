"""Exact deduplication by a 128-bit content hash, with the bytes compared inside each hash group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table, written

#: What normalising deletes: space, and \x09 to \x0D.
BLANKS = r"[\x20\x09-\x0D]+"


def exact_dedup(docs: DataFrame, hash128: Callable[[Column], Column] = F.md5) -> DataFrame:
    """Groups texts that are identical after deleting blanks, and names the row of each group that stays.

    docs: (doc_id, text), further columns are ignored. Returns (doc_id, keep_id, group_size, kept, text_sha256), one row for
    each input row. Of equal texts, the row with the most code points in its original text stays, then the one with the
    smallest doc_id; a missing id comes after all others. A null text counts as empty, and empty texts equal one another.
    Rows that repeat an id are one document: they count in group_size, and are kept or dropped together. An empty table
    gives an empty result.

    The grouping key is the hash followed by the text itself, so texts that share a hash by accident stay apart; copies are
    combined before the shuffle, so a text that a third of all rows share costs a row per task. hash128 is a parameter so
    that collisions can be tested.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id"), F.char_length(text).alias("n"), F.regexp_replace(text, BLANKS, "").alias("norm"))
    rows = rows.select("doc_id", "n", "norm", hash128(F.col("norm")).alias("h"), F.sha2(F.col("norm"), 256).alias("text_sha256"))
    first = F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("id")))
    groups = rows.groupBy("h", "norm").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"), F.first("text_sha256").alias("text_sha256"))
    groups = groups.select("h", "text_sha256", F.col("first.id").alias("keep_id"), "group_size")
    clash = F.assert_true(F.count(F.lit(1)) == 1, F.lit("two texts agree in both hashes"))
    groups = groups.groupBy("h", "text_sha256").agg(F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size"), clash.alias("checked"))
    groups = written(groups, "exact-groups")  # so that the join below shuffles both sides, and a hot group can be split
    out = rows.select("doc_id", "h", "text_sha256").join(groups, ["h", "text_sha256"])
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)
"""
