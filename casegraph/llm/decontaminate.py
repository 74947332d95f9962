"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

A window of an item is the set of its positioned shingles, and occurs in a document only if all of them do. So one necessary
token is enough to find it: the window's rarest shingle, by its count over the whole corpus. The documents' shingles are
joined with these prefix tokens; offset and length bound where the window can start; what is left is compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegralType

from .common import table, written

WINDOW, SHINGLE = 10, 5
#: Rows, and bytes of words and ids, of a benchmark-side table that is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, UPPER.lower()), F.lit(WORD), F.lit(0))


def shingles(words: str, size: int) -> Column:
    """array<struct<pos, h>>: the hash of size words from each position (from 1) where they fit."""
    n = F.size(words)
    at = F.when(n >= size, F.sequence(F.lit(1), n - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("pos"), F.xxhash64(F.slice(F.col(words), i, F.lit(size)), F.lit(size)).alias("h")))


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, wlen, wwords): the windows of each item."""
    words = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    return words.select("item_id", n.alias("wlen"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice(F.col("w"), i, n))).alias("wwords"))


def small(df: DataFrame, *texts: str) -> DataFrame:
    """Broadcast if its rows, counted, and the bytes of its columns of texts are within the bounds; other columns are numbers."""
    size = sum((F.octet_length(F.array_join(c, " ")) for c in texts), F.lit(0)).cast("long")
    rows, size = df.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Marks the documents that hold a window of consecutive words of a benchmark item.

    docs: (doc_id, text), items: (item_id, text), ids of any type; further columns are ignored. Returns (doc_id, n_words, n_hit, n_items,
    items_sha256, contaminated), one row for each row of docs. A null text has no words; an item without words has no
    window; an item shorter than the window is one window. Repeated items and repeated documents are each judged on their
    own, an item_id that is null names no item but its windows still count as hits. With no documents the result is empty,
    with no items nothing is contaminated.
    """
    each = written(item_windows(items, window), "leak-items")
    # numbers instead of hashes: two windows never share one, and once written they stay
    wins = written(each.select("wlen", "wwords").distinct().select(F.monotonically_increasing_id().alias("wid"), "wlen", "wwords", F.least("wlen", F.lit(shingle)).alias("s")), "leak-windows")
    sizes = [r["s"] for r in wins.select("s").distinct().collect()]  # at most SHINGLE rows
    tokens = F.concat(*[shingles("wwords", s) for s in sizes]) if sizes else F.array().cast("array<struct<pos:int,h:bigint>>")
    parts = written(wins.select("wid", "wlen", "s", F.explode(tokens).alias("t")).select("wid", "wlen", F.col("t.pos").alias("off"), F.col("t.h").alias("h")), "leak-tokens")

    # documents that share a key only share what is then compared with each one's words
    whole = isinstance(docs.schema["doc_id"].dataType, IntegralType)
    key = F.coalesce(F.col("doc_id").cast("long") if whole else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    base = docs.select(key.alias("key"), words_of(F.col("text")).alias("words")).select("key", F.size("words").alias("n"), "words")
    made = F.concat(*[shingles("words", s) for s in sizes]) if sizes else F.array().cast("array<struct<pos:int,h:bigint>>")
    seen = base.select("key", "n", F.explode(made).alias("t")).select("key", "n", F.col("t.pos").alias("pos"), F.col("t.h").alias("h"))
    hits = written(seen.join(small(parts.select("h").distinct()), "h", "left_semi"), "leak-hits")

    rarity = hits.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    ranked = parts.join(rarity, "h", "left").groupBy("wid", "wlen").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h", "off")).alias("rarest"))
    prefix = ranked.where("rarest.df > 0").select("wid", "wlen", F.col("rarest.h").alias("h"), F.col("rarest.off").alias("off"))
    prefix = written(prefix, "leak-prefix")
    start = F.col("pos") - F.col("off") + 1
    maybe = hits.join(small(prefix), "h").where((start >= 1) & (start + F.col("wlen") - 1 <= F.col("n"))).select("key", "wid", start.alias("start"))
    maybe = maybe.distinct().join(small(wins.select("wid", "wlen", "wwords"), "wwords"), "wid")
    found = maybe.groupBy("key").agg(F.collect_list(F.struct("start", "wlen", "wwords", "wid")).alias("maybe"))

    rows = docs.select("doc_id", key.alias("key"), F.col("text")).join(found, "key", "left").select("doc_id", "key", words_of(F.col("text")).alias("words"), "maybe")
    sure = F.filter("maybe", lambda c: F.slice(F.col("words"), c["start"], c["wlen"]) == c["wwords"])
    none = F.array().cast("array<struct<start:int,wlen:int,wwords:array<string>,wid:bigint>>")
    rows = rows.select("doc_id", "key", F.size("words").cast("long").alias("n_words"), F.coalesce(F.when(F.size("words") > 0, sure), none).alias("sure"))
    covered = F.array_distinct(F.flatten(F.transform("sure", lambda c: F.sequence(c["start"], c["start"] + c["wlen"] - 1))))
    wids = F.array_sort(F.array_distinct(F.transform("sure", lambda c: c["wid"])))
    rows = written(rows.select("doc_id", "key", "n_words", F.size(covered).cast("long").alias("n_hit"), wids.alias("wids")), "leak-rows")
    # the items of the windows come last, for documents that hold any: a window may be in any number of items
    names = each.join(wins.select("wid", "wwords"), "wwords").where("item_id IS NOT NULL").select("wid", "item_id").distinct()
    named = rows.where("n_hit > 0").select("key", "wids").distinct().withColumn("wid", F.explode("wids")).join(names, "wid").groupBy("key", "wids").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    hit = rows.where("n_hit > 0").join(named, ["key", "wids"], "left")
    rows = rows.where("n_hit = 0").withColumn("items", F.lit(None).cast("array<string>")).unionByName(hit).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS k, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS g
       FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS g
       FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, ks WHERE len(ws) >= k)),
m AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.k = iw.k),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
n AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM m GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""
