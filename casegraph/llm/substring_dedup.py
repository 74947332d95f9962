"""Substring deduplication with fixed-block anchors.

Every document's words are cut into non-overlapping reference blocks of BLOCK words. Every rolling window of BLOCK words of
every document probes the index of those blocks. A repeat of WINDOW >= 2 * BLOCK - 1 words holds at least one whole
reference block, so a window without a hit can't repeat. Around the hits, the windows of WINDOW words are compared
themselves, which extends each hit to the maximal run of words that repeats exactly. Windows are told apart by two hashes
over two independent hashes of each word, 128 bits in all.

Documents are dealt to shards. A shard sends each bucket of the index the distinct hashes it has there (one entry however
many documents of the shard share it, so a passage in a third of all documents costs an entry per shard), and gets back
those that hit. Messages number shards times buckets at most, and never more than the shards' distinct blocks, so beyond
about a million shards a message holds few of them. No table of pairs is made, and nothing is sent to the driver but one sum.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bucket_runs, cells, hash_words, inside, joined, owner, pieces, rolling, shard_count, sharded, table

WINDOW, BLOCK = 50, 25
LAST = np.iinfo(np.int64).max  # stands for a missing id: after all others


def _docs(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, two hashes of each word, and offsets."""
    h, other, offsets = hash_words(t["text"], fold_case=False, keys=("0123456789123456", "9e3779b97f4a7c15"))
    return t["doc_id"].fill_null(LAST).to_numpy(), h, other, offsets


def _anchors(h: np.ndarray, offsets: np.ndarray, n: int, window: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the rolling blocks of documents that are long enough, and their cells."""
    at = inside(offsets, block)
    own = owner(offsets)
    at = at[np.diff(offsets)[own[at]] >= window]
    return at, cells(rolling(h, block, 0x9E3779B97F4A7C15)[at], n)


def _long_hashes(h: np.ndarray, other: np.ndarray, at: np.ndarray, window: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the windows that start at at; the second one carries the bucket."""
    return rolling(h, window, 0xD6E8FEB86659FD93)[at], cells(rolling(other, window, 0xA0761D6478BD642F)[at], n)


def _candidates(h, offsets, n, window, block, hits: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold a block which hit. hits: sorted cells."""
    at, cell = _anchors(h, offsets, n, window, block)
    found = np.zeros(int(offsets[-1]) + 1, np.int64)
    if len(hits) and len(at):
        where = np.searchsorted(hits, cell)
        found[at[hits[np.minimum(where, len(hits) - 1)] == cell]] = 1
    below = np.concatenate([[0], np.cumsum(found)])
    starts = inside(offsets, window)
    return starts[below[starts + window - block + 1] > below[starts]]


def _unique_windows(doc, own, at, one, two):
    """Distinct windows in bucket order, the smallest id that has each, and for each start the index of its window."""
    order = np.lexsort((doc[own[at]], one, two))
    one, two = one[order], two[order]
    new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]) if len(one) else np.zeros(0, bool)
    index = np.empty(len(order), np.int64)
    index[order] = np.cumsum(new) - 1
    return one[new], two[new], doc[own[at]][order][new], index


def substring_dedup(docs: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Removes each word covered by a window whose words also start a window in a document with a smaller id.

    docs: (doc_id, text), further columns are ignored; doc_id is an integer. Returns (doc_id, n_words, n_removed, kept_sha256, kept_text), one row
    for each input row. Windows are judged on the input. A null text is empty: 0 words. A row without an id counts as
    coming after all others: it loses what any document with an id has, and takes nothing from anyone. Rows that repeat
    an id are one document, so they don't take from each other. A document shorter than the window keeps all words.
    An empty table gives an empty result.
    """
    if window < 2 * block - 1:
        raise ValueError("window must be at least 2 * block - 1, or a repeat may hold no whole block")
    n = shard_count(docs)
    parts = sharded(docs, n)

    def probe(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        doc, h, other, offsets = _docs(t)
        at, cell = _anchors(h, offsets, n, window, block)
        own = owner(offsets)
        order = np.lexsort((doc[own[at]], cell))
        cell, who, aligned = cell[order], doc[own[at]][order], ((at - offsets[own[at]]) % block == 0)[order]
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
        last = np.concatenate([first[1:], [len(cell)]]) - 1 if len(cell) else first
        flags = np.zeros(len(first), np.uint8)
        if len(first):
            flags = (np.maximum.reduceat(aligned.astype(np.uint8), first) | ((who[first] != who[last]).astype(np.uint8) << 1)).astype(np.uint8)
        buckets, starts = bucket_runs(cell[first])
        return pa.table({"bucket": pa.array(buckets, pa.int32()), "shard": pa.array(np.full(len(buckets), key[0].as_py()), pa.int32()), "keys": pieces(cell[first].astype(np.uint32), starts), "flags": pieces(flags, starts)})

    def match(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        keys, sizes = joined(t["keys"], "<u4")
        flags, _ = joined(t["flags"], "u1")
        uniq, index, count = np.unique(keys, return_inverse=True, return_counts=True)
        aligned, several = np.zeros(len(uniq), bool), count > 1
        aligned[index[flags & 1 > 0]] = True
        several[index[flags & 2 > 0]] = True
        hit = (aligned & several)[index]
        row = np.repeat(np.arange(len(sizes)), sizes)[hit]
        rows, first = np.unique(row, return_index=True)
        return pa.table({"shard": t["shard"].combine_chunks().take(pa.array(rows)) if len(rows) else pa.array([], pa.int32()), "bucket": pa.array(np.full(len(rows), key[0].as_py()), pa.int32()), "keys": pieces(keys[hit], np.append(first, len(row)))})

    def hits_of(replies: pa.Table) -> np.ndarray:
        keys, sizes = joined(replies["keys"], "<u4")
        return np.sort((np.repeat(replies["bucket"].to_numpy().astype(np.uint64), sizes) << np.uint64(32)) | keys.astype(np.uint64))

    def extend(key: tuple[pa.Scalar, ...], t: pa.Table, replies: pa.Table) -> pa.Table:
        doc, h, other, offsets = _docs(t)
        at = _candidates(h, offsets, n, window, block, hits_of(replies))
        one, two, least, _ = _unique_windows(doc, owner(offsets), at, *_long_hashes(h, other, at, window, n))
        buckets, starts = bucket_runs(two)
        return pa.table({"bucket": pa.array(buckets, pa.int32()), "shard": pa.array(np.full(len(buckets), int(key[0].as_py())), pa.int32()), "one": pieces(one, starts), "two": pieces(two.astype(np.uint32), starts), "least": pieces(least, starts)})

    def first_owner(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        one, sizes = joined(t["one"], "<u8")
        two, _ = joined(t["two"], "<u4")
        least, _ = joined(t["least"], "<i8")
        order = np.lexsort((least, one, two))
        new = np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])])
        best = np.empty(len(order), np.int64)
        best[order] = least[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
        return pa.table({"shard": t["shard"].combine_chunks(), "bucket": t["bucket"].combine_chunks(), "best": pieces(best, np.append(0, np.cumsum(sizes)))})

    hits = parts.groupBy("shard").applyInArrow(probe, "bucket int, shard int, keys binary, flags binary").groupBy("bucket").applyInArrow(match, "shard int, bucket int, keys binary")
    asked = parts.groupBy("shard").cogroup(hits.groupBy("shard")).applyInArrow(extend, "bucket int, shard int, one binary, two binary, least binary")
    answers = asked.groupBy("bucket").applyInArrow(first_owner, "shard int, bucket int, best binary")
    both = hits.selectExpr("shard", "bucket", "keys", "CAST(NULL AS binary) best").unionByName(answers.selectExpr("shard", "bucket", "CAST(NULL AS binary) keys", "best"))

    def cut(key: tuple[pa.Scalar, ...], t: pa.Table, replies: pa.Table) -> pa.Table:
        doc, h, other, offsets = _docs(t)
        kind = replies["best"].is_valid()
        at = _candidates(h, offsets, n, window, block, hits_of(replies.filter(replies["keys"].is_valid())))
        own = owner(offsets)
        _, _, _, index = _unique_windows(doc, own, at, *_long_hashes(h, other, at, window, n))
        best, _ = joined(replies.filter(kind).sort_by("bucket")["best"], "<i8")
        at = at[best[index] < doc[own[at]]] if len(at) else at
        edge = np.zeros(int(offsets[-1]) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
        gone = np.cumsum(edge)[:-1] > 0
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[offsets])
        kept = []
        for k, text in enumerate(t["text"].to_pylist()):
            words = text.encode().split()
            if removed[k]:
                words = [w for w, g in zip(words, gone[offsets[k]:offsets[k + 1]]) if not g]
            kept.append(b" ".join(words))
        return pa.table({"doc_id": t["doc_id"].combine_chunks(), "n_words": pa.array(np.diff(offsets), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), "kept_text": pa.array([x.decode() for x in kept], pa.string())})

    return parts.groupBy("shard").cogroup(both.groupBy("shard")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
m AS (SELECT s, min(doc_id) AS least FROM s GROUP BY s HAVING count(*) > 1),
lost AS (SELECT DISTINCT doc_id, i FROM s JOIN m USING (s) WHERE least < doc_id),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run
    FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM lost)) GROUP BY doc_id, run),
cuts AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM runs GROUP BY doc_id),
kept AS (SELECT d.doc_id, len(w) AS n, coalesce(n_removed, 0) AS n_removed, CASE WHEN a IS NULL THEN w ELSE flatten([w[list_extract([0] || b, k) + 1:list_extract(a || [len(w)], k)] FOR k IN range(1, len(a) + 2)]) END AS kept FROM d LEFT JOIN cuts ON d.doc_id = cuts.doc_id)
SELECT doc_id, n AS n_words, n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM kept
"""
