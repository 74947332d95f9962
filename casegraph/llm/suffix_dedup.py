"""Substring deduplication by a suffix array that is cut into ranges.

Two equal strings of WINDOW bytes hold the same smallest KGRAM-byte gram (by a hash, the first of equal ones) at the same offset: their
anchor. So suffixes are taken at anchors only, about one in fourteen positions, and each carries its span: the bytes of
the consecutive windows that have this anchor. A suffix whose gram no other document has at an anchor is dropped: its windows
can't repeat. Equal spans of a shard go on as one, with the smallest id.

The suffixes are range-partitioned by their leading bytes, the gram, at splitters from a sample. A bucket sorts its suffixes by
multikey quicksort, eight bytes at a time within what is still tied, and what precedes them likewise, from the anchor to the left. Windows are
equal if the suffixes share the prefix and the parts before share the suffix that the window holds; both are runs of the sorted
order, bounded by common lengths below that. All bytes are compared. A gram does not cross a boundary between buckets, but for hot
ones: the windows of a gram with over HOT occurrences are suffixes of their own, dealt by a hash of all WINDOW bytes, so
that no bucket gets more than its share, and equal ones meet across the ranges.

Shards and buckets exchange packed messages; the driver gets one sum and the sample. Documents are cut into pieces that overlap by WINDOW - 1 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bucket_runs, cells, joined, mixed, packed, pieces, release, rolling, shard_count, sharded, table, unpacked

WINDOW, KGRAM = 50, 24
#: Occurrences of a gram from which its windows are dealt one by one, bytes that are looked at at once, grams of the sample for each bucket.
HOT, PIECE, SAMPLE = 4096, 1 << 17, 64
#: Grams of the sample in all, down to four for each bucket.
MOST = 1_000_000
LAST = np.iinfo(np.int64).max  # stands for a missing id: after all others
#: A random number for each byte.
CODES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Anchors:
    """The anchors of a shard's texts, piece by piece: the span of each one's windows, its place, its document and the gram's cell."""

    def __init__(self, texts: pa.Array, window: int, kgram: int, n: int):
        texts = texts.cast(pa.binary())
        self.lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = np.append(0, np.cumsum(self.lengths))
        self.data = np.frombuffer(b"".join(texts.to_pylist()), np.uint8)
        found = [self._piece(x, min(x + PIECE, len(self.data)), window, kgram) for x in range(0, len(self.data), PIECE)]
        cat = lambda k, kind: np.concatenate([np.zeros(0, kind), *(f[k] for f in found)])
        self.low, self.high, self.at = cat(0, np.int64), cat(1, np.int64), cat(2, np.int64)  # windows start at low to high
        self.cell = cells(cat(3, np.uint64), n)
        self.doc = np.searchsorted(self.starts, self.low, "right") - 1

    def _piece(self, x: int, y: int, window: int, kgram: int):
        """Of the windows that start from x to y."""
        data = self.data[x:y + window - 1]
        grams = rolling(CODES[data], kgram, 0x9E3779B97F4A7C15)
        width = window - kgram + 1  # grams in a window
        if len(grams) < width:
            return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]
        least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        run, rest = 1, width
        while 2 * run <= width:
            least = np.minimum(least[:-run], least[run:])
            run *= 2
        rest = width - run
        least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
        at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        start = np.arange(x, x + len(at))
        first, last = np.searchsorted(self.starts, x, "right") - 1, np.searchsorted(self.starts, x + len(at), "left")
        ends = np.repeat(self.starts[first + 1:last + 1], np.diff(np.clip(self.starts[first:last + 1], x, x + len(at))))  # of each start's document
        whole = np.flatnonzero(start + window <= ends)
        if not len(whole):
            return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]
        at, start = at[whole], start[whole]
        first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)))
        last = np.append(first[1:], len(start)) - 1
        return start[first], start[last], at[first] + x, grams[at[first]]


def gathered(data: np.ndarray, low: np.ndarray, size: np.ndarray) -> pa.Array:
    """data[low:low + size] for each, as binary."""
    ends = np.append(0, np.cumsum(size))
    at = np.repeat(low - ends[:-1], size) + np.arange(ends[-1])
    return pa.Array.from_buffers(pa.large_binary(), len(low), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[at]))])


def leads(data: np.ndarray, at: np.ndarray, kgram: int) -> np.ndarray:
    """The gram at each place, as fixed bytes that compare as their text does."""
    return np.ascontiguousarray(data[at[:, None] + np.arange(kgram)]).view(f"S{kgram}").ravel() if len(at) else np.zeros(0, f"S{kgram}")


def words_of(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of big-endian numbers of eight bytes."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, :rows.shape[1]] = rows
    return wide.view(">u8").astype(np.uint64)


def multikey_sort(rows: np.ndarray) -> np.ndarray:
    """The order of rows of bytes: by their first eight bytes, then what is tied by the next eight, and so on."""
    words = words_of(rows)
    order = np.argsort(words[:, 0], kind="stable") if words.shape[1] else np.arange(len(rows))
    tied = np.append(False, words[order[1:], 0] == words[order[:-1], 0]) if len(rows) and words.shape[1] else np.zeros(len(rows), bool)
    for k in range(1, words.shape[1]):
        if not tied.any():
            break
        group = np.cumsum(~tied)
        open_ = np.flatnonzero(tied | np.append(tied[1:], False))
        part = order[open_]
        order[open_] = part[np.lexsort((words[part, k], group[open_]))]
        tied[1:] &= words[order[1:], k] == words[order[:-1], k]
    return order


def common_lengths(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each row in order, how many bytes it shares with the one before; -1 for the first."""
    out = np.full(len(order), -1, np.int64)
    if not rows.shape[1]:
        out[1:] = 0
        return out
    for x in range(1, len(order), 1 << 16):
        at = order[x - 1:x + (1 << 16)]
        differ = rows[at[1:]] != rows[at[:-1]]
        out[x:x + len(differ)] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


def lost_windows(spans: pa.Array, at: np.ndarray, doc: np.ndarray, window: int, kgram: int) -> np.ndarray:
    """For each span a mask: bit o is set if the window that starts o bytes before the anchor is also in a span of a smaller id."""
    size = pc.binary_length(spans).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.append(0, np.cumsum(size))
    data = np.append(np.frombuffer(b"".join(spans.to_pylist()), np.uint8), np.uint8(0))
    before = window - kgram

    def around(place: np.ndarray, inside: np.ndarray) -> np.ndarray:
        return np.where(inside, data[np.where(inside, place, len(data) - 1)], 0).astype(np.uint8)

    right, left = np.arange(window), np.arange(before)
    anchor = (ends[:-1] + at)[:, None]
    rights = around(anchor + right, right < (size - at)[:, None])
    lefts = around(anchor - 1 - left, left < at[:, None])
    ranked = []
    for rows in (rights, lefts):
        order = multikey_sort(rows)
        ranked.append((order, common_lengths(rows, order)))

    def classes(k: int, length: int, use: np.ndarray) -> np.ndarray:
        order, common = ranked[k]
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(common < length)
        return out[use]

    mask = np.zeros(len(size), np.uint64)
    for o in range(before + 1):
        use = np.flatnonzero((at >= o) & (size - at >= window - o))
        if not len(use):
            continue
        same = classes(0, window - o, use) * (len(size) + 1) + (classes(1, o, use) if o else 0)
        order = np.lexsort((doc[use], same))
        first = np.flatnonzero(np.append(True, same[order][1:] != same[order][:-1]))
        least = np.repeat(doc[use][order][first], np.diff(np.append(first, len(order))))
        lost = use[order[least < doc[use][order]]]
        mask[lost] |= np.uint64(1 << o)
    return mask


def splitters(docs: DataFrame, n: int, window: int, kgram: int) -> np.ndarray:
    """n - 1 grams that cut the anchors of a sample of documents into equal parts. The sample is bounded, and decides the sizes of buckets only."""
    want, each = max(1000, n // 4), min(SAMPLE, max(MOST // n, 4))
    rows = docs.agg(F.count(F.lit(1))).first()[0]
    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(max(rows // want, 1))) == 0) if rows > want else docs

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                a = Anchors(b.column("text").slice(k, 1), window, kgram, 1)
                pick = np.flatnonzero(mixed(a.cell) % np.uint64(max(len(a.cell) * want // (each * n), 1)) == 0)
                yield pa.RecordBatch.from_arrays([pa.array(leads(a.data, a.at[pick], kgram).tolist(), pa.binary())], ["gram"])

    found = some.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(grams, "gram binary").toArrow()["gram"].to_pylist()
    found = np.sort(np.array(found, f"S{kgram}")) if found else np.zeros(0, f"S{kgram}")
    return found[np.arange(1, n) * len(found) // n] if len(found) >= n else found


def suffix_dedup(docs: DataFrame, window: int = WINDOW, kgram: int = KGRAM, hot: int = HOT, whole: bool = True) -> DataFrame:
    """Removes each byte covered by a string of window bytes that also starts in a document with a smaller id.

    docs: (doc_id, text), further columns are ignored; doc_id is an integer. Returns (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept),
    one row for each input row: bytes of the text, bytes and maximal runs removed, and what is left, which may cut a character;
    whole=False leaves out the last. Strings are judged on the input, and don't cross documents. A null text is empty. A row without an id counts as coming after all
    others: it loses what any document with an id has, and takes nothing from anyone. Rows that repeat an id are one document, so they
    don't take from each other. A document shorter than the window keeps all. An empty table gives an empty result.
    """
    if not 8 <= kgram <= window <= kgram + 63:
        raise ValueError("a gram has 8 bytes at least, and a window as many grams as a mask has bits")
    shards = shard_count(docs)
    n = max(shards // 2, 1)  # buckets
    parts = sharded(docs, shards)
    cuts = docs.sparkSession.sparkContext.broadcast(splitters(docs, n, window, kgram))  # n - 1 grams, as many as there are buckets

    def read(t: pa.Table) -> tuple[pa.Table, Anchors, np.ndarray]:
        """In one order, whatever order the rows come in: pieces, and so spans, have to be the same each time."""
        t = t.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        return t, Anchors(t["text"].combine_chunks(), window, kgram, n), t["doc_id"].fill_null(LAST).to_numpy()

    def probe(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        _, a, ids = read(t)
        who = ids[a.doc]
        order = np.lexsort((who, a.cell))
        cell, who = a.cell[order], who[order]
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
        ends = np.append(first[1:], len(cell))
        several, times = (who[first] != who[ends - 1]).astype(np.uint16) << 15, np.minimum(ends - first, 2**15 - 1).astype(np.uint16)
        buckets, starts = bucket_runs(cell[first])
        codec = pa.Codec("zstd")
        note = [codec.compress(x, asbytes=True) for x in pieces(several | times, starts).to_pylist()]
        release()
        return pa.table({"bucket": pa.array(buckets, pa.int32()), "shard": pa.array(np.full(len(buckets), key[0].as_py()), pa.int32()), "keys": pieces(cell[first].astype(np.uint32), starts), "notes": pa.array(note, pa.binary())})

    def match(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        keys, sizes = joined(t["keys"], "<u4")
        codec = pa.Codec("zstd")
        notes = np.frombuffer(b"".join(codec.decompress(x, 2 * int(k), asbytes=True) for x, k in zip(t["notes"].to_pylist(), sizes)), "<u2")
        uniq, index, count = np.unique(keys, return_inverse=True, return_counts=True)
        several = count > 1
        several[index[notes >> 15 > 0]] = True
        often = np.bincount(index, weights=notes & 0x7FFF, minlength=len(uniq)) > hot
        hit = several[index]
        row = np.repeat(np.arange(len(sizes)), sizes)[hit]
        rows, first = np.unique(row, return_index=True)
        starts = np.append(first, len(row))
        return pa.table({"shard": pa.array(t["shard"].to_numpy()[rows], pa.int32()), "bucket": pa.array(np.full(len(rows), key[0].as_py()), pa.int32()), "keys": pieces(keys[hit], starts), "hot": pieces(often[index][hit].astype(np.uint8), starts)})

    def records(a: Anchors, ids: np.ndarray, replies: pa.Table):
        """Of the anchors that hit: windows from low to high, the document, and the index of each one's span; the distinct spans by bucket: bytes, place of the anchor, smallest id, bucket."""
        keys, sizes = joined(replies["keys"], "<u4")
        known = (np.repeat(replies["bucket"].to_numpy().astype(np.uint64), sizes) << np.uint64(32)) | keys.astype(np.uint64)
        order = np.argsort(known)
        known, often = known[order], joined(replies["hot"], "u1")[0][order] > 0
        where = np.minimum(np.searchsorted(known, a.cell), max(len(known) - 1, 0))
        hit = known[where] == a.cell if len(known) else np.zeros(len(a.cell), bool)
        is_hot = hit & (often[where] if len(known) else hit)
        calm, warm = np.flatnonzero(hit & ~is_hot), np.flatnonzero(is_hot)
        each = (a.high - a.low + 1)[warm]
        one = np.repeat(a.low[warm] - np.append(0, np.cumsum(each))[:-1], each) + np.arange(each.sum())
        low, high = np.concatenate([a.low[calm], one]), np.concatenate([a.high[calm], one])
        doc = np.concatenate([a.doc[calm], np.repeat(a.doc[warm], each)])
        at = np.concatenate([(a.at - a.low)[calm], np.zeros(len(one), np.int64)])
        coded = gathered(a.data, low, high - low + window).dictionary_encode()
        index, spans = coded.indices.to_numpy(), coded.dictionary
        _, sample = np.unique(index, return_index=True)
        place, lone = at[sample], sample >= len(calm)
        bucket = np.searchsorted(cuts.value, leads(a.data, (low + at)[sample], kgram), "right").astype(np.int32)
        if lone.any():
            nth = np.flatnonzero(lone)
            h = rolling(CODES[a.data[(low[sample[nth]][:, None] + np.arange(window)).ravel()]], window, 0xD6E8FEB86659FD93)[::window] if len(nth) else np.zeros(0, np.uint64)
            bucket[nth] = (h % np.uint64(n)).astype(np.int32)
        least = np.full(len(sample), LAST, np.int64)
        np.minimum.at(least, index, ids[doc])
        text = pc.sort_indices(spans).to_numpy().astype(np.int64)
        order = text[np.argsort(bucket[text], kind="stable")]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return low, high, doc, at, back[index], spans.take(pa.array(order)), place[order], least[order], bucket[order]

    def runs(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
        return first, np.append(first[1:], len(bucket))

    def send(key: tuple[pa.Scalar, ...], t: pa.Table, replies: pa.Table) -> pa.Table:
        *_, spans, place, least, bucket = records(*read(t)[1:], replies)
        first, ends = runs(bucket)
        bodies = [packed(span=spans.slice(x, y - x).cast(pa.binary()), at=pa.array(place[x:y], pa.uint8()), doc=pa.array(least[x:y], pa.int64())) for x, y in zip(first, ends)]
        release()
        return pa.table({"bucket": pa.array(bucket[first], pa.int32()), "shard": pa.array(np.full(len(first), int(key[0].as_py())), pa.int32()), "body": pa.array(bodies, pa.binary())})

    def compare(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        bodies = [unpacked(x) for x in t["body"].to_pylist()]
        rows = pa.concat_tables(bodies).combine_chunks()
        mask = lost_windows(rows["span"].combine_chunks(), rows["at"].to_numpy().astype(np.int64), rows["doc"].to_numpy(), window, kgram)
        codec, ends = pa.Codec("zstd"), np.append(0, np.cumsum([len(x) for x in bodies]))
        release()
        return pa.table({"shard": t["shard"].combine_chunks(), "bucket": t["bucket"].combine_chunks(), "lost": pa.array([codec.compress(mask[x:y].tobytes(), asbytes=True) for x, y in zip(ends[:-1], ends[1:])], pa.binary())})

    hits = parts.groupBy("shard").applyInArrow(probe, "bucket int, shard int, keys binary, notes binary").groupBy("bucket").applyInArrow(match, "shard int, bucket int, keys binary, hot binary")
    asked = parts.groupBy("shard").cogroup(hits.groupBy("shard")).applyInArrow(send, "bucket int, shard int, body binary")
    answers = asked.groupBy("bucket").applyInArrow(compare, "shard int, bucket int, lost binary")
    none = lambda *c: [F.lit(None).cast("binary").alias(x) for x in c]
    both = hits.select("shard", "bucket", "keys", "hot", *none("lost")).unionByName(answers.select("shard", "bucket", *none("keys", "hot"), "lost"))

    def cut(key: tuple[pa.Scalar, ...], t: pa.Table, replies: pa.Table) -> pa.Table:
        t, a, ids = read(t)
        answer = replies["lost"].is_valid()
        low, high, doc, at, index, _, _, least, bucket = records(a, ids, replies.filter(replies["keys"].is_valid()))
        codec, (first, ends) = pa.Codec("zstd"), runs(bucket)
        lost = replies.filter(answer).sort_by("bucket")["lost"].to_pylist()
        mask = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(codec.decompress(x, 8 * int(e - f), asbytes=True), np.uint64) for x, f, e in zip(lost, first, ends))])
        edge = np.zeros(len(a.data) + window + 1, np.int32)
        mine = ids[doc] > least[index]  # what another document of the shard has, with a smaller id
        edge += (np.bincount(low[mine], minlength=len(edge)) - np.bincount(high[mine] + window, minlength=len(edge))).astype(np.int32)
        rest = np.flatnonzero(~mine & (mask[index] > 0))  # a mask has bits for windows of the span only
        bits, anchor = mask[index[rest]], low[rest] + at[rest]
        starts = np.concatenate([low[:0], *(anchor[bits >> np.uint64(o) & np.uint64(1) > 0] - o for o in range(window - kgram + 1))])
        edge += (np.bincount(starts, minlength=len(edge)) - np.bincount(starts + window, minlength=len(edge))).astype(np.int32)
        gone = np.cumsum(edge[:len(a.data)]) > 0
        begins = gone & ~np.append(False, gone[:-1])
        inner = a.starts[:-1][a.lengths > 0]
        begins[inner] = gone[inner]  # a run ends with its document
        total = lambda x: np.append(0, np.cumsum(x))[a.starts[1:]] - np.append(0, np.cumsum(x))[a.starts[:-1]]
        removed = total(gone)
        kept = [a.data[x:y][~gone[x:y]] if r else a.data[x:y] for x, y, r in zip(a.starts[:-1], a.starts[1:], removed)]
        out = {
            "doc_id": t["doc_id"].combine_chunks(), "n_bytes": pa.array(a.lengths, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(total(begins), pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
        } | ({"kept": pa.array([x.tobytes() for x in kept], pa.binary())} if whole else {})
        release()
        return pa.table(out)

    return parts.groupBy("shard").cogroup(both.groupBy("shard")).applyInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if whole else ""))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), whole=False)


OP13_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(len(x) // 2 - 49)) AS i FROM d WHERE len(x) >= 100)),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING count(*) > 1),
lost AS (SELECT DISTINCT doc_id, i FROM w JOIN m USING (s) WHERE least < doc_id),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run
    FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM lost)) GROUP BY doc_id, run),
cuts AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM runs GROUP BY doc_id),
kept AS (SELECT d.doc_id, x, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
    CASE WHEN a IS NULL THEN x ELSE list_aggregate([substr(x, 2 * list_extract([0] || b, k) + 1, 2 * (list_extract(a || [len(x) // 2], k) - list_extract([0] || b, k))::BIGINT) FOR k IN range(1, len(a) + 2)], 'string_agg', '') END AS kept
    FROM d LEFT JOIN cuts ON d.doc_id = cuts.doc_id)
SELECT doc_id, len(x) // 2 AS n_bytes, n_removed, n_spans, sha256(from_hex(kept)) AS kept_sha256 FROM kept
"""
