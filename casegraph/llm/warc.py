"""WARC archives with a two-level capture index.

Archives are .warc.gz files of bounded size, each record a gzip member of its own, so that a byte range holds a whole record. The
lower level of the index holds captures sorted by reversed-host key, in compressed blocks; the upper level is a sparse
directory with one entry for each block. A lookup places keys by the directory's range partitions, searches the directory of
each in halves, opens the blocks it names once, searches them in halves, and reads byte ranges of the archives.

Tasks write and read archives through pyarrow's file systems, so path has to be a URI that these know, in a folder that all
executors share. A task that runs again writes new files; the index names those of the attempt that Spark committed.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import shared_folder, table, written

#: Bytes after which an archive is closed, captures in a block of the index, keys that one task searches in a directory.
ARCHIVE_BYTES, BLOCK, KEYS = 64 << 20, 3000, 500_000
#: Archive bytes that one reading task should have, and bytes of neighbouring records that it reads at once.
READ_BYTES, AT_ONCE = 32 << 20, 4 << 20
#: Bytes of payload in a batch that a task gives back to Spark.
BATCH_BYTES = 16 << 20
ENTRY = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
ENTRY_SQL = "key string, page_id long, file string, offset long, length long"
READ = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("url", pa.string()), ("payload", pa.string())])
READ_SQL = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, url string, payload string"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def clean_url(url: Column) -> Column:
    """The URL as a header line and an index key can hold it: null is empty, line breaks are blanks, tabs are escaped."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(url.cast("string"), F.lit("")), r"[\r\n]", " "), "\t", "%09")


def capture_key(url: Column) -> Column:
    """Reversed host, ')', then the rest of the cleaned URL: keys of one domain sort together."""
    url = clean_url(url)
    host = F.lower(F.regexp_extract(url, r"^(?s)(?:.*?://)?([^/?#:]*)", 1))
    rest = F.regexp_extract(url, r"^(?s)(?:.*?://)?[^/?#]*([^#]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(page_id: int | None, url: str, payload: bytes | None, n: int, digest: bytes, first: int | None, date: str) -> bytes:
    """One record as a gzip member; payload is None for a revisit of the page first."""
    uid = lambda x: b"<urn:page:%s>" % (b"" if x is None else b"%d" % x)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n
    again = payload is None
    lines = [
        b"WARC/1.1", b"WARC-Type: " + (b"revisit" if again else b"response"), b"WARC-Record-ID: " + uid(page_id), b"WARC-Date: " + date.encode(), b"WARC-Target-URI: " + url.encode(),
        b"WARC-Payload-Digest: sha1:" + base32(digest).encode(), *([b"WARC-Profile: " + PROFILE, b"WARC-Refers-To: " + uid(first)] if again else []),
        b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % (len(http) + (0 if again else n)), b"", b"",
    ]
    out = zlib.compressobj(1, zlib.DEFLATED, 31)
    return out.compress(b"\r\n".join(lines) + http) + (b"" if again else out.compress(payload)) + out.compress(b"\r\n\r\n") + out.flush()


def parse(member: bytes, payload: bool) -> tuple:
    """The fields of READ from a record's gzip member."""
    raw = zlib.decompress(member, 31)
    cut = raw.index(b"\r\n\r\n")
    head = raw[:cut + 2]
    field = lambda name: (m := re.search(rb"\r\n%s: ([^\r\n]*)\r\n" % name, head)) and m[1] or b""
    page = lambda name: int(x) if (x := field(name)[10:-1]) else None
    block = raw[cut + 4:cut + 4 + int(field(b"Content-Length"))]
    body = block.index(b"\r\n\r\n") + 4
    kind = field(b"WARC-Type").decode()
    if kind == "response":
        data = block[body:]
        n, digest = len(data), base32(hashlib.sha1(data).digest())
    else:
        data, n, digest = None, int(re.search(rb"Content-Length: ([0-9]+)", block[:body])[1]), field(b"WARC-Payload-Digest")[5:].decode()
    return page(b"WARC-Record-ID"), kind, page(b"WARC-Refers-To"), n, digest, field(b"WARC-Target-URI").decode(), data.decode() if payload and data is not None else None


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes a record for each row of pages (page_id, url, html) below path, and the index of the captures.

    page_id is an integer. Of records with equal payloads of least_bytes or more, the one with the smallest page_id is a
    response and the others revisit it; shorter ones are all responses. A null html is an empty payload, a null URL an empty
    one; a row without an id revisits if any row with an id has its payload. Rows that repeat an id are each written; those
    with the response's id and payload are responses too. Further columns are ignored. Empty tables give an empty archive.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html")).withColumns({"digest": F.unhex(F.sha1("html")), "n": F.octet_length("html")})
    # written, so that the join shuffles both sides and a payload that many pages share can be split
    first = written(rows.groupBy("digest", "n").agg(F.min("page_id").alias("first")), "warc-first")
    again = (F.col("n") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.join(first, ["digest", "n"]).select("page_id", clean_url(F.col("url")).alias("url"), capture_key(F.col("url")).alias("key"), "digest", "n", F.when(again, F.col("first")).alias("first"), F.when(~again, F.col("html")).alias("html"))
    folder = f"{path}/archive"

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        try:
            for b in batches:
                found = []
                for k in range(b.num_rows):
                    page_id, url, key, digest, n, first_, html_ = (b.column(c)[k].as_py() for c in ("page_id", "url", "key", "digest", "n", "first", "html"))
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)  # else the name would have it compressed once more
                    member = record(page_id, url, html_, n, digest, first_, date)
                    out.write(member)
                    found.append((key, page_id, name, at, len(member)))
                    at += len(member)
                yield batch_of(found, ENTRY)
        finally:
            if out is not None:
                out.close()

    captures = written(rows.mapInArrow(save, ENTRY_SQL), "warc-captures").repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id", "file", "offset")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, kept, count = TaskContext.get().partitionId(), [], 0

        def block(rows: list[dict]) -> pa.RecordBatch:
            lines = "\n".join("\t".join([r["key"], "" if r["page_id"] is None else str(r["page_id"]), r["file"], str(r["offset"]), str(r["length"])]) for r in rows)
            return pa.RecordBatch.from_pylist([{"part": part, "block": part << 32 | count, "first_key": rows[0]["key"], "last_key": rows[-1]["key"], "n": len(rows), "data": zlib.compress(lines.encode())}], INDEX)

        for b in batches:
            kept += b.to_pylist()
            while len(kept) >= BLOCK:
                yield block(kept[:BLOCK])
                kept, count = kept[BLOCK:], count + 1
        if kept:
            yield block(kept)

    captures.mapInArrow(pack, INDEX_SQL).write.parquet(f"{path}/index")
    _index(spark, path).drop("data").write.parquet(f"{path}/directory")


INDEX = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("first_key", pa.string()), ("last_key", pa.string()), ("n", pa.int64()), ("data", pa.binary())])
INDEX_SQL = "part int, block long, first_key string, last_key string, n long, data binary"


def _index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX_SQL).parquet(f"{path}/index")


def _directory(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX_SQL.removesuffix(", data binary")).parquet(f"{path}/directory")


def lookup(spark: SparkSession, path: str, urls: DataFrame) -> DataFrame:
    """The index entries (key, page_id, file, offset, length) of the URLs in urls (url), each capture once.

    The driver gets one row for each range partition of the index, as many as Spark's shuffle partitions at most. Within
    one, at most KEYS keys meet its slice of the directory in a task. A null URL is looked up as an empty one, repeated
    URLs once; a URL without a capture gives no row.
    """
    keys = urls.select(capture_key(F.col("url")).alias("key")).distinct()
    directory = _directory(spark, path)
    ranges = sorted(map(tuple, directory.groupBy("part").agg(F.min("first_key"), F.max("last_key")).collect()))
    parts, first, last = ([r[k] for r in ranges] for k in range(3))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = [(key, parts[i]) for key in b.column("key").to_pylist() for i in range(bisect_left(last, key), bisect_right(first, key))]
            yield batch_of(hits, pa.schema([("key", pa.string()), ("part", pa.int32())]))

    placed = written(keys.mapInArrow(place, "key string, part int"), "warc-keys")
    shares = placed.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / KEYS).cast("int").alias("shares"))
    shares = written(shares, "warc-shares")
    placed = placed.join(shares, "part").select("key", "part", F.pmod(F.xxhash64("key"), F.col("shares")).cast("int").alias("share"))
    slices = directory.join(shares, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "first_key", "last_key", "block")

    def search_directory(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("block")
        low, high, blocks = (right[c].to_pylist() for c in ("first_key", "last_key", "block"))
        found: dict[int, list[str]] = {}
        for key in left["key"].to_pylist():
            for i in range(bisect_left(high, key), bisect_right(low, key)):
                found.setdefault(blocks[i], []).append(key)
        rows = [(k, v[i:i + BLOCK]) for k, v in found.items() for i in range(0, len(v), BLOCK)]
        return pa.Table.from_batches([batch_of(rows, pa.schema([("block", pa.int64()), ("keys", pa.list_(pa.string()))]))])

    def search_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, wanted in zip(b.column("data").to_pylist(), b.column("keys").to_pylist()):
                lines = [line.split("\t") for line in zlib.decompress(data).decode().split("\n")]
                names = [x[0] for x in lines]
                found = [lines[i] for key in wanted for i in range(bisect_left(names, key), bisect_right(names, key))]
                yield batch_of([(k, int(p) if p else None, f, int(o), int(n)) for k, p, f, o, n in found], ENTRY)

    hits = placed.groupBy("part", "share").cogroup(slices.groupBy("part", "share")).applyInArrow(search_directory, "block long, keys array<string>")
    return _index(spark, path).select("block", "data").join(hits, "block").mapInArrow(search_blocks, ENTRY_SQL)


def read_records(spark: SparkSession, path: str, entries: DataFrame, payload: bool = True) -> DataFrame:
    """(page_id, record_type, refers_to, payload_bytes, payload_digest, url, payload) of the captures in entries, by byte range.

    payload is null for a revisit, and for all if it isn't asked for; a revisit's bytes come from the HTTP head that it keeps,
    its digest from the record's head. A response's bytes and digest are those of the payload that was read.
    """
    entries = written(entries.select("file", "offset", "length"), "warc-entries")
    total = entries.agg(F.sum("length")).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = f"{path}/archive"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        handle, name = None, None
        rows, size = [], 0
        for b in batches:
            wanted = list(zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length"))))
            k = 0
            while k < len(wanted):
                file, start, end = wanted[k][0], wanted[k][1], wanted[k][1]
                run = k
                while run < len(wanted) and wanted[run][:2] == (file, end) and (run == k or end + wanted[run][2] - start <= AT_ONCE):
                    end += wanted[run][2]
                    run += 1
                if file != name:
                    if handle is not None:
                        handle.close()
                    handle, name = store.open_input_file(f"{base}/{file}"), file
                data = handle.read_at(end - start, start)
                for _, offset, length in wanted[k:run]:
                    rows.append(parse(data[offset - start:offset - start + length], payload))
                    size += length + len(rows[-1][-1] or "")
                k = run
                if size >= BATCH_BYTES:
                    yield batch_of(rows, READ)
                    rows, size = [], 0
        yield batch_of(rows, READ)
        if handle is not None:
            handle.close()

    dealt = entries.repartition(max(-(-total // READ_BYTES), least), "file").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(read, READ_SQL)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pages = shared_folder(spark, "warc"), table(spark, sf_dir, "pages")
    write_archives(pages, path)
    return read_records(spark, path, lookup(spark, path, pages), payload=False).drop("url", "payload")


OP3_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, strlen(p.h) AS payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(sha1(p.h), 5 * (k // 4) + 1, 5))::INT >> (15 - 5 * (k % 4))) & 31) + 1)::INT, 1) FOR k IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM p JOIN f USING (h)
"""
