"""Source divergence audit by chunk factorization: in which sources of a language terms are unusually frequent, and how far
sources are from each other.

Tasks count the whitespace chunks of every document and pack a part's pairs of document and chunk. The distinct chunks of all
parts meet by their hash, where each globally distinct chunk is tokenized once; its terms go back to the parts that asked, and
are joined with the pairs there. A part holds whole documents, so it sums distinct documents and occurrences by language, source
and term, and Spark adds the parts up. A frequent term is a row for each part and source, however many documents hold it.
A frequent source is spread over all parts.

Shares are integers in billionths, divergences integers too; nothing is rounded but where the definition says so. The divergences
of two sources are summed over blocks of terms, each a matrix of sources and terms. That work grows with the square of the sources
of a language, as the result does, and not with the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import grouped, packed, release, shard_count, table, unpacked, written
from .decontaminate import small

#: Documents of a language that a kept term is in at least, and terms that are listed for each group.
LEAST_DOCS, TOP = 3, 200
#: Bytes of text in a part; rows (source, term) in a block of terms; cells of a matrix that is computed at once.
PART_BYTES, BLOCK_ROWS, CELLS = 16 << 20, 100_000, 1 << 20
#: What is no part of a term: all of ASCII but letters.
GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
BILLION = 1_000_000_000


def tokens(chunks: pa.Array) -> pa.Array:
    """The terms of each chunk, in order."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.replace_substring_regex(chunks, GAP, " ")))
    full = pc.not_equal(pc.binary_length(lists.values), 0).to_numpy(zero_copy_only=False)  # blanks at the ends of a chunk give empty words
    ends = np.append(0, np.cumsum(full))[lists.offsets.to_numpy()]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lists.values.filter(pa.array(full)))


def by_bucket(words: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of words by bucket and text, and the bucket of each word in that order."""
    bucket = (pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False) % np.uint64(n)).astype(np.int32) if len(words) else np.zeros(0, np.int32)
    text = pc.sort_indices(words).to_numpy()
    order = text[np.argsort(bucket[text], kind="stable")]
    return order, bucket[order]


def slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The batches cut where another size bytes of text are full."""
    for b in batches:
        part = np.cumsum(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False), dtype=np.int64) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), b.num_rows]
        yield from (b.slice(x, y - x) for x, y in zip(cuts[:-1], cuts[1:]) if y > x)


def term_counts(docs: DataFrame, least_docs: int = LEAST_DOCS, part_bytes: int = PART_BYTES) -> DataFrame:
    """(lang, source, term, n_docs, n, lang_docs, lang_n, first) of the terms that at least least_docs documents of their language hold.

    docs: (lang, source, text), without nulls. One row for each source that has the term: documents and occurrences there, and in all
    of the language; first marks one row for each term of a language.
    """
    n = shard_count(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, b in enumerate(slices(batches, part_bytes)):
            lists = pc.ascii_split_whitespace(b.column("text").cast(pa.large_string()))
            full = pc.not_equal(pc.binary_length(lists.values), 0)
            ends = np.append(0, np.cumsum(full.to_numpy(zero_copy_only=False)))[lists.offsets.to_numpy()]
            coded = lists.values.filter(full).cast(pa.string()).dictionary_encode()
            order, bucket = by_bucket(coded.dictionary, n)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            doc = np.repeat(np.arange(b.num_rows, dtype=np.int64), np.diff(ends))
            pairs, times = np.unique(doc * len(order) + place[coded.indices.to_numpy()], return_counts=True)
            chunks = coded.dictionary.take(pa.array(order))
            first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
            bodies = [packed(chunk=chunks.slice(x, y - x)) for x, y in zip(first, np.append(first[1:], len(bucket)))]
            mine = packed(step=pa.array(np.diff(pairs, prepend=0), pa.int64()), n=pa.array(times, pa.int64()))
            groups = packed(lang=b.column("lang"), source=b.column("source"))
            part = (TaskContext.get().partitionId() << 32) + k
            yield pa.RecordBatch.from_arrays([
                pa.array([part] * (len(bodies) + 1), pa.int64()), pa.array([*bucket[first], -1], pa.int32()), pa.array([*bodies, mine], pa.binary()), pa.array([None] * len(bodies) + [groups], pa.binary()),
            ], ["part", "bucket", "body", "groups"])
        release()

    def tokenize(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        chunks = [unpacked(x)["chunk"].combine_chunks() for x in t["body"].to_pylist()]
        coded = pa.chunked_array(chunks, pa.string()).dictionary_encode().combine_chunks()
        terms = tokens(coded.dictionary).take(coded.indices)
        ends = np.append(0, np.cumsum([len(x) for x in chunks]))
        return pa.table({"part": t["part"].combine_chunks(), "bucket": t["bucket"].combine_chunks(), "body": pa.array([packed(terms=terms.slice(x, y - x)) for x, y in zip(ends[:-1], ends[1:])], pa.binary())})

    def gather(key: tuple[pa.Scalar, ...], mine: pa.Table, replies: pa.Table) -> pa.Table:
        pairs, groups = unpacked(mine["body"][0].as_py()), unpacked(mine["groups"][0].as_py())
        none = pa.array([], pa.list_(pa.string()))
        lists = pa.concat_arrays([none, *(unpacked(x)["terms"].combine_chunks() for x in replies.sort_by("bucket")["body"].to_pylist())])
        coded = lists.flatten().dictionary_encode()
        word, width = coded.indices.to_numpy(), max(len(coded.dictionary), 1)
        size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        doc, chunk = np.divmod(np.cumsum(pairs["step"].to_numpy()), max(len(lists), 1))
        each = size[chunk]
        ends = np.append(0, np.cumsum(each))
        term = word[np.repeat(np.append(0, np.cumsum(size))[chunk] - ends[:-1], each) + np.arange(ends[-1])].astype(np.int64)
        held, _, times = grouped(np.repeat(doc, each) * width + term, np.repeat(pairs["n"].to_numpy(), each))
        lang, source = (groups[c].combine_chunks().dictionary_encode() for c in ("lang", "source"))
        many = max(len(source.dictionary), 1)
        group = lang.indices.to_numpy().astype(np.int64) * many + source.indices.to_numpy()
        keys, in_docs, times = grouped(group[held // width] * width + held % width, times)
        order, bucket = by_bucket(coded.dictionary, n)
        nth = np.empty(width, np.int64)
        nth[order] = np.arange(len(order))
        by_term = np.argsort(nth[keys % width], kind="stable")
        keys, in_docs, times = keys[by_term], in_docs[by_term], times[by_term]
        own = bucket[nth[keys % width]] if len(keys) else np.zeros(0, np.int32)
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
        bodies, names = [], []
        for x, y in zip(first, np.append(first[1:], len(own))):
            used, nth_group = np.unique(keys[x:y] // width, return_inverse=True)
            bodies.append(packed(group=pa.array(nth_group, pa.int32()), term=coded.dictionary.take(pa.array(keys[x:y] % width)), docs=pa.array(in_docs[x:y], pa.int64()), n=pa.array(times[x:y], pa.int64())))
            names.append(packed(lang=lang.dictionary.take(pa.array(used // many)), source=source.dictionary.take(pa.array(used % many))))
        release()
        return pa.table({"bucket": pa.array(own[first], pa.int32()), "body": pa.array(bodies, pa.binary()), "groups": pa.array(names, pa.binary())})

    def total(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        bodies, names = [unpacked(x) for x in t["body"].to_pylist()], [unpacked(x) for x in t["groups"].to_pylist()]
        rows, groups = pa.concat_tables(bodies).combine_chunks(), pa.concat_tables(names)
        shift = np.repeat(np.append(0, np.cumsum([len(x) for x in names]))[:-1], [len(x) for x in bodies])
        lang, source = (groups[c].dictionary_encode().combine_chunks() for c in ("lang", "source"))
        term = rows["term"].dictionary_encode().combine_chunks()
        at, langs, sources = rows["group"].to_numpy() + shift, len(lang.dictionary), len(source.dictionary)
        of_term = term.indices.to_numpy().astype(np.int64) * langs + lang.indices.to_numpy()[at]
        keys, _, docs_, times = grouped(of_term * sources + source.indices.to_numpy()[at], rows["docs"].to_numpy(), rows["n"].to_numpy())
        both, n_rows, lang_docs, lang_n = grouped(keys // sources, docs_, times)
        keep, first = np.repeat(lang_docs >= least_docs, n_rows), np.zeros(len(keys), bool)
        first[np.cumsum(n_rows) - n_rows] = True
        take = lambda d, i: d.take(pa.array(i[keep]))
        return pa.table({
            "lang": take(lang.dictionary, keys // sources % langs), "source": take(source.dictionary, keys % sources), "term": take(term.dictionary, keys // sources // langs), "n_docs": pa.array(docs_[keep], pa.int64()), "n": pa.array(times[keep], pa.int64()),
            "lang_docs": pa.array(np.repeat(lang_docs, n_rows)[keep], pa.int64()), "lang_n": pa.array(np.repeat(lang_n, n_rows)[keep], pa.int64()), "first": pa.array(first[keep]),
        })

    counts = written(docs.select("lang", "source", "text").mapInArrow(count, "part long, bucket int, body binary, groups binary"), "audit-counts")
    told = counts.where("bucket >= 0").groupBy("bucket").applyInArrow(tokenize, "part long, bucket int, body binary")
    parts = counts.where("bucket < 0").groupBy("part").cogroup(told.groupBy("part")).applyInArrow(gather, "bucket int, body binary, groups binary")
    return parts.groupBy("bucket").applyInArrow(total, "lang string, source string, term string, n_docs long, n long, lang_docs long, lang_n long, first boolean")


def billionths(n: Column, whole: Column) -> Column:
    """floor(10**9 * n / whole) by long division, exact while 1000 * whole fits a long; n <= whole."""
    rest, out = n, F.lit(0)
    for _ in range(3):
        out = out * 1000 + F.call_function("div", rest * 1000, whole)
        rest = (rest * 1000) % whole
    return out


def pair_sums(key: tuple[pa.Scalar, ...], rows: pa.Table, about: pa.Table) -> pa.Table:
    """Of a block of terms: for each two sources, the sum of floor((p - q)**2 / q)."""
    names, totals, n_terms = about["sources"][0].values.field("source"), about["sources"][0].values.field("total").to_numpy(), about["n_terms"][0].as_py()
    out = np.zeros((len(names), len(names)), np.int64)
    term = rows["term"].combine_chunks().dictionary_encode()
    source, n, whole = pc.index_in(rows["source"].combine_chunks(), value_set=names).to_numpy(), rows["n"].to_numpy(), (totals + n_terms)[:, None]
    at = term.indices.to_numpy()
    order = np.argsort(at, kind="stable")
    width = max(CELLS // max(len(names), 1), 1)
    for x in range(0, len(term.dictionary), width):
        part = order[np.searchsorted(at[order], x):np.searchsorted(at[order], x + width)]
        rest = np.ones((len(names), min(width, len(term.dictionary) - x)), np.int64)
        rest[source[part], at[part] - x] += n[part]
        p = np.ones_like(rest)
        for unit in (1_000_000, 1000, 1):
            more, rest = np.divmod(rest * 1000, whole)
            p += more * unit
        for a in range(len(names)):
            out[a] += ((p[a] - p) ** 2 // p).sum(1)
    a, b = np.nonzero(~np.eye(len(names), dtype=bool))
    lang = pa.array([key[0].as_py()] * len(a), pa.string())
    return pa.table({"lang": lang, "source": names.take(pa.array(a)), "item": names.take(pa.array(b)), "value": pa.array(out[a, b], pa.int64())})


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """How the sources of each language differ from each other, and in which terms from the language.

    docs: (lang, source, text), further columns are ignored, nulls read as ''. Returns (lang, source, part, item, value, rank). Part
    'pair' has each other source of the language, part 'term' the top terms that the group uses more than the language. A
    document is a row: rows that repeat an id count each. A group without terms has all shares of a term that never occurs; a language without
    kept terms gives pairs of value 0. Equal values rank by item, in the order of UTF-8 bytes. A language of one source has no pairs; an
    empty table gives an empty result.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    terms = written(term_counts(docs, least_docs), "audit-terms")
    of_lang = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("first").cast("long")).alias("n_terms"), F.sum("n").alias("lang_total"))
    of_group = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    blocks = F.ceil(F.coalesce("n_rows", F.lit(0)) / BLOCK_ROWS).cast("int")
    groups = written(groups.select("lang", "source", blocks.alias("blocks"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_terms", "total", "lang_total")]), "audit-groups")
    rows = terms.join(small(groups.withColumn("names", F.array("lang", "source")), "names"), ["lang", "source"])

    p = 1 + billionths(F.col("n") + 1, F.col("total") + F.col("n_terms"))
    q = 1 + billionths(F.col("lang_n") + 1, F.col("lang_total") + F.col("n_terms"))
    seen = rows.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q").selectExpr("lang", "source", "'term' AS part", "item", "(p - q) * (p - q) div q AS value")

    about = groups.groupBy("lang", "blocks", "n_terms").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("sources")).where("blocks > 0")
    about = about.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "n_terms", "sources")
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    cells = rows.select("lang", block.alias("block"), "source", "term", "n").groupBy("lang", "block").cogroup(about.groupBy("lang", "block"))
    sums = cells.applyInArrow(pair_sums, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item").join(sums, ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    ranked = lambda x: x.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked(seen).where(F.col("rank") <= top).unionByName(ranked(pairs))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS (SELECT lang, source, term, r, count(*) AS n FROM (SELECT lang, source, r, unnest(ts) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM t GROUP BY lang, term HAVING count(*) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, source, term, sum(t.n)::HUGEINT AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
gn AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (gn.total + v.v) AS p, 1 + (1000000000 * (k.n + 1)) // (v.total + v.v) AS q
      FROM gn JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows_ AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
    UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM rows_)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
