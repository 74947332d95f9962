"""BPE encoding and decoding through a table of distinct words.

Tasks split every text into words and count them, and Spark sums the counts. The most frequent words, a table of bounded
size, are encoded once and sent to all tasks; a text becomes codes into that table, and further codes into a list of its
other words. Those meet by word, sorted, so that each is encoded once, and their ids come back to the text through a join. The
ids are then put together by position. Decoding joins them with the table of ids and pieces, which is as large as the
vocabulary: in Arrow, by position, since ids have no gaps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegralType

from .common import release, table, written

#: Words in the table that all tasks get, each of at most HEAD_BYTES bytes: 16 MB of text at most, for any input.
HEAD, HEAD_BYTES = 262_144, 64
#: Keys over which the texts with one longer word are dealt.
LONG_PARTS = 64
#: Words that a task puts together at once.
PART_WORDS = 1_000_000


#: Texts of these characters are stable under NFC and have the same lower case everywhere.
PLAIN = r"^[\x09-\x0D\x20-\x7E\x{00C0}-\x{012F}\x{0132}-\x{017F}]*$"
#: Fixed values of the vocabulary file: what it splits from runs of letters, and the tokens that it finds in raw text.
MARK = r"('s|'t|'re|'ve|'m|'ll|'d|\p{N}|[^\x09-\x0D\x20\p{L}\p{N}]+)"
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
#: Bytes of text that a task codes at once.
PART_BYTES = 8 << 20


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in one run, and where each text's words start (one more at the end).

    The tokenizer merges no two of them. Plain texts are lower-cased and split as the vocabulary splits them, which keeps
    the table of words small. Any other text is split at white space only: the tokenizer drops white space, composes no
    character with it, and finds its special tokens between it.
    """
    texts = texts.cast(pa.large_string())
    plain = pc.match_substring_regex(texts, PLAIN)
    for token in SPECIAL:
        plain = pc.and_not(plain, pc.match_substring(texts, token))
    if pc.any(plain).as_py():
        texts = pc.if_else(plain, pc.replace_substring_regex(pc.utf8_lower(texts), MARK, r" \1 "), texts)
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    full = pc.not_equal(pc.binary_length(words), 0)  # blanks at the ends of a text give empty words
    starts = np.append(0, np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64))[offsets - offsets[0]]
    return words.filter(full).cast(pa.string()), starts


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut into parts of about PART_BYTES bytes of text."""
    for b in batches:
        part = np.cumsum(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False), dtype=np.int64) // PART_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), b.num_rows]
        yield from (b.slice(x, y - x) for x, y in zip(cuts[:-1], cuts[1:]) if y > x)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in parts(batches):
        found = pc.value_counts(split_words(b.column("text"))[0])
        yield pa.RecordBatch.from_arrays([found.field(0), found.field(1)], ["word", "n"])
    release()


def tokenizer(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """words, sorted by word in each partition, with ids: the tokens of each, as little-endian unsigned 32-bit integers.

    A word is encoded where its run of rows starts.
    """
    names = words.columns

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, last, last_ids = tokenizer(path), None, b""
        for whole in batches:
            for k in range(0, whole.num_rows, 5_000):
                b = whole.slice(k, 5_000)
                coded = b.column("word").dictionary_encode()
                distinct = coded.dictionary.to_pylist()
                new = distinct[1:] if distinct[0] == last else distinct
                ids = [np.asarray(e.ids, "<u4").tobytes() for e in tok.encode_batch_fast(new, add_special_tokens=False)]
                ids = [last_ids, *ids] if len(new) < len(distinct) else ids
                last, last_ids = distinct[-1], ids[-1]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.binary()).take(coded.indices)], [*names, "ids"])

    return words.mapInArrow(encode, words.schema.simpleString()[len("struct<"):-1].replace(":", " ") + ", ids binary")


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """(word, n) of the words above a count that at most `most` words reach: no sort, and a bounded result.

    Counts are rounded down to eighths of a power of two, and the words of whole steps are taken.
    """
    short = counts.where(F.octet_length("word") <= HEAD_BYTES).withColumn("step", F.floor(8 * F.log2("n")).cast("int"))
    least, total = None, 0
    for step, n in sorted(short.groupBy("step").count().collect(), reverse=True):
        total += n
        if total > most:
            break
        least = step
    return short.where(F.lit(False) if least is None else F.col("step") >= least).select("word", "n")


def flat_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a column that encode_words made, in one run, and how many each row has."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").astype(np.int64), pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 4


def pieces_of(path: str) -> list[str]:
    """The piece of each id; ids have no gaps."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    return [tok.id_to_token(k) for k in range(tok.get_vocab_size())]


def bpe_round_trip(docs: DataFrame, path: str, head: int = HEAD, whole: bool = True) -> DataFrame:
    """Encodes and decodes every text as the tokenizers library does with the file at path, without special tokens added.

    docs: (doc_id, text), further columns are ignored. Returns (doc_id, n_tokens, ids_sha256, decoded_sha256, ids, decoded), one
    row for each input row; whole=False leaves out the last two. A null or blank text has no token and decodes to ''. Rows that
    repeat an id, or have none, are encoded each on their own. head bounds the number of words in the table that all tasks
    get; it changes no result. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts = texts.select("text").mapInArrow(count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = written(counts.where("n > 1"), "bpe-words")  # a word that occurs once gains nothing from a place in the table
    top = encode_words(most_frequent(counts, min(head, HEAD)), path).toArrow().sort_by([("n", "descending"), ("word", "ascending")]).combine_chunks()
    known = spark.sparkContext.broadcast((top.column("word").cast(pa.string()).combine_chunks(), *flat_ids(top.column("ids"))))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts as codes: a place in the table, or beyond its end a place in the text's own list of other words."""
        table_, codec = known.value[0], pa.Codec("zstd", 3)
        for b in parts(batches):
            flat, starts = split_words(b.column("text"))
            coded = flat.dictionary_encode()
            place = pc.index_in(coded.dictionary, value_set=table_).fill_null(-1).to_numpy(zero_copy_only=False)
            own = coded.indices.to_numpy(zero_copy_only=False)
            codes = place[own].astype("<i4") if len(own) else np.zeros(0, "<i4")
            packed, others = [], []
            for x, y in zip(starts[:-1], starts[1:]):
                mine, words = codes[x:y], own[x:y]
                rest = mine < 0
                distinct, first, nth = np.unique(words[rest], return_index=True, return_inverse=True)
                order = np.argsort(first)  # by first use, so that the text alone decides
                mine[rest] = len(table_) + np.argsort(order)[nth]
                others.append(distinct[order])
                packed.append(codec.compress(mine.view(np.uint8).reshape(-1, 4).T.tobytes(), asbytes=True) if y > x else b"")
            at = np.append(0, np.cumsum([len(x) for x in others])).astype(np.int32)
            rare = coded.dictionary.take(pa.array(np.concatenate([*others, np.zeros(0, np.int64)]).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("rid"), b.column("key"), pa.array(np.diff(starts), pa.int64()), pa.array(packed, pa.binary()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), rare)], ["doc_id", "rid", "key", "n_words", "codes", "rare"])
        release()

    # read and coded twice, which costs less than to keep the codes on disk; equal rows share an id and a key, and their rare words
    rid = F.coalesce(F.col("doc_id").cast("long"), F.lit(0)) if isinstance(kind, IntegralType) else F.xxhash64("doc_id")
    coded = texts.select("doc_id", "text", rid.alias("rid"), F.xxhash64("text").alias("key")).mapInArrow(code, f"doc_id {kind.simpleString()}, rid long, key long, n_words long, codes binary, rare array<string>")
    # a word that is too long for the table may be in any number of texts: dealt over LONG_PARTS keys, and encoded as often
    salt = F.when(F.octet_length("word") > HEAD_BYTES, F.pmod("key", F.lit(LONG_PARTS))).otherwise(0)
    asked = coded.select("rid", "key", F.posexplode("rare").alias("nth", "word")).repartition("word", salt).sortWithinPartitions("word")
    rare = encode_words(asked, path).groupBy("rid", "key").agg(F.collect_set(F.struct("nth", "ids")).alias("found"))
    full = coded.join(rare, ["rid", "key"], "left").select("doc_id", "n_words", "codes", F.col("found"))
    full = full.select("doc_id", "n_words", "codes", F.array_sort("found")["ids"].alias("rare_ids"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, ids_flat, sizes = known.value
        vocabulary, codec = pa.array(pieces_of(path), pa.string()), pa.Codec("zstd")
        for batch in batches:
            counts = batch.column("n_words").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(counts) // PART_WORDS)) + 1), batch.num_rows]
            for x, y in zip(cuts[:-1], cuts[1:]):
                if x == y:
                    continue
                b, n_words = batch.slice(x, y - x), counts[x:y]
                n_rare = pc.fill_null(pc.list_value_length(b.column("rare_ids")), 0).to_numpy(zero_copy_only=False)
                more, more_sizes = flat_ids(pc.list_flatten(b.column("rare_ids")))  # of each rare word of each text
                size, pool = np.concatenate([sizes, more_sizes]), np.concatenate([ids_flat, more])
                begin, shift = np.cumsum(size) - size, np.cumsum(n_rare) - n_rare
                codes = [np.zeros(0, np.int64)]
                for raw, n, skip in zip(b.column("codes").to_pylist(), n_words, shift):
                    if n:
                        mine = np.frombuffer(codec.decompress(raw, 4 * int(n), asbytes=True), np.uint8).reshape(4, -1).T.copy().view("<i4").ravel().astype(np.int64)
                        codes.append(np.where(mine < len(sizes), mine, mine + skip))
                flat = np.concatenate(codes)
                length = size[flat]
                ends = np.append(0, np.cumsum(length))
                ids = pool[np.repeat(begin[flat] - ends[:-1], length) + np.arange(ends[-1])]
                yield finish(b.column("doc_id"), ids, ends[np.append(0, np.cumsum(n_words))], vocabulary)
            release()

    def finish(doc_id, ids, ids_at, vocabulary) -> pa.RecordBatch:
        at = pa.array(ids_at, pa.int32())
        decoded = pc.binary_join(pa.ListArray.from_arrays(at, vocabulary.take(pa.array(ids))), " ")
        raw = ids.astype("<u4").tobytes()
        sha = lambda parts: pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string())
        out = [doc_id, pa.array(np.diff(ids_at), pa.int64()), sha(raw[4 * x:4 * y] for x, y in zip(ids_at[:-1], ids_at[1:])), sha(decoded.cast(pa.binary()).to_pylist())]
        out += [pa.ListArray.from_arrays(at, pa.array(ids, pa.int32())), decoded] if whole else []
        return pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][:len(out)])

    return full.mapInArrow(assemble, f"doc_id {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if whole else ""))


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text, see bpe_round_trip()."""
    return bpe_round_trip(docs, path, whole=False)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
