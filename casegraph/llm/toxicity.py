"""Toxicity grades by cumulative-link ordinal regression over sparse text features.

Severity has three grades, all from the labels: 0 for a document labelled clean, 1 for one labelled toxic, 2 for one labelled
toxic and of low quality. One weight vector w serves both thresholds: P(grade >= k) = sigmoid(w.x - theta_k), theta_1 <=
theta_2. A document's severity is the expected grade.

A document's features are its distinct words and their beginnings of a few lengths, so that inflected and compound forms count
together; a feature's value grows with the logarithm of how many distinct words share it, over the root of the number of
distinct words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import release, table

#: Labelled rows, and bytes of their texts, that the model is fitted on at most: the first by a hash of the id. A documented bound.
FIT_ROWS, FIT_BYTES = 10_000, 64 << 20
#: Lengths of the beginnings of words that are features.
PREFIXES = (4, 5, 6, 7, 8)
#: A feature takes part if it is in so many toxic documents, and so many deviations more often there than chance would have it.
LEAST, SIGNIFICANT = 5, 4.0
#: What an error on a toxic row weighs against one on a clean row, and the penalty on squared weights.
TOXIC_WEIGHT, L2 = 3.0, 1e-3
#: Documents that a task scores at once.
AT_ONCE = 2_000
#: Documents with at least this chance of grade 1 are rejected.
REJECT = 0.3

Model = tuple[dict[str, float], np.ndarray]


def words_of(text: Column) -> Column:
    """The distinct words of a text, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(r"[\p{L}\p{M}]+"), F.lit(0)))


def flat_words(lists: pa.Array | pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of all rows; for each word of each row, its place among them and its row."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    coded = lists.flatten().dictionary_encode()
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(n)), n)


def features_of(words: pa.Array) -> list[pa.Array]:
    """Feature names of each word: itself, marked, and its proper beginnings; null where a word is too short for one."""
    size = pc.utf8_length(words)
    cut = lambda k: pc.if_else(pc.greater(size, k), pc.utf8_slice_codeunits(words, 0, k), pa.scalar(None, pa.string()))
    return [pc.binary_join_element_wise("=", words, ""), *(cut(k) for k in PREFIXES)]


def counted(place: np.ndarray, row: np.ndarray, ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, distinct words of the row with it). ids: (kind, word) to a feature below width, or -1."""
    keys = np.concatenate([(row * width + own[place])[own[place] >= 0] for own in ids])
    keys, n = np.unique(keys, return_counts=True)
    return keys // width, keys % width, n


def values(rows: np.ndarray, n: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    return np.log1p(n) * np.sqrt(100 / np.maximum(n_words[rows], 20))


def fit(lists: pa.Array | pa.ChunkedArray, grade: np.ndarray, rounds: int = 400, rate: float = 0.05) -> Model:
    """(weights by feature, thresholds). lists: the distinct words of each document; grade: 0, 1 or 2."""
    words, place, row = flat_words(lists)
    n_rows, toxic = len(grade), np.asarray(grade) > 0
    none = ({}, np.array([8.0, 9.0]))
    if not toxic.any() or toxic.all() or not len(words):
        return none
    names = pa.chunked_array(features_of(words)).dictionary_encode().combine_chunks()
    ids = np.where(names.indices.is_valid().to_numpy(zero_copy_only=False), names.indices.fill_null(0).to_numpy(zero_copy_only=False), -1).reshape(1 + len(PREFIXES), -1).astype(np.int64)
    width, n_words = len(names.dictionary), np.bincount(row, minlength=n_rows)
    pos, neg, step = np.zeros(width), np.zeros(width), 500
    edges = np.searchsorted(row, np.arange(0, n_rows + step, step))
    for x, y in zip(edges[:-1], edges[1:]):
        if y > x:
            r, f, _ = counted(place[x:y], row[x:y], ids, width)
            np.add.at(pos, f[toxic[r]], 1)
            np.add.at(neg, f[~toxic[r]], 1)
    n_pos, n_neg = toxic.sum(), (~toxic).sum()
    share = (pos + neg) / n_rows
    z = (pos / n_pos - neg / n_neg) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n_pos + 1 / n_neg))
    used = np.flatnonzero((z >= SIGNIFICANT) & (pos >= LEAST))
    if not len(used):
        return none
    new = np.full(width + 1, -1)
    new[used] = np.arange(len(used))
    r, f, n = counted(place, row, new[ids], len(used))
    v = values(r, n, n_words)
    weight = np.where(toxic, TOXIC_WEIGHT, 1.0)
    weight /= weight.sum()
    par = np.concatenate([np.zeros(len(used)), [2.0, 4.0]])
    mean, square = np.zeros_like(par), np.zeros_like(par)
    for k in range(1, rounds + 1):
        at = np.bincount(r, weights=par[f] * v, minlength=n_rows)
        err = [(1 / (1 + np.exp(-np.clip(at - t, -30, 30))) - (grade > i)) * weight for i, t in enumerate(par[-2:])]
        slope = np.concatenate([np.bincount(f, weights=(err[0] + err[1])[r] * v, minlength=len(used)) + L2 * par[:-2], [-err[0].sum(), -err[1].sum()]])
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        par = par - rate * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.999**k)) + 1e-9)
        par[-1] = max(par[-1], par[-2] + 1e-3)
    return dict(zip(names.dictionary.take(pa.array(used)).to_pylist(), par[:-2].tolist())), par[-2:]


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on labelled documents, FIT_ROWS of them and FIT_BYTES of whole texts at most.

    labels: (doc_id, toxic, quality). A row without an id or a toxic label is left out, repeated labels count as the gravest.
    """
    severe = F.coalesce(F.col("quality") == 0, F.lit(False)).cast("int")
    grade = F.when(F.col("toxic") > 0, 1 + severe).otherwise(0)
    chosen = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(grade).alias("grade"))
    chosen = F.broadcast(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id")
    size = rows.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("size")).groupBy("doc_id").agg(F.sum("size").alias("size"))
    before = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # at most FIT_ROWS rows of two numbers
    fits = F.broadcast(size.withColumn("before", before).where(F.col("before") <= FIT_BYTES).select("doc_id"))
    got = rows.join(fits, "doc_id").select(words_of(F.col("text")).alias("words"), "grade").toArrow()
    return fit(got["words"], got["grade"].to_numpy().astype(int))


def score(words: Column, weights: dict[str, float], spark: SparkSession) -> Column:
    """w.x of a document's distinct words, in Arrow batches."""
    names = pa.array(sorted(weights), pa.string())
    shared = spark.sparkContext.broadcast((names, np.array([weights[k] for k in names.to_pylist()], float)))

    def part(lists: pa.Array) -> np.ndarray:
        known, w = shared.value
        distinct, place, row = flat_words(lists)
        if not len(known) or not len(distinct):
            return np.zeros(len(lists))
        ids = np.stack([pc.index_in(f, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False) for f in features_of(distinct)]).astype(np.int64)
        n_words = np.bincount(row, minlength=len(lists))
        hit = (ids >= 0).any(0)[place]
        r, f, n = counted(place[hit], row[hit], ids, len(known))
        return np.bincount(r, weights=w[f] * values(r, n, n_words), minlength=len(lists))

    @F.arrow_udf("double")
    def linear(lists: pa.Array) -> pa.Array:
        out = np.concatenate([np.zeros(0), *(part(lists[k:k + AT_ONCE]) for k in range(0, len(lists), AT_ONCE))])
        release()
        return pa.array(out)

    return linear(words)


def _chance(z: Column, theta: float) -> Column:
    return 1 / (1 + F.exp(F.greatest(F.least(F.lit(float(theta)) - z, F.lit(30.0)), F.lit(-30.0))))


def toxicity(docs: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """Grades every document.

    docs: (doc_id, text), further columns are ignored. Returns (doc_id, severity, p_toxic, p_severe, grade, rejected), one row
    for each input row: the expected grade from 0 to 2, the chances of grade >= 1 and >= 2, the likeliest grade, and whether
    p_toxic >= reject. Null, empty and wordless texts have no feature and get what the thresholds alone give. Repeated rows are
    graded alike. An empty table gives an empty result.
    """
    weights, theta = model
    z = score(words_of(F.col("text")), weights, docs.sparkSession)
    rows = docs.select("doc_id", z.alias("z")).select("doc_id", _chance(F.col("z"), theta[0]).alias("p_toxic"), _chance(F.col("z"), theta[1]).alias("p_severe"))
    p1, p2 = F.col("p_toxic"), F.col("p_severe")
    grade = F.when((1 - p1 >= p1 - p2) & (1 - p1 >= p2), 0).when(p1 - p2 >= p2, 1).otherwise(2)
    return rows.select("doc_id", (p1 + p2).alias("severity"), "p_toxic", "p_severe", grade.alias("grade"), (p1 >= reject).alias("rejected"))


def filter_toxic(docs: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """The rows of docs, all columns, that the model does not reject: one narrow pass, without a join."""
    weights, theta = model
    z = score(words_of(F.col("text")), weights, docs.sparkSession)
    return docs.select("*", z.alias("toxicity_z_")).where(_chance(F.col("toxicity_z_"), theta[0]) < reject).drop("toxicity_z_")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
