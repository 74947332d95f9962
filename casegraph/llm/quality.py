"""Quality scores by Bradley-Terry pairwise ranking over learned sparse text features.

A document's features are the shapes of its words: letters, digits and marks by kind, runs of one kind cut to two ('AA!!', 'Aa.', '|', '99'),
and whether a word repeats the one before it. Which shapes count is learned: those whose share of the words differs most between better and worse labelled rows.
In each pair of a better and a worse document the chance that the better one wins is sigmoid(w.(x_a - x_b)), and w is fitted by
logistic loss on the differences, over all pairs of all labelled rows. A document's worth is w.x. The threshold is the quantile of the worths of the fitted rows that the share
of bad rows names, and the score maps worth so that the threshold is at 0.7.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import release, table, written

#: Sums of features are of whole steps of 1 / ONE, of worths of 1 / COARSE, so that they do not depend on how rows are dealt.
ONE, COARSE = 1 << 30, 1 << 20
#: How far points are apart at which worths are counted, and how many ranges a round of nth() tells apart.
STEP, RANGES = 1 / 32, 1_024
#: Shapes that take part at most, in how many fitted rows one has to be, and documents that a task looks at together.
SHAPES, LEAST, AT_ONCE = 400, 5, 1_000
GOOD = 0.7
#: What is replaced by what, in turn, to make a word's shape.
KINDS = ((r"\p{Lu}", "A"), (r"[\p{L}\p{M}]", "a"), (r"\p{N}", "9"), (r"A{2,}", "AA"), (r"a{2,}", "aa"), (r"9{2,}", "99"))
REPEAT = " repeat"  # no word's shape has a blank


def shapes_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shapes; for each word of each text its shape's place, and its text; for each text, how many words there are. A word that repeats the one before it is there twice, once as a repeat."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    full = pc.not_equal(pc.binary_length(lists.values), 0)
    ends = np.append(0, np.cumsum(full.to_numpy(zero_copy_only=False)))[lists.offsets.to_numpy()]
    words = lists.values.filter(full).dictionary_encode()
    row, place = np.repeat(np.arange(len(texts)), np.diff(ends)), words.indices.to_numpy()
    shapes = words.dictionary
    for pattern, by in KINDS:
        shapes = pc.replace_substring_regex(shapes, pattern, by)
    shapes = pc.utf8_slice_codeunits(shapes, 0, 12).dictionary_encode()
    again = np.flatnonzero((place[1:] == place[:-1]) & (row[1:] == row[:-1])) + 1
    names = pa.concat_arrays([shapes.dictionary.cast(pa.string()), pa.array([REPEAT])])
    return names, np.concatenate([shapes.indices.to_numpy()[place].astype(np.int64), np.full(len(again), len(names) - 1)]), np.concatenate([row, row[again]]), np.diff(ends)


def values(names: pa.Array, place: np.ndarray, row: np.ndarray, n_words: np.ndarray, known: pa.Array) -> np.ndarray:
    """The texts' features: the root of the share of words with each known shape, and last the root of one over the number of words."""
    at = pc.index_in(names, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[place]
    x = np.bincount((row * len(known) + at)[at >= 0], minlength=len(n_words) * len(known)).reshape(len(n_words), len(known))
    n = np.maximum(n_words, 1)
    return np.hstack([np.sqrt(x / n[:, None]), 1 / np.sqrt(n)[:, None]])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def tallies(docs: DataFrame) -> DataFrame:
    """(doc_id, shape, n, n_words): each document's shapes and how often it has them, counted where its text is, so that no text is shuffled."""

    def count(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, AT_ONCE):
                b = whole.slice(k, AT_ONCE)
                names, place, row, n_words = shapes_of(b.column("text"))
                keys, times = np.unique(row * len(names) + place, return_counts=True)
                ends = np.searchsorted(keys, np.arange(b.num_rows + 1) * len(names))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), _lists(ends, names.take(pa.array(keys % len(names)))), _lists(ends, pa.array(times, pa.int32())), pa.array(n_words, pa.int64())], ["doc_id", "shape", "n", "n_words"])
        release()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(count, f"doc_id {kind}, shape array<string>, n array<int>, n_words bigint")


def _lists(ends: np.ndarray, of: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), of)


def _fixed(c: Column, one: int = ONE) -> Column:
    """A number in steps of 1 / one: sums of such do not depend on the order of rows."""
    return F.rint(c * one).cast("long")


def telling(rows: DataFrame) -> dict | None:
    """What tells good from bad among all rows (shape, n, n_words, good): known shapes, centre and scale of the features, and how many rows are good and bad. None without both."""
    words = F.greatest("n_words", F.lit(1))
    t = rows.agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"), F.sum(_fixed(1 / F.sqrt(words))).alias("s"), F.sum(_fixed(1 / words)).alias("q")).first()
    if not t["good"] or not t["bad"]:
        return None
    each = rows.select("good", words.alias("words"), F.explode(F.arrays_zip("shape", "n")).alias("e")).select("good", "e.shape", (F.col("e.n") / F.col("words")).alias("q"))
    of = lambda good, c: F.sum(F.when(F.col("good") == good, _fixed(c)).otherwise(0)) / ONE
    sums = each.groupBy("shape").agg(F.count(F.lit(1)).alias("rows"), *[of(g, c).alias(f"{n}{g:d}") for g in (True, False) for n, c in (("s", F.sqrt("q")), ("q", F.col("q")))])
    mean = lambda g: F.col(f"s{g:d}") / t["good" if g else "bad"]
    spread = sum((F.col(f"q{g:d}") / t["good" if g else "bad"] - mean(g) ** 2 for g in (True, False)), F.lit(1e-4))
    z = F.when(F.col("rows") >= LEAST, F.abs(mean(True) - mean(False)) / F.sqrt(spread)).otherwise(0)
    best = sums.withColumn("z", z).where((F.col("z") > 0) | (F.col("shape") == REPEAT)).orderBy(F.col("shape") != REPEAT, F.desc("z"), "shape").limit(SHAPES + 1).collect()
    best = sorted(best, key=lambda r: (-r["z"], r["shape"]))
    best = {r["shape"]: (r["s1"] + r["s0"], r["q1"] + r["q0"]) for k, r in enumerate(best) if k < SHAPES or r["shape"] == REPEAT}
    known = sorted({REPEAT, *best})
    n = t["good"] + t["bad"]
    s, q = np.array([best.get(k, (0.0, 0.0)) for k in known] + [(t["s"] / ONE, t["q"] / ONE)]).T / n
    return {"known": pa.array(known), "centre": s, "scale": np.sqrt(np.maximum(q - s**2, 0)) + 1e-6, "good": t["good"], "bad": t["bad"]}


def placed(rows: DataFrame, known: pa.Array) -> DataFrame:
    """(place, n, n_words, good): rows with the places of known shapes, in order, instead of all shapes."""

    def place(batches):
        for b in batches:
            lists = b.column("shape")
            at = pc.index_in(lists.flatten(), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            order = np.lexsort((at, row))
            order = order[at[order] >= 0]
            ends = np.searchsorted(row[order], np.arange(b.num_rows + 1))
            n = b.column("n").flatten().take(pa.array(order))
            yield pa.RecordBatch.from_arrays([_lists(ends, pa.array(at[order], pa.int16())), _lists(ends, n), b.column("n_words"), b.column("good")], ["place", "n", "n_words", "good"])

    return rows.mapInArrow(place, "place array<smallint>, n array<int>, n_words bigint, good boolean")


class Rows:
    """Rows (place, n, n_words, good) as features less those of no text; what a model needs of them comes as sums of each task."""

    def __init__(self, rows: DataFrame, centre: np.ndarray, scale: np.ndarray):
        self.rows, self.centre, self.scale = rows, centre, scale
        self.zero = np.clip(-centre / scale, -4, 4)

    def _each(self, w: np.ndarray):
        """Of a batch: for each feature there is its row, place and value; each row's worth; which rows are good."""
        centre, scale, zero = self.centre, self.scale, self.zero

        def each(b):
            words = np.maximum(b.column("n_words").to_numpy(zero_copy_only=False), 1)
            row = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column("place")).to_numpy(zero_copy_only=False))
            v = np.append(np.sqrt(b.column("n").flatten().to_numpy() / words[row]), 1 / np.sqrt(words))
            place = np.append(b.column("place").flatten().to_numpy().astype(np.int64), np.full(b.num_rows, len(zero) - 1))
            row = np.append(row, np.arange(b.num_rows))
            x = np.clip((v - centre[place]) / scale[place], -4, 4) - zero[place]
            return row, place, x, zero @ w + np.bincount(row, x * w[place], b.num_rows), b.column("good").to_numpy(zero_copy_only=False)

        return each

    def worths(self, w: np.ndarray) -> DataFrame:
        each = self._each(w)
        return self.rows.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array(each(b)[3])], ["worth"]) for b in batches), "worth double")

    def histogram(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Points STEP apart, and how many good and bad rows each has; a row between two points is shared by nearness."""
        each = self._each(w)

        def count(batches):
            out = {}
            for b in batches:
                *_, worth, good = each(b)
                at = np.floor(worth / STEP).astype(np.int64)
                part = np.rint((worth / STEP - at) * ONE)
                keys, place = np.unique(np.concatenate([2 * at + good, 2 * at + 2 + good]), return_inverse=True)
                for k, n in zip(keys.tolist(), np.bincount(place, np.concatenate([ONE - part, part])).astype(np.int64).tolist()):
                    out[k] = out.get(k, 0) + n
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.int64())], ["k", "n"])

        got = self.rows.mapInArrow(count, "k bigint, n bigint").toArrow()
        k, n = got["k"].to_numpy(), got["n"].to_numpy()
        first = int(k.min() >> 1)
        sums = np.zeros((int(k.max() >> 1) - first + 1, 2), np.int64)
        np.add.at(sums, ((k >> 1) - first, k & 1), n)
        return (first + np.arange(len(sums))) * STEP, sums[:, 1] / ONE, sums[:, 0] / ONE

    def pull(self, w: np.ndarray, points: np.ndarray, of_good: np.ndarray, of_bad: np.ndarray) -> np.ndarray:
        """Sums of the rows' features, each row as often as what is given for its worth: of good rows, of bad rows."""
        each, size = self._each(w), len(w)

        def add(batches):
            out = np.zeros((2, size + 1), np.int64)
            for b in batches:
                row, place, x, worth, good = each(b)
                c = np.where(good, np.interp(worth, points, of_good), np.interp(worth, points, of_bad))
                out[:, :size] += np.bincount(good[row] * size + place, np.rint(c[row] * x * ONE), 2 * size).astype(np.int64).reshape(2, size)
                out[:, size] += np.bincount(good.astype(np.int64), np.rint(c * ONE), 2).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(out.tolist(), pa.list_(pa.int64()))], ["sums"])

        got = self.rows.mapInArrow(add, "sums array<bigint>").toArrow()["sums"].combine_chunks()
        sums = got.flatten().to_numpy().reshape(-1, 2, size + 1).sum(0) / ONE
        return (sums[:, :size] + sums[:, size:] * self.zero)[::-1]


def fit(rows: Rows, good: int, bad: int, rounds: int = 100, l2: float = 1e-3, near: float = 1e-4) -> np.ndarray:
    """w by L-BFGS on the logistic loss of all pairs of a good and a bad row.

    What a row adds depends on its worth and on how many rows of the other kind have which worth, so pairs are not listed: a round counts worths at points STEP apart,
    and then adds up features. Between points the chances are taken as straight lines, which is right to about 1e-5.
    """

    def loss(w):
        points, a, b = rows.histogram(w)
        gap = points[None, :] - points[:, None]  # of a bad row over a good one
        a, b = a / good, b / bad
        chance = 1 / (1 + np.exp(-np.clip(gap, -35, 35)))
        return a @ np.logaddexp(0, gap) @ b + l2 / 2 * w @ w, (w, points, chance @ b, a @ chance)

    def slope(at):
        of_good, of_bad = rows.pull(*at)
        return of_bad / bad - of_good / good + l2 * at[0]

    w, past = np.zeros(len(rows.zero)), []
    value, at = loss(w)
    g = slope(at)
    for _ in range(rounds):
        if np.abs(g).max() < near:
            break
        step, back = g.copy(), []
        for s, y in reversed(past):
            back.append(s @ step / (s @ y))
            step -= back[-1] * y
        step *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, float(np.linalg.norm(g)))
        for (s, y), k in zip(past, reversed(back)):
            step += (k - y @ step / (s @ y)) * s
        size, down = 1.0, g @ step
        while (new := loss(w - size * step))[0] > value - 1e-4 * size * down and size > 1e-3:
            size /= 2
        if new[0] >= value:
            break  # as near as the points allow
        slope_there = slope(new[1])
        s, y = new[1][0] - w, slope_there - g
        if s @ y > 0:
            past = [*past, (s, y)][-10:]
        (w, *_), value, g = new[1], new[0], slope_there
    return w


def nth(worths: DataFrame, k: int) -> float:
    """The k-th smallest worth, from 0: counts in ever finer ranges until only one value is left."""
    lo, hi = worths.agg(F.min("worth"), F.max("worth")).first()
    while lo < hi:
        at = F.least(F.floor((F.col("worth") - lo) / ((hi - lo) / RANGES)), F.lit(RANGES - 1))
        for r in sorted(worths.where(F.col("worth").between(lo, hi)).groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min("worth").alias("lo"), F.max("worth").alias("hi")).collect()):
            if k < r["n"]:
                lo, hi = r["lo"], r["hi"]
                break
            k -= r["n"]
    return lo


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """Fits on all labelled rows that are not held out. Only sums of tasks, and what the model holds, come to the driver.

    The model: known shapes, centre and scale of the features, w, the quantile of worths that is the threshold (cut), and their spread.
    """
    chosen = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("quality") > 0).alias("good"))
    rows = tallies(docs.where("doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))).join(chosen, "doc_id")
    rows = written(rows.select("shape", "n", "n_words", "good"), "quality-tallies")
    found = telling(rows)
    if found is None:
        return {"known": pa.array([REPEAT]), "w": np.zeros(2), "centre": np.zeros(2), "scale": np.ones(2), "cut": 0.0, "spread": 1.0}
    good, bad = found.pop("good"), found.pop("bad")
    rows = Rows(written(placed(rows, found["known"]), "quality-rows"), found["centre"], found["scale"])
    w = fit(rows, good, bad)
    worths = written(rows.worths(w), "quality-worths")
    n, s, q = worths.agg(F.count(F.lit(1)), F.sum(_fixed(F.col("worth"), COARSE)), F.sum(_fixed(F.col("worth") ** 2, COARSE))).first()
    at = bad / n * (n - 1)
    low = nth(worths, int(at))
    cut = low + (at - int(at)) * (nth(worths, min(int(at) + 1, n - 1)) - low)
    return found | {"w": w, "cut": cut, "spread": max(q / n / COARSE - (s / n / COARSE) ** 2, 0.0) ** 0.5 or 1.0}


def quality(docs: DataFrame, model: dict) -> DataFrame:
    """Scores every document.

    docs: (doc_id, text), further columns are ignored. Returns (doc_id, held_out, score, predicted), one row for each input row;
    score is between 0 and 1 and predicted is 1 if score >= 0.7. A null text counts as empty, and empty texts get the score of
    their features (no words). A row without an id is not held out. Repeated rows score alike; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def worth(texts: pa.Array) -> pa.Array:
        m, out = shared.value, [np.zeros(0)]
        for k in range(0, len(texts), AT_ONCE):
            x = values(*shapes_of(texts.slice(k, AT_ONCE)), m["known"])
            out.append(np.clip((x - m["centre"]) / m["scale"], -4, 4) @ m["w"])
        release()
        return pa.array(np.concatenate(out))

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), worth(F.col("text").cast("string")).alias("worth"))
    logit = (F.col("worth") - model["cut"]) / (0.5 * model["spread"]) + float(np.log(GOOD / (1 - GOOD)))
    rows = rows.select("doc_id", "held_out", (1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(35.0)), F.lit(-35.0))))).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality(docs, train(docs, table(spark, sf_dir, "labels")))
