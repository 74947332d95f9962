"""Spelling variants, source divergence and suffix-array dedup against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from casegraph.llm import source_audit, spelling, suffix_dedup

from . import brute


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


SPELLING = ("word", "form", "root", "n", "n_near", "form_n")


@pytest.mark.parametrize("drop", [199, 7, None])
def test_spelling(spark, drop):
    rnd = random.Random(3)
    base = ["".join(rnd.choices("abÀéÿo", k=rnd.randint(5, 9))) for _ in range(12)]
    data = [(None, "Banana BANANA " * 9), (1, None), (2, ""), (2, "élanés ÉLANÉS " * 7), (2, "élanés " * 40), (3, "x" * 30_000 + " " + ("y" * 9_000 + " ") * 6 + ("y" * 9_001 + "-") * 6)]
    for k in range(60):
        words = []
        for _ in range(80):
            w = list(rnd.choice(base[: rnd.choice((2, 5, 12))]))
            for _ in range(rnd.choice((0, 0, 0, 1, 2))):
                w[rnd.randrange(len(w))] = rnd.choice(["", "a", "bb", "é"])
            words.append("".join(w))
        data.append((10 + k, rnd.choice((" ", "_", "\n3")).join(words)))
    df = spark.createDataFrame([(*r, 1, "z") for r in data], "doc_id long, text string, n int, word string")
    got = rows(spelling.spelling_variants(df, drop=drop), *SPELLING)
    assert got == sorted(brute.spelling(data, drop=drop), key=str) and sum(r[1] is not None for r in got) > 20
    assert spelling.spelling_variants(df.limit(0), drop=drop).count() == 0


def test_spelling_chain(spark):
    w = ["abcdefgh", "abcdefgi", "abcdefji", "abcdekji"]
    data = [(k, " ".join([x] * (5 * 5**k))) for k, x in enumerate(w)]
    df = spark.createDataFrame(data, "doc_id string, text string")
    assert rows(spelling.spelling_variants(df, drop=None), "word", "root") == [(x, w[-1]) for x in w]


AUDIT = ("lang", "source", "part", "item", "value", "rank")


@pytest.mark.parametrize("small", [False, True])
def test_audit(spark, small, monkeypatch):
    if small:
        monkeypatch.setattr(source_audit, "BLOCK_ROWS", 7)
        monkeypatch.setattr(source_audit, "CELLS", 20)
    rnd = random.Random(4)
    words = ["alpha", "Beta", "GAMMA", "éa", "É", "don't", "x1y", "--", "a.b.a", "\u00a0z", "(beta)", "beta;"]
    data = [(rnd.choice(["en", "de", None]), rnd.choice(["a", "b", "ü", "B", None]), rnd.choice([" ", "\n", "\t "]).join(rnd.choices(words[: rnd.randint(2, 12)], k=rnd.randint(0, 30)))) for _ in range(60)]
    data += [("en", "a", None), ("en", "none", "1 2 ---"), ("solo", "s", "one two"), ("two", "p", "only"), ("two", "q", "other"), ("en", "b", "beta " * 50_000), ("en", "a", "x" * 100_000)]
    data += data[:9]
    df = spark.createDataFrame([(k, 3, *r, "t") for k, r in enumerate(data)], "doc_id long, n int, lang string, source string, text string, term string")
    assert rows(source_audit.source_divergence(df, top=5), *AUDIT) == sorted(brute.audit(data, top=5), key=str)
    assert source_audit.source_divergence(df.limit(0)).count() == 0


BYTES = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("plan", [{}, {"hot": 2}, {"hot": 0}, {"kgram": 50}])
def test_suffix(spark, plan, monkeypatch):
    rnd = random.Random(6)
    text = lambda n, of="abcdeé ": "".join(rnd.choices(of, k=n))
    passages = [text(rnd.randint(40, 130)) for _ in range(6)]
    data = [(k, text(rnd.randint(0, 60)).join(rnd.choices(passages, k=rnd.randint(0, 4)))) for k in range(40)]
    for k in range(40, 60):  # near copies
        t = list(data[k % 3][1])
        for _ in range(3 if t else 0):
            t[rnd.randrange(len(t))] = rnd.choice("xyz")
        data.append((k, "".join(t)))
    data += [(70, None), (71, ""), (72, "a" * 49), (73, "a" * 50), (74, "a" * 300), (75, "ab" * 200), (76, "a" * 50 + "\x00" * 60), (77, "\x00" * 70)]
    data += [data[3], (3, data[5][1]), (None, data[0][1] + passages[0]), (None, passages[0] * 2), (-5, passages[1]), (90, "".join(passages) * 50), (91, text(60) + "".join(passages) * 50)]
    df = spark.createDataFrame([(*r, 0, "x") for r in data], "doc_id long, text string, shard int, keys string")
    monkeypatch.setattr(suffix_dedup, "PIECE", 200)
    got = suffix_dedup.suffix_dedup(df.orderBy(F.rand()), **plan)
    assert rows(got, *BYTES) == sorted(brute.substring_bytes(data), key=str)
    assert suffix_dedup.suffix_dedup(df.limit(0), **plan).count() == 0


def test_suffix_pieces():
    """Pieces give the anchors of the whole, and the sort is the order of the bytes."""
    import numpy as np
    import pyarrow as pa

    rnd = np.random.default_rng(2)
    texts = pa.array([bytes(rnd.integers(97, 99, n).astype(np.uint8)).decode() for n in (5000, 10, 0, 700, 50, 51)])
    whole, size = suffix_dedup.Anchors(texts, 50, 24, 7), suffix_dedup.PIECE
    suffix_dedup.PIECE = 333
    cut = suffix_dedup.Anchors(texts, 50, 24, 7)
    suffix_dedup.PIECE = size
    windows = lambda a: sorted((int(s), int(p)) for lo, hi, p in zip(a.low, a.high, a.at) for s in range(lo, hi + 1))
    assert windows(whole) == windows(cut) and len(windows(whole)) == 4951 + 651 + 1 + 2
    rows_ = rnd.integers(0, 2, (500, 21)).astype(np.uint8)
    order = suffix_dedup.multikey_sort(rows_)
    assert [bytes(rows_[k]) for k in order] == sorted(bytes(r) for r in rows_)
