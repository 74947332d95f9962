import pytest

from casegraph.llm import bpe, decontaminate, exact_dedup, ngram_join, substring_dedup, url_filter

from . import brute

WORDS = [f"w{k}" for k in range(400)]
DOCS = [
    (1, " ".join(WORDS[:120])), (2, " ".join(["x", *WORDS[20:90], "y"])), (3, " ".join(WORDS[:118] + ["z", "q"])), (4, None), (5, ""), (6, "  \t\n"), (7, "One two"), (8, "one  TWO "), (9, " ".join(WORDS[:120])),
    (10, " ".join(WORDS[200:260] * 3)), (11, "<|endoftext|> Ünïcödé don't 12 \u00a0 é"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", 0, "b") for i, t in rows], "doc_id long, text string, shard string, bucket int, key string")


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_substring(spark):
    got = rows(substring_dedup.substring_dedup(frame(spark, DOCS)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(brute.substring(DOCS), key=str)
    assert substring_dedup.substring_dedup(frame(spark, [])).count() == 0


def test_near(spark):
    got = rows(ngram_join.near_duplicates(frame(spark, DOCS))[0], "doc_id", "n_shingles", "component_id")
    assert got == sorted(brute.near(DOCS), key=str)
    assert ngram_join.near_duplicates(frame(spark, []))[0].count() == 0


@pytest.mark.parametrize("weak", [False, True])
def test_exact(spark, weak):
    from pyspark.sql import functions as F

    out = exact_dedup.exact_dedup(frame(spark, [*DOCS, (None, "one two")]), **({"hash128": lambda c: F.lit("same")} if weak else {}))
    kept = {r["doc_id"]: r["keep_id"] for r in out.collect()}
    assert kept[9] == 1 and kept[4] == kept[5] == kept[6] and kept[7] == 7 and kept[8] == 8 and kept[1] == 1


def test_bpe(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    want = sorted(((i, tok.encode(t or "", add_special_tokens=False).ids) for i, t in DOCS), key=str)
    for head in (0, 20, bpe.HEAD):
        out = bpe.bpe_round_trip(frame(spark, DOCS), path, head)
        assert rows(out, "doc_id", "ids") == want
        assert rows(out, "doc_id", "decoded") == sorted(((i, tok.decode(x, skip_special_tokens=False)) for i, x in want), key=str)


def test_leaks(spark):
    items = spark.createDataFrame([(1, "a b c"), (2, " ".join(WORDS[30:50])), (3, None), (4, "")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontaminate.decontaminate(frame(spark, [*DOCS, (12, "x A b C. a")]), items).collect()}
    assert got[1] == (20, 1) and got[2] == (20, 1) and got[4] == (0, 0) and got[12] == (3, 1) and got[7] == (0, 0)


def test_leaks_edges(spark):
    many = [(f"i{k:03}", "q w e r t y u i o p") for k in range(300)]  # one window, in many items
    items = [*many, (None, " ".join(WORDS[30:45])), ("a,b", "the"), ("a,b", "the"), ("x", None), ("y", "  ")]
    docs = [("p", "the q w e r t y u i o p end"), ("p", "Q w E r t y u i o p"), (None, " ".join(WORDS[20:60])), ("n", None), ("l", "the " * 40_000), ("o", "nothing here")]
    df = spark.createDataFrame([(*r, 1, "k") for r in docs], "doc_id string, text string, key int, maybe string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = rows(decontaminate.decontaminate(df, bench), "doc_id", "n_words", "n_hit", "n_items", "items_sha256")
    named = lambda ids: brute.sha(",".join(sorted(ids)))
    ids = [i for i, _ in many]
    assert got == sorted([("p", 12, 11, 301, named([*ids, "a,b"])), ("p", 10, 10, 300, named(ids)), (None, 40, 15, 0, named([])), ("n", 0, 0, 0, named([])), ("l", 40_000, 40_000, 1, named(["a,b"])), ("o", 2, 0, 0, named([]))], key=str)
    assert decontaminate.decontaminate(df.limit(0), bench).count() == 0
    assert decontaminate.decontaminate(df, bench.limit(0)).where("contaminated").count() == 0


def test_exact_edges(spark):
    docs = [(2, "a b"), (2, "ab"), (1, "a  b"), (5, "a  b"), (None, "ab "), (7, "é" * 100_000), (8, " " + "é" * 100_000)]
    got = rows(exact_dedup.exact_dedup(frame(spark, docs)), "doc_id", "keep_id", "group_size")
    assert got == sorted([(2, 1, 5), (2, 1, 5), (1, 1, 5), (5, 1, 5), (None, 1, 5), (7, 8, 2), (8, 8, 2)], key=str)
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def test_bpe_edges(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    docs = [(None, "one two"), (None, None), (3, "one"), (3, "two"), (4, "x" * 3000 + " " + "word " * 30_000)]
    want = sorted(((i, tok.encode(t or "", add_special_tokens=False).ids) for i, t in docs), key=str)
    assert rows(bpe.bpe_round_trip(frame(spark, docs), path), "doc_id", "ids") == want
    assert bpe.bpe_round_trip(frame(spark, []), path).count() == 0


def test_globs():
    a = url_filter.GlobAutomaton(["*a*b", "ab", "*", "x" * 70 + "*z"])
    assert a.matches([b"ab", b"xaxb", b"", b"x" * 70 + b"yyz", b"abc"]).tolist() == [[True, True, True, False], [True, False, True, False], [False, False, True, False], [False, False, True, True], [False, False, True, False]]
