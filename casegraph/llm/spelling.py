"""Spelling variants by asymmetric q-chunks: words one edit apart, and the common form that each rare one stands for.

Of two words one edit apart, the longer (of two as long, the smaller) gives two disjoint chunks, each of half its length; the
other one gives its positional grams of that length. The edit touches one chunk at most, so the other chunk is among the grams:
the first at the same place, the second shifted by what the lengths differ, by one at most. Chunks and grams meet in a join by
length, chunk and text, and each pair that meets is verified by its edit distance. A pair that meets by both chunks counts by the
first. A form has at least RATIO times the occurrences of its word, so a chain of forms is as long as a logarithm allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table, written

#: Code points and occurrences that a word has at least, how much more frequent its form is, and one word in so many that loses a letter.
LEAST_SIZE, LEAST_N, RATIO, DROP = 6, 5, 5, 199
RUN = "[A-Za-zÀ-ÿ]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lowered(run: Column) -> Column:
    """Only A-Z in lower case; what holds nothing else takes the fast way."""
    return F.when(F.octet_length(run) == F.char_length(run), F.lower(run)).otherwise(F.translate(run, UPPER, UPPER.lower()))


def word_counts(docs: DataFrame, least_size: int = LEAST_SIZE, least_n: int = LEAST_N, drop: int | None = DROP) -> DataFrame:
    """(word, n) of the words of all texts that are long and frequent enough. drop=None leaves every word as it is.

    A word whose crc32 with its document's id is a multiple of drop loses one letter, chosen by the same number.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.char_length("run") >= least_size).select("doc_id", lowered(F.col("run")).alias("word"))
    if drop:
        h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")))
        at = (F.col("h") % F.char_length("word")).cast("int")
        cut = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.char_length("word")))
        runs = runs.withColumn("h", h).select(F.when(F.col("h") % drop == 0, cut).otherwise(F.col("word")).alias("word")).where(F.char_length("word") >= least_size)
    return runs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b): each pair of distinct words one edit apart, once. words: (word, n), words distinct and of two letters at least."""
    size = F.char_length("word")
    half = lambda n: F.floor(n / 2).cast("int")
    part = lambda at, n: F.substring(F.col("word"), at, n)
    key = lambda n, side, text: F.struct(n.alias("size"), F.lit(side).alias("side"), text.alias("text"))
    chunks = F.array(key(size, 1, part(F.lit(1), half(size))), key(size, 2, part(half(size) + 1, half(size))))
    grams = F.array(*[key(size + d, side, part(F.lit(1) if side == 1 else half(size + d) + 1 - d, half(size + d))) for d in (0, 1) for side in (1, 2)])
    a = words.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.explode(chunks).alias("k"))
    b = words.select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.explode(grams).alias("k"))
    a, b = (x.select(*x.columns[:2], "k.size", "k.side", "k.text") for x in (a, b))
    h = half(F.char_length("a"))
    once = (F.col("side") == 1) | (F.substring(F.col("a"), F.lit(1), h) != F.substring(F.col("b"), F.lit(1), h))
    met = a.join(b, ["size", "side", "text"]).where((F.char_length("a") > F.char_length("b")) | (F.col("a") < F.col("b"))).where(once)
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "b", "n_a", "n_b")


def with_roots(forms: DataFrame, ratio: int = RATIO) -> DataFrame:
    """forms (word, form, n, form_n) with root: where the chain of forms ends. The steps double in each round."""
    links = written(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-links-0")
    top, length = forms.agg(F.max("n")).first()[0] or 0, 1
    longest = 0
    while top >= ratio:
        top, longest = top // ratio, longest + 1
    k = 0
    while length < longest:
        after = links.select(F.col("word").alias("root"), F.col("root").alias("far"))
        k, length = k + 1, 2 * length
        links = written(links.join(after, "root", "left").select("word", F.coalesce("far", "root").alias("root")), f"spelling-links-{k}")
    return forms.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, least_size: int = LEAST_SIZE, least_n: int = LEAST_N, ratio: int = RATIO, drop: int | None = DROP) -> DataFrame:
    """Groups the spelling variants of the words of all texts.

    docs: (doc_id, text), further columns are ignored. Returns (word, form, root, n, n_near, form_n), one row for each word of at least
    least_size code points (2 at least) and least_n occurrences: its most frequent near word (of equal ones the smallest) if that occurs at least ratio
    times as often, else null; the end of the chain of forms, or the word itself; its own and the form's occurrences; how many words are near.
    A null text has no words, a null id reads as ''; rows that repeat an id all count; an empty table gives an empty result.
    """
    if least_size < 2 or ratio < 2:
        raise ValueError("words of one letter have no two chunks, and forms have to be more frequent")
    words = written(word_counts(docs, least_size, least_n, drop), "spelling-words")
    pairs = near_pairs(words)
    side = lambda x, y: F.struct(F.col(x).alias("word"), F.struct((-F.col(f"n_{y}")).alias("minus"), F.col(y).alias("near")).alias("x"))
    both = pairs.select(F.inline(F.array(side("a", "b"), side("b", "a"))))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("x").alias("x"))
    forms = words.join(best, "word", "left")
    enough = -F.col("x.minus") >= ratio * F.col("n")
    forms = forms.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("x.near")).alias("form"), F.when(enough, -F.col("x.minus")).alias("form_n"))
    return with_roots(written(forms, "spelling-forms"), ratio).select("word", "form", "root", "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


#: crc32 is linear: the xor of what each byte gives by its distance from the end, and of what the length gives.
OP11_SQL = r"""
WITH RECURSIVE runs AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
    FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS r FROM documents)),
msg AS (SELECT doc_id, w, count(*) AS n, coalesce(doc_id::VARCHAR, '') || ':' || w AS m FROM runs WHERE length(w) >= 6 GROUP BY doc_id, w),
byt AS (SELECT DISTINCT m, hex(encode(m)) AS x FROM msg),
one AS (SELECT m, len(x) // 2 - 1 - i AS d, (('0x' || substr(x, 2 * i + 1, 2))::INT)::BIGINT AS b FROM (SELECT m, x, unnest(range(len(x) // 2)) AS i FROM byt)),
bits AS (SELECT b, 0 AS k, b AS c FROM range(256) t(b) UNION ALL SELECT b, k + 1, xor(c >> 1, 3988292384 * (c & 1)) FROM bits WHERE k < 8),
t0 AS (SELECT b, c FROM bits WHERE k = 8),
far AS (SELECT 0 AS d, b, c FROM t0 UNION ALL SELECT d + 1, far.b, xor(far.c >> 8, t0.c) FROM far JOIN t0 ON t0.b = (far.c & 255) WHERE d < (SELECT max(len(x)) // 2 FROM byt)),
ini AS (SELECT 0 AS len, 4294967295::BIGINT AS c UNION ALL SELECT len + 1, xor(ini.c >> 8, t0.c) FROM ini JOIN t0 ON t0.b = (ini.c & 255) WHERE len < (SELECT max(len(x)) // 2 FROM byt)),
crc AS (SELECT m, xor(xor(s, ini.c), 4294967295::BIGINT) AS h FROM (SELECT m, bit_xor(c) AS s, count(*) AS len FROM one JOIN far USING (d, b) GROUP BY m) JOIN ini USING (len)),
cut AS (SELECT n, CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word FROM msg JOIN crc USING (m)),
v AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
dels AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS del FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
met AS (SELECT a.word, b.word AS other, b.n AS m FROM dels a JOIN dels b USING (del, i) WHERE a.word <> b.word
    UNION SELECT a.word, v.word, v.n FROM dels a JOIN v ON a.del = v.word UNION SELECT v.word, a.word, a.n FROM dels a JOIN v ON a.del = v.word),
near AS (SELECT DISTINCT * FROM met),
best AS (SELECT word, count(*) AS n_near, min_by(other, {'m': -m, 'w': other}) AS near, max(m) AS m FROM near GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 5 * v.n THEN near END AS form, CASE WHEN m >= 5 * v.n THEN m END AS form_n FROM v LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root, form AS nxt FROM f UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN f ON f.word = walk.nxt)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN walk ON f.word = walk.word AND walk.nxt IS NULL
"""
