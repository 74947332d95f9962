"""Information-theoretic sanitisation, in DataFrame functions only.

Four base kinds are found by pattern. Their values are the protected entities. Over the whole corpus, the co-occurrence of a
term t with an entity e gives PMI(t, e) = log2(p(e | t) N / n(e)) by documents: how many bits t tells about e. p(e | t) is
smoothed towards n(e) / N, as (n(t, e) + PRIOR n(e) / N) / (n(t) + PRIOR), so that rare terms and entities count, with less
trust. In a document that holds e, a term with at least BITS bits and at least SHARE of all that e holds (log2(N / n(e)))
discloses e although e itself is masked; such terms are marked too. Masking generalises a base span to its kind and removes
a term.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import IntegralType

from .common import table, written

#: The fixed patterns of the base kinds, with possessive repeats, and guards that skip starts which can't be leftmost: the
#: same matches, without backtracking over long runs.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Disclosure: bits; share of the entity's information; what the entity's share of all documents weighs against a term's own, in documents.
BITS, SHARE, PRIOR = 6.0, 0.9, 0.5
TERM = r"\p{L}{4,}"
MARK, OTHER = "\uFDD0", "\uFDD1"  # characters that no pattern matches; the first in a text is read as the second
SPAN = "array<struct<start:int,end:int,value:string>>"


#: Matches that one inner fold adds to its array; folds over all matches of a text would copy with the square of their number.
CHUNK = 256
#: Classes of a document's entities that meet its terms in one group.
BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pieces(text: Column, pattern: str) -> Column:
    """The text cut at leftmost non-overlapping matches: what is between them at even places, from 0, matches at odd ones."""
    return F.split(F.regexp_replace(F.translate(text, MARK, OTHER), F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK)


def spans(text: Column, pattern: str, keep: Callable[[Column], Column] = lambda p: F.lit(True)) -> Column:
    """Leftmost non-overlapping matches whose value meets keep, as (start, end, value), in code points, end exclusive."""
    none = F.array().cast(SPAN)
    zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), none.alias("out"))

    def step(s: Column, p: Column) -> Column:
        end = s["at"] + F.char_length(p)
        return F.struct(end.alias("at"), (~s["hit"]).alias("hit"), F.when(s["hit"] & keep(p), F.array_append(s["out"], F.struct(s["at"].alias("start"), end.alias("end"), p.alias("value")))).otherwise(s["out"]).alias("out"))

    def shifted(s: Column, part: Column) -> Column:
        moved = F.transform(part["out"], lambda m: F.struct((m["start"] + s["at"]).alias("start"), (m["end"] + s["at"]).alias("end"), m["value"].alias("value")))
        return F.struct((s["at"] + part["at"]).alias("at"), F.array_append(s["out"], moved).alias("out"))

    parts = let(pieces(text, pattern), lambda ps: F.transform(F.sequence(F.lit(0), F.floor((F.size(ps) - 1) / CHUNK).cast("int")), lambda c: F.aggregate(F.slice(ps, c * CHUNK + 1, F.lit(CHUNK)), zero, step)))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
    return F.aggregate(parts, start, shifted, lambda s: F.flatten(s["out"]))


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total: Column, k: Column) -> Column:
        d = F.substring(back, k, F.lit(1)).cast("int") * F.when(k % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


def valid(kind: str) -> Callable[[Column], Column]:
    """Whether a match of the kind's pattern is one."""
    digits = lambda v: F.regexp_replace(v, "[^0-9]", "")
    small = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
    keep = {
        "email": None,
        "ip": lambda v: v.rlike(small),
        "card": lambda v: F.when(F.char_length(digits(v)).between(16, 19), luhn(digits(v))).otherwise(False),
        "phone": lambda v: F.char_length(digits(v)).between(8, 15),
    }
    return lambda v: F.lit(True) if keep[kind] is None else keep[kind](v)


def base_spans(text: Column) -> dict[str, Column]:
    out = {}
    for kind, pattern in PATTERNS.items():
        may = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, text.rlike("[0-9]"))
        out[kind] = F.when(may, spans(text, pattern, valid(kind))).otherwise(F.array().cast(SPAN))
    return out


def terms_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def once(docs: DataFrame) -> DataFrame:
    """docs (key, text) with one row for each key: the distinct texts of a repeated key become one."""
    again = written(docs.groupBy("key").count().where("count > 1").select("key"), "pii-again")
    if again.isEmpty():
        return docs
    merged = docs.join(again, "key", "left_semi").groupBy("key").agg(F.array_join(F.collect_set("text"), "\n").alias("text"))
    return docs.join(again, "key", "left_anti").unionByName(merged)


def classes(rows: DataFrame, what: str, n: str) -> DataFrame:
    """rows (key, what, n) with (n, x, y), a class of those that the same keys have: two independent hashes of the set, and n."""
    sets = rows.groupBy(what, n).agg(F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(7))).alias("y"))
    return rows.join(sets, [what, n])


def disclosing(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(key, terms): for each document with an entity, the terms that disclose it.

    docs: (key, text), found: (key, values, terms) of those with an entity, both with one row for each key.

    What one common document suffices for needs no pairs: in each document that is a bound on a term's count. For the other
    terms, pairs with entities are counted, in classes of entities and terms that the same documents hold, so that copies of
    a long list are one pair; BLOCK classes of a document's entities at a time meet its terms.
    """
    total = float(max(docs.count(), 1))
    info = F.log2(F.lit(total) / F.col("n_e"))

    def tells(n_te: Column, n_t: Column = F.col("n_t")) -> Column:
        pmi = info + F.log2((n_te + PRIOR * F.col("n_e") / total) / (n_t + PRIOR))
        return (pmi >= BITS) & (pmi >= SHARE * info)

    held = found.select("key", F.explode("values").alias("e"))
    # the most documents that a term may be in if it has one in common with the entity: the formula turned around, and tried
    about = F.floor((1 + PRIOR * F.col("n_e") / total) * F.pow(F.lit(2.0), info - F.greatest(F.lit(BITS), SHARE * info)) - PRIOR).cast("long")
    alone = F.when(tells(F.lit(1), about + 1), about + 1).when(tells(F.lit(1), about), about).otherwise(about - 1)
    held = held.join(held.groupBy("e").agg(F.count(F.lit(1)).alias("n_e")).where(info >= BITS), "e")
    held = written(held.withColumn("alone", alone), "pii-held")
    # no pair passes where n_t is above this for every entity, as n_te is n_e at most
    most = held.agg(F.max((F.col("n_e") + PRIOR) * F.pow(F.lit(2.0), (1 - SHARE) * info))).first()[0] or 0.0
    often = docs.select(F.explode(terms_of(F.col("text"))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n_t")).where(F.col("n_t") <= most)
    rare = written(found.select("key", F.explode("terms").alias("t")).join(often, "t"), "pii-rare")
    simple = rare.join(held.groupBy("key").agg(F.max("alone").alias("alone")), "key").where("n_t <= alone").select("key", "t")

    several = classes(held.where("n_e > 1").select("key", "e", "n_e", "alone"), "e", "n_e").select("key", "n_e", "alone", F.struct("n_e", "x", "y").alias("c_e")).distinct()
    nth = F.row_number().over(Window.partitionBy("key").orderBy("c_e")) - 1
    several = written(several.withColumn("block", F.floor(nth / BLOCK).cast("int")), "pii-entities")
    shared = written(classes(rare.where("n_t > 1"), "t", "n_t").select("key", "t", "n_t", F.struct("n_t", "x", "y").alias("c_t")), "pii-terms")
    blocks = several.groupBy("key").agg(F.max("block").alias("last")).select("key", F.explode(F.sequence(F.lit(0), "last")).alias("block"))
    terms = shared.select("key", "n_t", "c_t").distinct().join(blocks, "key")
    pairs = several.join(terms, ["key", "block"]).where(F.col("n_t") > F.col("alone")).where(tells(F.least("n_e", "n_t")))
    told = pairs.groupBy("c_e", "n_e", "c_t", "n_t").agg(F.count(F.lit(1)).alias("n_te")).where(tells(F.col("n_te"))).select("c_e", "c_t")
    counted = several.select("key", "c_e").join(written(told, "pii-told"), "c_e").select("key", "c_t").distinct().join(shared.select("key", "c_t", "t"), ["key", "c_t"]).select("key", "t")
    return simple.unionByName(counted).groupBy("key").agg(F.collect_set("t").alias("terms"))


def find_pii(docs: DataFrame) -> DataFrame:
    """Spans of personal data in every text.

    docs: (doc_id, text), ids of any type; further columns are ignored. Returns (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans,
    n_term, sanitised), one row for each input row. A null or empty text has no span. Repeated rows, and rows without an id,
    are handled each on their own text; rows that repeat an id count as one document in the statistics and share the
    terms found for it. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # a document's key in the statistics; ids that are no integers keep their text, and rows without one are told apart by theirs
    whole = isinstance(docs.schema["doc_id"].dataType, IntegralType)
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text)) if whole else F.coalesce(F.concat(F.lit("id "), F.col("doc_id").cast("string")), F.concat(F.lit("no id "), F.sha2(text, 256)))
    docs = docs.select("doc_id", key.alias("key"), text.alias("text"))
    base = docs.select("doc_id", "key", "text", *[c.alias(k) for k, c in base_spans(F.col("text")).items()])
    prefixed = lambda k: F.transform(k, lambda m: F.concat(F.lit(f"{k}:"), m["value"]))
    values = F.array_distinct(F.concat(*[prefixed(k) for k in PATTERNS]))
    whole = once(docs.select("key", "text"))
    found = whole.select("key", "text", *[c.alias(k) for k, c in base_spans(F.col("text")).items()])
    found = written(found.select("key", values.alias("values"), terms_of(F.col("text")).alias("terms")).where(F.size("values") > 0), "pii-found")
    terms = disclosing(whole, found)
    rows = base.select("doc_id", "key", "text", *PATTERNS).join(terms, "key", "left")
    # words of an address go with it; the other kinds hold no letters
    told = spans(replaced(F.col("text"), "email", lambda p: F.repeat(F.lit(OTHER), F.char_length(p))), TERM, lambda p: F.array_contains("terms", F.lower(p)))
    rows = rows.withColumn("term", F.when(F.size("terms") > 0, told).otherwise(F.array().cast(SPAN)))
    named = lambda k: F.transform(k, lambda m: F.concat_ws(":", F.lit(k), m["start"].cast("string"), m["end"].cast("string")))
    return rows.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS], F.sha2(F.array_join(F.concat(*[named(k) for k in PATTERNS]), ","), 256).alias("base_sha256"),
        F.array_join(F.concat(*[named(k) for k in PATTERNS], named("term")), ",").alias("spans"), F.size("term").cast("long").alias("n_term"), masked(F.col("text"), F.col("terms")).alias("sanitised"),
    )


def replaced(text: Column, kind: str, by: Callable[[Column], Column]) -> Column:
    """The text with each span of a base kind replaced."""
    keep = valid(kind)
    return F.array_join(F.transform(pieces(text, PATTERNS[kind]), lambda p, k: F.when((k % 2 == 1) & keep(p), by(p)).otherwise(p)), "")


def masked(text: Column, terms: Column) -> Column:
    """The text with base spans generalised to their kind, kind by kind as listed, each in what is left, and disclosing terms removed."""
    tags = {kind: chr(0xFDD2 + k) for k, kind in enumerate(PATTERNS)}  # no pattern matches them, and the text has none
    text = F.translate(text, "".join(tags.values()), OTHER * len(tags))
    for kind, tag in tags.items():
        text = replaced(text, kind, (lambda t: lambda p: F.lit(t))(tag))
    parts = F.transform(pieces(text, TERM), lambda p, k: F.when((k % 2 == 1) & F.coalesce(F.array_contains(terms, F.lower(p)), F.lit(False)), "").otherwise(p))
    text = F.array_join(parts, "")
    for kind, tag in tags.items():
        text = F.replace(text, F.lit(tag), F.lit(f"[{kind.upper()}]"))
    return text


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents")).drop("sanitised")
