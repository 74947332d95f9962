"""The training-text pipeline: five stages, each on what the one before kept, written and read again between them.

In every stage a null text counts as empty, rows that repeat an id are one document (kept or dropped together, those with a
null id too), further columns stay as they are, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from casegraph.llm import bpe, decontaminate, exact_dedup, ngram_join, toxicity
from casegraph.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. The model is fitted on the labelled rows of the corpus; without any, all stay.

    Here each row is judged on its own text, also where rows repeat an id.
    """
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.filter_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal texts, the document that stays: the longest in its original form, then the smallest id. Empty texts are one group."""
    kept = exact_dedup.exact_dedup(docs).where("kept").select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, the document with the smallest id. Texts without words are linked with nothing and stay."""
    members, _ = ngram_join.near_duplicates(docs)
    kept = members.where("doc_id <=> component_id").select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; with an empty benchmark all stay."""
    clean = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("NOT contaminated").select("doc_id").distinct()
    return docs.join(clean, docs["doc_id"].eqNullSafe(clean["doc_id"]), "left_semi")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, a row for each row."""
    import public_tokenizers

    return bpe.bpe_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near), ("decontaminate", drop_leaks), ("bpe", encode)]
#: The toxicity model is fitted, which SQL can't express; tests/llm/test_more.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
