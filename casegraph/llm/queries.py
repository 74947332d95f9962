"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, exact_dedup, ngram_join, pii, quality, source_audit, spelling, substring_dedup, suffix_dedup, toxicity, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_bpe": bpe.op2_bpe,
    "op3_warc": warc.op3_warc,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_pii": pii.op6_pii,
    "op7_ngram_jaccard": ngram_join.op7_ngram_jaccard,
    "op8_quality": quality.op8_quality,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_spelling": spelling.op11_spelling,
    "op12_source_audit": source_audit.op12_source_audit,
    "op13_suffix_dedup": suffix_dedup.op13_suffix_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": substring_dedup.OP1_SQL,
    "op3_warc": warc.OP3_SQL,
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op7_ngram_jaccard": ngram_join.OP7_SQL,
    "op9_url_filter": url_filter.OP9_SQL,
    "op10_decontaminate": decontaminate.OP10_SQL,
    "op11_spelling": spelling.OP11_SQL,
    "op12_source_audit": source_audit.OP12_SQL,
    "op13_suffix_dedup": suffix_dedup.OP13_SQL,
}
