"""The queries of this subpackage by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rowgraph.llm import ann, bpe, embedding_dedup, jaccard, line_dedup, packing, pii, quality, secrets, suffix_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": bpe.query,
    "op2_best_fit_packing": packing.query,
    "op3_embedding_near_dedup": embedding_dedup.query,
    "op4_sparse_suffix_array": suffix_dedup.query,
    "op5_line_dedup": line_dedup.query,
    "op6_permutation_index": ann.query,
    "op7_pii_surrogates": pii.query,
    "op8_ngram_jaccard": jaccard.query,
    "op9_secret_scan": secrets.query,
    "op10_quality": quality.query,
}

ORACLES: dict[str, str] = {
    "op5_line_dedup": line_dedup.SQL,
}
