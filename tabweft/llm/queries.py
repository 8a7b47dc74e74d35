"""Queries of this subpackage: one ``opN_<name>`` for each operator, and ``pipeline``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabweft.llm import alignment, bpe, exact_dedup, near_dedup, packing, quality_rules, sharding, substring_dedup, token_output, toxicity, variants, vector_packing, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_segment_tree_bpe": bpe.op2_segment_tree_bpe,
        "op3_best_fit_packing": packing.op3_best_fit_packing,
        "op4_karmarkar_karp_sharding": sharding.op4_karmarkar_karp_sharding,
        "op5_seekable_token_files": token_output.op5_seekable_token_files,
        "op6_warc_archives": warc.op6_warc_archives,
        "op7_sentence_span_dedup": substring_dedup.op7_sentence_span_dedup,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_quality_rules": quality_rules.op9_quality_rules,
        "op10_minhash_near_dedup": near_dedup.op10_minhash_near_dedup,
        "op11_token_alignment": alignment.op11_token_alignment,
        "op12_vector_packing": vector_packing.op12_vector_packing,
        "op13_spelling_variants": variants.op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_warc_archives": warc.oracle_sql(),
        "op8_exact_dedup": exact_dedup.oracle_sql(),
        "op10_minhash_near_dedup": near_dedup.oracle_sql(),
    }
