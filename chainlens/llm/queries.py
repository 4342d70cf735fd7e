"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, host_quality, html, langid, minhash, negatives, packing, sharding, simhash, substring, suffixes, toxicity, trie


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_sharding": sharding.op2_sharding,
        "op3_language_id": langid.op3_language_id,
        "op4_quality_rules": host_quality.op4_quality_rules,
        "op5_simhash": simhash.op5_simhash,
        "op6_minhash": minhash.op6_minhash,
        "op7_substring": substring.op7_substring,
        "op8_main_text": html.op8_main_text,
        "op9_packing": packing.op9_packing,
        "op10_bpe": bpe.op10_bpe,
        "op11_prefix_trie": trie.op11_prefix_trie,
        "op12_suffix_dedup": suffixes.op12_suffix_dedup,
        "op13_hard_negatives": negatives.op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": host_quality.OP4_SQL, "op7_substring": substring.OP7_SQL, "op11_prefix_trie": trie.OP11_SQL, "op13_hard_negatives": negatives.OP13_SQL}
