"""Registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import automaton, linededup, media, mixing, nearest, packing, quality, ranking, simhash, spelling, suffixes, tokens, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
        "op3_packing": packing.op3_packing,
        "op4_token_counts": tokens.op4_token_counts,
        "op5_nearest": nearest.op5_nearest,
        "op6_line_dedup": linededup.op6_line_dedup,
        "op7_mixing": mixing.op7_mixing,
        "op8_media_columns": media.op8_media_columns,
        "op9_suffix_dedup": suffixes.op9_suffix_dedup,
        "op10_quality": quality.op10_quality,
        "op11_spelling_variants": spelling.op11_spelling_variants,
        "op12_ranked_search": ranking.op12_ranked_search,
        "op13_bpe_automaton": automaton.op13_bpe_automaton,
        "page_sequences": media.page_sequences,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_nearest": nearest.ORACLE, "op6_line_dedup": linededup.ORACLE, "op11_spelling_variants": spelling.ORACLE, "op12_ranked_search": ranking.ORACLE}
