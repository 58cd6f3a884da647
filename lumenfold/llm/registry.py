"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenfold.llm import ann, decontaminate, hard_negatives, language_id, lexical_rank, license_scan, line_dedup, mixing, piece_codec, simhash_dedup, suffix_dedup, toxicity, warc_audit


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": license_scan.op1_license_scan,
        "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_simhash": simhash_dedup.op4_simhash,
        "op5_decontaminate": decontaminate.op5_decontaminate,
        "op6_mixing": mixing.op6_mixing,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_warc_fixity": warc_audit.op8_warc_fixity,
        "op9_language_id": language_id.op9_language_id,
        "op10_ann": ann.op10_ann,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_sentencepiece": piece_codec.op12_sentencepiece,
        "op13_lexical_rank": lexical_rank.op13_lexical_rank,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": mixing.OP6_SQL, "op7_line_dedup": line_dedup.OP7_SQL, "op8_warc_fixity": warc_audit.OP8_SQL, "op11_hard_negatives": hard_negatives.OP11_SQL, "op13_lexical_rank": lexical_rank.OP13_SQL}
