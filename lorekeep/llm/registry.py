"""The queries of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm import (
    decontaminate,
    hard_negatives,
    language_id,
    lexical_search,
    line_dedup,
    media,
    pii,
    quality,
    secrets,
    sentencepieces,
    sharding,
    simhash,
    substring_dedup,
)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_line_dedup": line_dedup.op2_line_dedup,
        "op3_language_id": language_id.op3_language_id,
        "op4_personal_data": pii.op4_personal_data,
        "op5_feistel_sharding": sharding.op5_feistel_sharding,
        "op6_substring_dedup": substring_dedup.op6_substring_dedup,
        "op7_secret_scan": secrets.op7_secret_scan,
        "op8_media_columns": media.op8_media_columns,
        "op9_sentencepiece": sentencepieces.op9_sentencepiece,
        "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
        "op11_lexical_search": lexical_search.op11_lexical_search,
        "op12_quality_rules": quality.op12_quality_rules,
        "op13_hard_negatives": hard_negatives.op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": line_dedup.OP2_SQL,
        "op6_substring_dedup": substring_dedup.OP6_SQL,
        "op11_lexical_search": lexical_search.OP11_SQL,
        "op12_quality_rules": quality.OP12_SQL,
        "op13_hard_negatives": hard_negatives.OP13_SQL,
    }
