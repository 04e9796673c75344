"""The corpus operators' registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, chat, lines, mixing, neardup, pieces, quality, secrets, sharding, substrings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": neardup.op1_minhash_near_dedup,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_substring_dedup": substrings.op3_substring_dedup,
    "op4_sentencepiece": pieces.op4_sentencepiece,
    "op5_line_dedup": lines.op5_line_dedup,
    "op6_mixing": mixing.op6_mixing,
    "op7_chat_formatting": chat.op7_chat_formatting,
    "op8_secret_scans": secrets.op8_secret_scans,
    "op9_nearest_neighbours": ann.op9_nearest_neighbours,
    "op10_sharding": sharding.op10_sharding,
}

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": neardup.SQL,
    "op2_quality_rules": quality.SQL,
    "op3_substring_dedup": substrings.SQL,
    "op5_line_dedup": lines.SQL,
    "op6_mixing": mixing.SQL,
    "op7_chat_formatting": chat.SQL,
    "op8_secret_scans": secrets.SQL,
    "op10_sharding": sharding.SQL,
}
