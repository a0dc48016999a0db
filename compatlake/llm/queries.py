"""The registered queries of this subpackage, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    bpe,
    byte_bpe,
    chat_format,
    conversation_repair,
    exact_dedup,
    fingerprints,
    language_id,
    packing,
    periodic_runs,
    secret_scan,
    simhash_dedup,
    substring_dedup,
    url_filter,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": substring_dedup.query,
    "op2_simhash_dedup": simhash_dedup.query,
    "op3_bpe": bpe.query,
    "op4_chat_format": chat_format.query,
    "op5_secret_scan": secret_scan.query,
    "op6_url_filter": url_filter.query,
    "op7_exact_dedup": exact_dedup.query,
    "op8_fingerprints": fingerprints.query,
    "op9_language_id": language_id.query,
    "op10_best_fit_packing": packing.query,
    "op11_periodic_runs": periodic_runs.query,
    "op12_conversation_repair": conversation_repair.query,
    "op13_byte_bpe": byte_bpe.query,
}

ORACLE: dict[str, str] = {
    "op4_chat_format": chat_format.ORACLE,
    "op6_url_filter": url_filter.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
}
