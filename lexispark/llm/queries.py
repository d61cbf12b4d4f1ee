"""The queries of this subpackage, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexispark.llm import chat, decontaminate, licenses, line_dedup, packing, simhash, suffix_dedup, topk_search, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_warc": warc.op2_warc,
    "op3_chat_format": chat.op3_chat_format,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_topk_search": topk_search.op6_topk_search,
    "op7_simhash": simhash.op7_simhash,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_license_scan": licenses.op10_license_scan,
}
SQL: dict[str, str] = {
    "op1_decontaminate": decontaminate.SQL,
    "op2_warc": warc.SQL,
    "op5_suffix_dedup": suffix_dedup.SQL,
    "op6_topk_search": topk_search.SQL,
    "op9_line_dedup": line_dedup.SQL,
}
