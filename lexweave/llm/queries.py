"""Queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from lexweave.llm import chat, decontaminate, html, jaccard, language, licenses, mixing, quality, topk, urls

QUERIES = {
    "op1_source_mixing": mixing.query,
    "op2_quality_pairwise": quality.query,
    "op3_url_filter": urls.query,
    "op4_license_scan": licenses.query,
    "op5_ngram_jaccard": jaccard.query,
    "op6_html_extraction": html.query,
    "op7_benchmark_decontamination": decontaminate.query,
    "op8_chat_formatting": chat.query,
    "op9_exact_topk": topk.query,
    "op9_exact_topk_by_document": topk.query_by_document,
    "op10_language_id": language.query,
}
SQL = {
    "op1_source_mixing": mixing.SQL,
    "op3_url_filter": urls.SQL,
    "op8_chat_formatting": chat.SQL,
    "op9_exact_topk": topk.SQL,
    "op9_exact_topk_by_document": topk.SQL_BY_DOCUMENT,
}
