"""Queries of the text operators and, where SQL can express them, the same rows in DuckDB SQL."""

from __future__ import annotations

from . import bpe, byte_bpe, collocations, ctw, decontam, divergence, html_extract, jaccard_join, quote_link, suffix_dedup, topk, toxicity, url_filter

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.query,
    "op2_toxicity": toxicity.query,
    "op3_html_extract": html_extract.query,
    "op4_jaccard_join": jaccard_join.query,
    "op5_decontaminate": decontam.query,
    "op6_url_filter": url_filter.query,
    "op7_quote_link": quote_link.query,
    "op8_top_k": topk.query,
    "op9_bpe": bpe.query,
    "op10_context_tree_weighting": ctw.query,
    "op11_collocations": collocations.query,
    "op12_source_divergence": divergence.query,
    "op13_byte_bpe": byte_bpe.query,
}

ORACLE_SQL: dict[str, str] = {
    "op4_jaccard_join": jaccard_join.SQL,
    "op7_quote_link": quote_link.SQL,
    "op8_top_k": topk.SQL,
    "op11_collocations": collocations.SQL,
    "op12_source_divergence": divergence.SQL,
}
