"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, decontaminate, exact_search, html_extract, ngram_join, pieces, quality, runs, sharding, sql, suffix_dedup, tokens, urls, vector_codes


def queries() -> dict:
    return {
        "op1_ngram_jaccard": ngram_join.op1_ngram_jaccard,
        "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
        "op3_decontamination": decontaminate.op3_decontamination,
        "op4_html_extraction": html_extract.op4_html_extraction,
        "op5_token_counts": tokens.op5_token_counts,
        "op6_sentencepiece": pieces.op6_sentencepiece,
        "op7_url_filters": urls.op7_url_filters,
        "op8_sharding": sharding.op8_sharding,
        "op9_quality_rules": quality.op9_quality_rules,
        "op10_chat_formatting": chat.op10_chat_formatting,
        "op11_vector_codes": vector_codes.op11_vector_codes,
        "op12_periodic_runs": runs.op12_periodic_runs,
        "op13_exact_search": exact_search.op13_exact_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard": sql.OP1_SQL,
        "op2_suffix_dedup": sql.OP2_SQL,
        "op3_decontamination": sql.OP3_SQL,
        "op10_chat_formatting": chat.OP10_SQL,
        "op11_vector_codes": vector_codes.OP11_SQL,
        "op12_periodic_runs": runs.OP12_SQL,
        "op13_exact_search": exact_search.OP13_SQL,
    }
