"""Queries of the operators in this folder, with the SQL of those that SQL can express."""

from __future__ import annotations

from weftline.llm import attention_lm, centroids, chat_format, decontaminate, jaccard_join, kneser_ney, language_id, line_dedup, mixing, search, secrets, token_alignment, url_filter


def queries() -> dict:
    return {
        "op1_scan_secrets": secrets.op1_scan_secrets,
        "op2_dedup_lines": line_dedup.op2_dedup_lines,
        "op3_search_bm25": search.op3_search_bm25,
        "op4_find_benchmark_leaks": decontaminate.op4_find_benchmark_leaks,
        "op5_identify_language": language_id.op5_identify_language,
        "op6_format_chat": chat_format.op6_format_chat,
        "op7_mix_sources": mixing.op7_mix_sources,
        "op8_join_near_duplicates": jaccard_join.op8_join_near_duplicates,
        "op9_score_language_model": attention_lm.op9_score_language_model,
        "op10_classify_quality": kneser_ney.op10_classify_quality,
        "op11_filter_urls": url_filter.op11_filter_urls,
        "op12_cluster_centroids": centroids.op12_cluster_centroids,
        "op13_align_tokenizers": token_alignment.op13_align_tokenizers,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_dedup_lines": line_dedup.ORACLE_SQL,
        "op3_search_bm25": search.ORACLE_SQL,
        "op4_find_benchmark_leaks": decontaminate.ORACLE_SQL,
        "op6_format_chat": chat_format.ORACLE_SQL,
        "op7_mix_sources": mixing.ORACLE_SQL,
        "op8_join_near_duplicates": jaccard_join.ORACLE_SQL,
        "op11_filter_urls": url_filter.ORACLE_SQL,
        "op12_cluster_centroids": centroids.ORACLE_SQL,
    }
