"""The thirteen operators' queries, with SQL where SQL can say the same."""

from __future__ import annotations

from . import chat_format, embedding_dedup, exact_dedup, importance, language_id, mixing, packing, pii, prefix_trie, simhash_dedup, token_files, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_embedding_dedup": embedding_dedup.op1_embedding_dedup,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_pii": pii.op3_pii,
        "op4_mixing": mixing.op4_mixing,
        "op5_chat_format": chat_format.op5_chat_format,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_simhash_dedup": simhash_dedup.op7_simhash_dedup,
        "op8_language_id": language_id.op8_language_id,
        "op9_url_filter": url_filter.op9_url_filter,
        "op10_packing": packing.op10_packing,
        "op11_token_files": token_files.op11_token_files,
        "op12_importance": importance.op12_importance,
        "op13_prefix_trie": prefix_trie.op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": exact_dedup.ORACLE,
        "op4_mixing": mixing.ORACLE,
        "op5_chat_format": chat_format.ORACLE,
        "op9_url_filter": url_filter.ORACLE,
        "op12_importance": importance.ORACLE,
        "op13_prefix_trie": prefix_trie.ORACLE,
    }
