"""The queries of this subpackage and their SQL; `__spark_entry__` adds them."""

from __future__ import annotations

from . import ann, chat, licenses, line_dedup, lm_scoring, media, mixing, packing, quality, simhash, token_counts, trie, whitening


def queries() -> dict:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_lm_scoring": lm_scoring.op2_lm_scoring,
        "op3_license_scan": licenses.op3_license_scan,
        "op4_mix_sources": mixing.op4_mix_sources,
        "op5_token_counts": token_counts.op5_token_counts,
        "op6_packing": packing.op6_packing,
        "op7_ann_search": ann.op7_ann_search,
        "op8_simhash_dedup": simhash.op8_simhash_dedup,
        "op9_media_columns": media.op9_media_columns,
        "op10_quality_classifier": quality.op10_quality_classifier,
        "op11_chat_formatting": chat.op11_chat_formatting,
        "op12_embedding_whitening": whitening.op12_embedding_whitening,
        "op13_conversation_trie": trie.op13_conversation_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.OP1_SQL,
        "op3_license_scan": licenses.OP3_SQL,
        "op4_mix_sources": mixing.OP4_SQL,
        "op11_chat_formatting": chat.OP11_SQL,
        "op13_conversation_trie": trie.OP13_SQL,
    }
