"""The queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

from veldt.llm import bpe_codec, conversation_repair, embedding_links, hard_negatives, html_text, language_id, line_dedup, packing, repeat_spans, secret_scan, simhash_links, stream_dedup, toxicity


def queries() -> dict:
    return {
        "op1_embedding_links": embedding_links.query,
        "op2_language_id": language_id.query,
        "op3_html_text": html_text.query,
        "op4_stream_dedup": stream_dedup.query,
        "op5_line_dedup": line_dedup.query,
        "op6_packing": packing.query,
        "op7_simhash_links": simhash_links.query,
        "op8_secret_scan": secret_scan.query,
        "op9_bpe_codec": bpe_codec.query,
        "op10_repeat_spans": repeat_spans.query,
        "op11_conversation_repair": conversation_repair.query,
        "op12_hard_negatives": hard_negatives.query,
        "op13_toxicity": toxicity.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_links": embedding_links.ORACLE, "op4_stream_dedup": stream_dedup.ORACLE, "op5_line_dedup": line_dedup.ORACLE, "op12_hard_negatives": hard_negatives.ORACLE}
