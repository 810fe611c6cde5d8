"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tideline.llm import chat, codes, extraction, graph, langid, mixing, near, packing, pii, quality, secrets, warc, whitening

QUERIES = {
    "op1_secret_scan": secrets.op1,
    "op2_warc": warc.op2,
    "op3_personal_data": pii.op3,
    "op4_nearest_neighbours": graph.op4,
    "op5_language_mixture": langid.op5,
    "op6_best_fit_packing": packing.op6,
    "op7_chat_format": chat.op7,
    "op8_quality_rules": quality.op8,
    "op9_ngram_jaccard_join": near.op9,
    "op10_fair_mix": mixing.op10,
    "op11_embedding_whitening": whitening.op11,
    "op12_html_text": extraction.op12,
    "op13_vector_codes": codes.op13,
}

ORACLE = {
    "op2_warc": warc.ORACLE,
    "op7_chat_format": chat.ORACLE,
    "op9_ngram_jaccard_join": near.ORACLE,
    "op10_fair_mix": mixing.ORACLE,
    "op12_html_text": extraction.ORACLE,
    "op13_vector_codes": codes.ORACLE,
}
