"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from quern.llm import bpe, chat, fim, html, itq, licenses, manifest, mixing, ngram, quality, simhash, spans, topk

QUERIES = {
    "op2_license_scan": licenses.query,
    "op1_quality_rules": quality.query,
    "op3_sentence_spans": spans.query,
    "op4_itq": itq.query,
    "op5_chat_format": chat.query,
    "op6_simhash": simhash.query,
    "op7_bpe": bpe.query,
    "op8_ngram_lm": ngram.query,
    "op9_mixing": mixing.query,
    "op10_html_extract": html.query,
    "op11_merkle_manifest": manifest.query,
    "op12_exact_topk": topk.query,
    "op13_fill_in_middle": fim.query,
}

SQL: dict[str, str] = {
    "op5_chat_format": chat.SQL,
    "op11_merkle_manifest": manifest.SQL,
    "op12_exact_topk": topk.SQL,
    "op13_fill_in_middle": fim.SQL,
}
