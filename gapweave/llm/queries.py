"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from gapweave.llm import ann, bpe, chat, codes, decontaminate, html, langid, neardup, negatives, pii, secrets, simhash, toxicity

QUERIES = {
    "op1_near_duplicates": neardup.op1_near_duplicates,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_pii": pii.op3_pii,
    "op4_html_text": html.op4_html_text,
    "op5_nearest": ann.op5_nearest,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_bpe": bpe.op7_bpe,
    "op8_language_id": langid.op8_language_id,
    "op9_secret_scan": secrets.op9_secret_scan,
    "op10_chat_format": chat.op10_chat_format,
    "op11_simhash": simhash.op11_simhash,
    "op12_product_codes": codes.op12_product_codes,
    "op13_hard_negatives": negatives.op13_hard_negatives,
}

ORACLE_SQL = {
    "op6_decontaminate": decontaminate.OP6_SQL,
    "op9_secret_scan": secrets.OP9_SQL,
    "op10_chat_format": chat.OP10_SQL,
    "op12_product_codes": codes.OP12_SQL,
    "op13_hard_negatives": negatives.OP13_SQL,
}
