"""The queries of this subpackage, for the entry module."""

from __future__ import annotations

from credalis.llm import chat, decontaminate, exact_dedup, html_text, language, mixing, near_dedup, pii, toxicity, urls

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_chat": chat.op3_chat,
    "op4_mixing": mixing.op4_mixing,
    "op5_language": language.op5_language,
    "op6_html_text": html_text.op6_html_text,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_urls": urls.op8_urls,
    "op9_pii": pii.op9_pii,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}
ORACLES = {
    "op1_decontaminate": decontaminate.OP1_SQL,
    "op2_near_dedup": near_dedup.OP2_SQL,
    "op3_chat": chat.OP3_SQL,
    "op8_urls": urls.op8_sql(),
    "op10_exact_dedup": exact_dedup.OP10_SQL,
}
