"""All queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from leafwork.llm import queries, twins

NAMES = (
    "op1_secret_scan", "op2_exact_dedup", "op3_decontamination", "op4_chat_format", "op5_language_id",
    "op6_quality", "op7_packing", "op8_minhash", "op9_token_ids", "op10_pii",
    "op11_collocations", "op12_html_text", "op13_centroids",
)
LLM = {name: (getattr(queries, name), twins.SQL.get(name)) for name in NAMES}
