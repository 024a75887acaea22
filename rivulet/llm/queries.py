"""The registered queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from rivulet.llm import (
    chat_format,
    decontaminate,
    fingerprint,
    html_extract,
    language_id,
    mixing,
    near_duplicates,
    secrets,
    substring_dedup,
    toxicity,
)

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_fingerprint": fingerprint.op3_fingerprint,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_language_id": language_id.op5_language_id,
    "op6_html_extract": html_extract.op6_html_extract,
    "op7_chat_format": chat_format.op7_chat_format,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_near_duplicates": near_duplicates.op9_near_duplicates,
    "op10_secret_scan": secrets.op10_secret_scan,
}

SQL = {
    "op1_mix_sources": mixing.OP1_SQL,
    "op7_chat_format": chat_format.OP7_SQL,
    "op8_substring_dedup": substring_dedup.OP8_SQL,
    "op10_secret_scan": secrets.OP10_SQL,
}
