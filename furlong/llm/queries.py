"""The registered queries of this package and their SQL, by name."""

from __future__ import annotations

from furlong.llm import bpe, chat, decontaminate, html, lines, near, quality, shard, substring, toxicity

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_main_text": html.op2_main_text,
    "op3_near_duplicates": near.op3_near_duplicates,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_substrings": substring.op5_substrings,
    "op6_shards": shard.op6_shards,
    "op7_chat": chat.op7_chat,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_quality": quality.op9_quality,
    "op10_lines": lines.op10_lines,
}
SQL: dict[str, str] = {
    "op3_near_duplicates": near.OP3_SQL,
    "op4_decontamination": decontaminate.OP4_SQL,
    "op5_substrings": substring.OP5_SQL,
    "op6_shards": shard.OP6_SQL,
    "op7_chat": chat.OP7_SQL,
    "op10_lines": lines.OP10_SQL,
}
