"""Queries of the corpus operators, and the SQL of those that SQL expresses."""

from __future__ import annotations

from quadrille.llm import bm25, bpe, chat, linededup, mixing, secrets, simhash, suffixdedup, syncmers, toxicity


def queries() -> dict:
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_bpe": bpe.op2_bpe,
        "op3_line_dedup": linededup.op3_line_dedup,
        "op4_substring_dedup": suffixdedup.op4_substring_dedup,
        "op5_bm25": bm25.op5_bm25,
        "op6_mix_sources": mixing.op6_mix_sources,
        "op7_secret_scan": secrets.op7_secret_scan,
        "op8_chat_format": chat.op8_chat_format,
        "op9_syncmers": syncmers.op9_syncmers,
        "op10_toxicity": toxicity.op10_toxicity,
    }


def oracle_sql() -> dict:
    return {"op3_line_dedup": linededup.OP3_SQL, "op5_bm25": bm25.OP5_SQL, "op8_chat_format": chat.OP8_SQL}
