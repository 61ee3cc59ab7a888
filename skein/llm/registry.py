"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from skein.llm import p10_levels, p1_pieces, p4_split, p5_conversations, p8_sequences, p9_leaks

MODULES = [p1_pieces, p4_split, p5_conversations, p8_sequences, p9_leaks, p10_levels]


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in MODULES for name, s in m.SQL.items()}
