"""All queries of the core and their SQL."""

from __future__ import annotations

from skein.plans import diagnostics, evidence, ledger, p2_hierarchy, p3_nested, p6_drift, p7_stamps, records, retrieval, streams

MODULES = [p2_hierarchy, p3_nested, p6_drift, p7_stamps, retrieval, ledger, records, streams, evidence, diagnostics]


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in MODULES for name, s in m.SQL.items()}
