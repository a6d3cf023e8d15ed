"""Queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from sparkloom.llm import budget, containers, encoder, leakage, mixing, mojibake, splitting
from sparkloom.storage import table


def queries() -> dict:
    documents = lambda s, d: table(s, d, "documents")
    return {
        "p1_windows": containers.agentic_windows,
        "p1_utilization": containers.utilization,
        "p2_found": leakage.found,
        "p2_spans": leakage.spans,
        "p3_found": splitting.found,
        "p3_pieces": splitting.agentic_pieces,
        "p5_tokens": lambda s, d: budget.per_document(documents(s, d)),
        "p5_totals": lambda s, d: budget.totals(budget.per_document(documents(s, d))),
        "p7_ids": lambda s, d: encoder.encode_texts(documents(s, d)),
        "p8_draw": mixing.draw,
        "p8_shares": mixing.shares,
        "p8_shares_of_supply": lambda s, d: mixing.shares(s, d, "supply"),
        "p9_found": mojibake.found,
        "p9_restored": lambda s, d: mojibake.damaged(documents(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": """SELECT DISTINCT document_id FROM agentic JOIN (SELECT run_id, max(seq_len) AS seq_len FROM packing_utilization
            WHERE seq_len > 0 GROUP BY run_id) USING (run_id) WHERE len(token_ids) > seq_len""",
    }
