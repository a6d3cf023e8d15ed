"""Queries of the general data-quality operators with their SQL."""

from __future__ import annotations

from sparkloom.operators import orphans, redelivery


def _clean(x: str) -> str:
    return f"lower(trim({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)))"


def _identity(ledger: str) -> str:
    return f"{_clean('run_id')}, {_clean('branch_id')}, coalesce(attempt, 0), ledger_offset" + (", sample_id" if ledger == "learning" else "")


def _surplus(ledger: str) -> str:
    return f"""SELECT '{ledger}' AS ledger, delivery_id FROM (
        SELECT delivery_id, row_number() OVER (PARTITION BY {_identity(ledger)} ORDER BY delivery_id) AS nth
        FROM {ledger} WHERE ledger_offset IS NOT NULL) WHERE nth > 1"""


def _kept(ledger: str, columns: str) -> str:
    return f"""SELECT {columns} FROM {ledger} WHERE delivery_id NOT IN (SELECT delivery_id FROM ({_surplus(ledger)}))"""


def _references(at: str = "r.logged_at") -> str:
    return " UNION ALL ".join(f"SELECT '{r.ledger}' AS ledger, delivery_id, '{r.field}' AS ref_field, '{r.target}' AS target, nullif({_clean(r.field)}, '') AS key, logged_at FROM {r.ledger}" for r in orphans.LEDGER_REFERENCES)


def _standing() -> str:
    """References of rows that are not deleted; of the ledgers only opus_audit has deletions."""
    return " UNION ALL ".join(f"SELECT '{r.target}' AS target, nullif({_clean(r.field)}, '') AS key FROM {r.ledger}" + (" WHERE deleted_at IS NULL" if r.ledger == "opus_audit" else "") for r in orphans.LEDGER_REFERENCES)


_TARGETS = f"SELECT 'opus_audit' AS target, {_clean('opus_decision_id')} AS key, logged_at, deleted_at FROM opus_audit UNION ALL SELECT 'candidates', {_clean('candidate_id')}, logged_at, deleted_at FROM candidates"
_ORPHANS = f"""WITH r AS ({_references()}), t AS ({_TARGETS}), o AS (
    SELECT r.* FROM r WHERE key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t WHERE t.target = r.target AND t.key = r.key
        AND t.logged_at <= r.logged_at AND (t.deleted_at IS NULL OR t.deleted_at > r.logged_at)))"""

_CONSUMPTION = ("delivery_id", "delivery_batch", "run_id", "branch_id", "attempt", "ledger_offset", "microbatch_id", "loss_mask_hash", "batch_content_hash")
_LEARNING = ("delivery_id", "delivery_batch", "run_id", "branch_id", "attempt", "ledger_offset", "sample_id", "loss_bearing_tokens", "mean_loss")


def queries() -> dict:
    return {
        "p4_found": orphans.found,
        "p4_report": orphans.report,
        "p4_current_orphans": orphans.current,
        "p6_found": redelivery.found,
        "p6_consumption": lambda s, d: redelivery.deduplicated(s, d, "consumption").select(*_CONSUMPTION),
        "p6_learning": lambda s, d: redelivery.deduplicated(s, d, "learning").select(*_LEARNING),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": f"{_ORPHANS} SELECT ledger, delivery_id, ref_field FROM o",
        "p4_report": f"{_ORPHANS} SELECT ledger, ref_field, strftime(logged_at, '%Y-%m') AS period, count(*) AS orphan_rows, count(DISTINCT key) AS orphan_keys FROM o GROUP BY ALL",
        "p4_current_orphans": f"""WITH r AS ({_standing()}), t AS ({_TARGETS})
            SELECT target, key, count(*) AS refs FROM r WHERE key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t
            WHERE t.target = r.target AND t.key = r.key AND t.logged_at IS NOT NULL AND t.deleted_at IS NULL) GROUP BY ALL""",
        "p6_found": f"{_surplus('consumption')} UNION ALL {_surplus('learning')}",
        "p6_consumption": _kept("consumption", ", ".join(_CONSUMPTION)),
        "p6_learning": _kept("learning", ", ".join(_LEARNING)),
    }
