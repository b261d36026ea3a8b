"""Queries of the operators for training data, and their SQL where SQL can express them."""

from __future__ import annotations

from matchloom.llm import canon, entity, leak, level, mix, unify


def queries() -> dict:
    return {
        "p1_found": entity.matched_rows,
        "p1_matches": entity.matches,
        "p2_found": unify.odd_values,
        "p2_unified": unify.unified_values,
        "p2_equal_looking": unify.equal_looking,
        "p4_found": canon.named_entries,
        "p4_unmatched": canon.unmatched_values,
        "p6_found": leak.leaking_documents,
        "p6_items": leak.leaked_items,
        "p7_mixture": mix.mixed_documents,
        "p7_shares": mix.mixed_shares,
        "p8_found": level.document_levels,
        "p8_profile": level.level_profile,
    }


def oracle_sql() -> dict[str, str]:
    return {}
