"""The queries of the llm subpackage by name, and their SQL."""

from __future__ import annotations

from tessera.llm import consensus, encode, leaks, pairs, sentences, spans, splits, truncation


def queries() -> dict:
    return {
        "p3_found": splits.p3_found,
        "p3_splits": splits.p3_splits,
        "p3_shares": splits.p3_shares,
        "p3_audit": splits.p3_audit,
        "p4_found": consensus.p4_found,
        "p4_raters": consensus.p4_raters,
        "p4_consensus": consensus.p4_consensus,
        "p4_agreement": consensus.p4_agreement,
        "p5_found": pairs.p5_found,
        "p5_rates": pairs.p5_rates,
        "p6_found": truncation.p6_found,
        "p6_rates": truncation.p6_rates,
        "p7_found": sentences.p7_found,
        "p8_ids": encode.p8_ids,
        "p9_found": leaks.p9_found,
        "p9_items": leaks.p9_items,
        "p10_found": spans.p10_found,
        "p10_shared": spans.p10_shared,
        "p10_passages": spans.p10_passages,
    }


def oracle_sql() -> dict[str, str]:
    return consensus.SQL | spans.SQL | splits.SQL
