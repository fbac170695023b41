"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from . import p1_parse, p2_groups, p3_ranking, p4_distinctive, p5_handwritten, p6_encode, p7_leaks, p8_truncated


def queries() -> dict:
    return {
        "p1_found": p1_parse.p1_found,
        "p1_files": p1_parse.p1_files,
        "p1_rates": p1_parse.p1_rates,
        "p2_found": p2_groups.p2_found,
        "p3_ranking": p3_ranking.p3_ranking,
        "p3_agreement": p3_ranking.p3_agreement,
        "p4_found": p4_distinctive.p4_found,
        "p4_scores": p4_distinctive.p4_scores,
        "p5_found": p5_handwritten.p5_found,
        "p5_kinds": p5_handwritten.p5_kinds,
        "p5_statistics": p5_handwritten.p5_statistics,
        "p5_ways": p5_handwritten.p5_ways,
        "p5_thresholds": p5_handwritten.p5_thresholds,
        "p6_ids": p6_encode.p6_ids,
        "p6_unsplit": p6_encode.p6_unsplit,
        "p7_found": p7_leaks.p7_found,
        "p7_spans": p7_leaks.p7_spans,
        "p7_items": p7_leaks.p7_items,
        "p7_cleaned": p7_leaks.p7_cleaned,
        "p8_found": p8_truncated.p8_found,
        "p8_rates": p8_truncated.p8_rates,
    }


def oracle_sql() -> dict:
    return {
        "p2_found": p2_groups.P2_SQL,
        "p3_ranking": p3_ranking.P3_SQL,
        "p4_found": p4_distinctive.P4_FOUND_SQL,
        "p4_scores": p4_distinctive.P4_SCORES_SQL,
    }
