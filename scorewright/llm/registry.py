"""Queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from . import best_fit_packing, decontamination, iblt, pii, quality, resharding, simhash_dedup, tool_calls, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_tool_calls": tool_calls.query,
        "op2_pii": pii.query,
        "op3_decontamination": decontamination.query,
        "op4_iblt": iblt.query,
        "op5_quality": quality.query,
        "op6_simhash_dedup": simhash_dedup.query,
        "op7_url_filter": url_filter.query,
        "op8_best_fit_packing": best_fit_packing.query,
        "op9_toxicity": toxicity.query,
        "op10_resharding": resharding.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_tool_calls": tool_calls.SQL, "op3_decontamination": decontamination.SQL, "op7_url_filter": url_filter.SQL}
