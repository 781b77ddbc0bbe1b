"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import chunk_dedup, decontamination, exact_dedup, importance, language_id, mixing, near_dedup, packing, periodic, suffix_dedup, token_count, toxicity, url_filter

QUERIES = {
    f.__name__: f
    for f in (
        suffix_dedup.op1_suffix_dedup,
        url_filter.op2_url_filter,
        packing.op3_packing,
        language_id.op4_language_id,
        token_count.op5_token_count,
        toxicity.op6_toxicity,
        exact_dedup.op7_exact_dedup,
        near_dedup.op8_near_dedup,
        decontamination.op9_decontamination,
        chunk_dedup.op10_chunk_dedup,
        periodic.op11_periodic_runs,
        mixing.op12_mixing,
        importance.op13_importance,
    )
}

ORACLES = {"op7_exact_dedup": exact_dedup.SQL, "op12_mixing": mixing.SQL}
