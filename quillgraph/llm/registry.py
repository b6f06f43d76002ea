"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import decontaminate, entropy_mix, imatch, line_dedup, maxent_lm, pii, runs, simhash, spellings, suffix_dedup, token_counts, toxicity, url_filter

QUERIES = {
    "op1_pii_surrogates": pii.op1_pii_surrogates,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_imatch": imatch.op3_imatch,
    "op4_entropy_mix": entropy_mix.op4_entropy_mix,
    "op5_simhash_near_dedup": simhash.op5_simhash_near_dedup,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_toxicity_deobfuscation": toxicity.op10_toxicity_deobfuscation,
    "op11_maxent_lm": maxent_lm.op11_maxent_lm,
    "op12_periodic_runs": runs.op12_periodic_runs,
    "op13_spelling_variants": spellings.op13_spelling_variants,
}
ORACLES = {"op2_decontaminate": decontaminate.OP2_SQL, "op8_line_dedup": line_dedup.OP8_SQL, "op9_url_filter": url_filter.OP9_SQL}
