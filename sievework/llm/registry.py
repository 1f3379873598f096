"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import centroids, decontaminate, filter_audit, fuzzy_lines, jaccard, mixing, oracles, pii, quality, sharding, substrings, tokenfiles, topk, toxicity

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_mixing": mixing.op3_mixing,
    "op4_substring_dedup": substrings.op4_substring_dedup,
    "op5_jaccard_join": jaccard.op5_jaccard_join,
    "op6_fuzzy_lines": fuzzy_lines.op6_fuzzy_lines,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_pii": pii.op8_pii,
    "op9_token_files": tokenfiles.op9_token_files,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_exact_topk": topk.op12_exact_topk,
    "op13_centroids": centroids.op13_centroids,
}

#: The others permute, fit, tokenize or search with positions, which SQL can't: tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op4_substring_dedup": oracles.SUBSTRINGS,
    "op5_jaccard_join": oracles.JACCARD,
    "op7_decontamination": oracles.CONTAMINATION,
    "op11_filter_audit": oracles.AUDIT,
    "op12_exact_topk": oracles.TOP_K,
    "op13_centroids": oracles.CENTROIDS,
}
