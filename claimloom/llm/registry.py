"""Queries of this subpackage, and the SQL of those that SQL can express."""

from claimloom.llm import bpe, chat, collocations, exact_dedup, fingerprints, jaccard_join, mixing, quality, ranked_search, rules, substring_dedup, token_scan, toxicity

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_mixing": mixing.op2_mixing,
    "op3_jaccard_join": jaccard_join.op3_jaccard_join,
    "op4_bpe": bpe.op4_bpe,
    "op5_quality": quality.op5_quality,
    "op6_chat": chat.op6_chat,
    "op7_rules": rules.op7_rules,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_token_counts": token_scan.op10_token_counts,
    "op11_fingerprints": fingerprints.op11_fingerprints,
    "op12_collocations": collocations.op12_collocations,
    "op13_ranked_search": ranked_search.op13_ranked_search,
}
SQL = {"op1_substring_dedup": substring_dedup.SQL, "op3_jaccard_join": jaccard_join.SQL, "op2_mixing": mixing.SQL, "op6_chat": chat.SQL, "op9_exact_dedup": exact_dedup.SQL, "op12_collocations": collocations.SQL, "op13_ranked_search": ranked_search.SQL}
