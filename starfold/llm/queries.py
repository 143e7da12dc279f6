"""The queries of this subpackage and their SQL, for the registry at the repository top."""

from __future__ import annotations

from starfold.llm import jaccard, langid, linededup, matroska, mixing, packing, permutation, secrets, sharding, toxicity

QUERIES = {
    "op1_secrets": secrets.query,
    "op2_matroska": matroska.query,
    "op3_toxicity": toxicity.query,
    "op4_jaccard_join": jaccard.query,
    "op5_line_dedup": linededup.query,
    "op6_mix_sources": mixing.query,
    "op7_shard_slots": sharding.query,
    "op8_language": langid.query,
    "op9_pack_best_fit": packing.query,
    "op10_permutation_index": permutation.query,
}

ORACLE = {"op4_jaccard_join": jaccard.ORACLE, "op5_line_dedup": linededup.ORACLE, "op6_mix_sources": mixing.ORACLE, "op10_permutation_index": permutation.ORACLE}
