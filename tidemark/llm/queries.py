"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from tidemark.llm import bpe, exact_dedup, licences, minhash, neighbours, packing, quality, repeats, sharding, toxicity

QUERIES = {
    "op1_quality_additive_model": quality.op1_quality_additive_model,
    "op2_cross_polytope_neighbours": neighbours.op2_cross_polytope_neighbours,
    "op3_extendible_hash_shards": sharding.op3_extendible_hash_shards,
    "op4_byte_bpe": bpe.op4_byte_bpe,
    "op5_superminhash_near_dedup": minhash.op5_superminhash_near_dedup,
    "op6_counterfactual_toxicity": toxicity.op6_counterfactual_toxicity,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_sum_of_squares_packing": packing.op8_sum_of_squares_packing,
    "op9_merged_bwt_repeats": repeats.op9_merged_bwt_repeats,
    "op10_licence_scan": licences.op10_licence_scan,
}

ORACLES = {
    "op3_extendible_hash_shards": sharding.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
}
