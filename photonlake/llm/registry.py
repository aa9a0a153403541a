"""The queries of the training-data operators, and SQL for those that SQL can express."""

from photonlake.llm import decontaminate, jaccard, langid, merkle, mixing, pii, quality, repeats, sharding, toxicity

QUERIES = {
    "op1_output_code_language": langid.op1,
    "op2_count_vector_jaccard": jaccard.op2,
    "op3_rendezvous_sharding": sharding.op3,
    "op4_decision_list_quality": quality.op4,
    "op5_bootstrapped_pii": pii.op5,
    "op6_spaced_seed_decontamination": decontaminate.op6,
    "op7_subword_toxicity": toxicity.op7,
    "op8_merkle_fixity": merkle.op8,
    "op9_fair_queue_mixing": mixing.op9,
    "op10_recompression_repeats": repeats.op10,
}

SQL = {
    "op2_count_vector_jaccard": jaccard.SQL,
    "op3_rendezvous_sharding": sharding.SQL,
    "op6_spaced_seed_decontamination": decontaminate.SQL,
    "op8_merkle_fixity": merkle.SQL,
    "op9_fair_queue_mixing": mixing.SQL,
    "op10_recompression_repeats": repeats.SQL,
}
