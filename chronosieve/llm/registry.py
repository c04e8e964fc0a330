"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from . import exact_dedup, manifest, minhash, mixing, nearest, negatives, ngram_join, sharding, substring_dedup, suffix_dedup, surrogates, tokenize, toxicity

QUERIES = {
    "op1_sentencepiece": tokenize.op1,
    "op2_nearest": nearest.op2,
    "op3_mixing": mixing.op3,
    "op4_toxicity": toxicity.op4,
    "op5_sharding": sharding.op5,
    "op6_ngram_join": ngram_join.op6,
    "op7_exact_dedup": exact_dedup.op7,
    "op8_suffix_dedup": suffix_dedup.op8,
    "op9_surrogates": surrogates.op9,
    "op10_substring_dedup": substring_dedup.op10,
    "op11_negatives": negatives.op11,
    "op12_minhash": minhash.op12,
    "op13_manifest": manifest.op13,
}
ORACLES = {
    "op2_nearest": nearest.ORACLE,
    "op6_ngram_join": ngram_join.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op8_suffix_dedup": suffix_dedup.ORACLE,
    "op10_substring_dedup": substring_dedup.ORACLE,
    "op11_negatives": negatives.ORACLE,
    "op12_minhash": minhash.ORACLE,
    "op13_manifest": manifest.ORACLE,
}
