"""The operators' queries over whole tables, and their SQL where SQL can express them."""

from quire.llm import alignment, embeddings, fingerprints, jaccard, language, mixing, packing, pii, quality, secrets, suffixes, toxicity, variants

QUERIES = {
    "op1_secret_scan": secrets.op1,
    "op2_embedding_near_dedup": embeddings.op2,
    "op3_spot_fingerprints": fingerprints.op3,
    "op4_language_id": language.op4,
    "op5_suffix_dedup": suffixes.op5,
    "op6_mix_sources": mixing.op6,
    "op7_personal_data": pii.op7,
    "op8_quality_classifier": quality.op8,
    "op9_ngram_jaccard": jaccard.op9,
    "op10_pack_sequences": packing.op10,
    "op11_toxicity": toxicity.op11,
    "op12_spelling_variants": variants.op12,
    "op13_token_alignment": alignment.op13,
}

ORACLES = {"op6_mix_sources": mixing.SQL}
