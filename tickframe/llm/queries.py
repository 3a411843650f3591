"""The operators' queries and their SQL."""

from . import chat, divergence, html, jaccard, katz, langid, media, mixing, packing, periodic, quality, sharding, simhash

QUERIES = {
    "op1_html_extract": html.query,
    "op2_chat_format": chat.query,
    "op3_lm_score": katz.query,
    "op4_media_png": media.query,
    "op5_quality_rules": quality.query,
    "op6_best_fit_pack": packing.query,
    "op7_mix_sources": mixing.query,
    "op8_simhash_dedup": simhash.query,
    "op9_shard": sharding.query,
    "op10_language_id": langid.query,
    "op11_source_divergence": divergence.query,
    "op12_periodic_runs": periodic.query,
    "op13_ngram_jaccard": jaccard.query,
}
#: Where SQL can express the operator on whole tables.
ORACLE = {
    "op5_quality_rules": quality.SQL,
    "op7_mix_sources": mixing.SQL,
    "op11_source_divergence": divergence.SQL,
    "op13_ngram_jaccard": jaccard.SQL,
}
