"""The registered queries of the corpus operators, and their SQL where SQL can say them."""

from __future__ import annotations

from tidewheel.llm import alignment, decontaminate, jaccard, katz, line_dedup, media, mixing, quality, secrets, tokens, url_filters, vector_codes, vector_pairs

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_media_features": media.op2_media_features,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_token_counts": tokens.op4_token_counts,
    "op5_url_filters": url_filters.op5_url_filters,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_katz_scores": katz.op7_katz_scores,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_quality_resample": quality.op9_quality_resample,
    "op10_jaccard_components": jaccard.op10_jaccard_components,
    "op11_token_alignment": alignment.op11_token_alignment,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_near_vectors": vector_pairs.op13_near_vectors,
}
ORACLES = {
    "op1_secret_scan": secrets.ORACLE,
    "op3_decontaminate": decontaminate.ORACLE,
    "op5_url_filters": url_filters.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
    "op8_mix_sources": mixing.ORACLE,
    "op10_jaccard_components": jaccard.ORACLE,
    "op12_vector_codes": vector_codes.ORACLE,
    "op13_near_vectors": vector_pairs.ORACLE,
}
