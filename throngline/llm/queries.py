"""Queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from . import centroids, decontam, divergence, html, langid, licenses, neardup, passages, pieces, pii, quality, toxicity, vectordup

QUERIES = {
    "op1_decontamination": decontam.op1,
    "op2_sentencepiece": pieces.op2,
    "op3_quality_rules": quality.op3,
    "op4_language_id": langid.op4,
    "op5_html_extraction": html.op5,
    "op6_repeated_passages": passages.op6,
    "op7_license_scan": licenses.op7,
    "op8_toxicity": toxicity.op8,
    "op9_near_duplicates": neardup.op9,
    "op10_personal_data": pii.op10,
    "op11_centroid_clusters": centroids.op11,
    "op12_embedding_near_duplicates": vectordup.op12,
    "op13_source_divergence": divergence.op13,
}
ORACLES = {
    "op1_decontamination": decontam.OP1_SQL,
    "op9_near_duplicates": neardup.OP9_SQL,
    "op11_centroid_clusters": centroids.OP11_SQL,
    "op12_embedding_near_duplicates": vectordup.OP12_SQL,
    "op13_source_divergence": divergence.OP13_SQL,
}
