"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import ann, decontaminate, fingerprints, licenses, near_dup, packing, quality, resampling, secrets, suffix_dedup, toxicity, url_filters, whitening

QUERIES = {
    f.__name__: f
    for f in (
        secrets.op1_secret_scans,
        packing.op2_best_fit_packing,
        licenses.op3_license_scans,
        toxicity.op4_toxicity,
        url_filters.op5_url_filters,
        ann.op6_nearest_neighbours,
        decontaminate.op7_benchmark_decontamination,
        near_dup.op8_minhash_near_dedup,
        quality.op9_quality_classifier,
        suffix_dedup.op10_suffix_array_dedup,
        whitening.op11_embedding_whitening,
        fingerprints.op12_document_fingerprints,
        resampling.op13_importance_resampling,
    )
}

ORACLE_SQL = {"op5_url_filters": url_filters.ORACLE, "op13_importance_resampling": resampling.ORACLE}
