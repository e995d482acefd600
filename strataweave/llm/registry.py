"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from strataweave.llm import decontaminate, fingerprint, html_text, linededup, packing, quality, secrets, simhash, toxicity, urls

QUERIES = {
    "op1_decontamination": decontaminate.query,
    "op2_best_fit_packing": packing.query,
    "op3_html_extraction": html_text.query,
    "op4_simhash_near_dedup": simhash.query,
    "op5_line_dedup": linededup.query,
    "op6_secret_scans": secrets.query,
    "op7_document_fingerprints": fingerprint.query,
    "op8_url_filters": urls.query,
    "op9_toxicity": toxicity.query,
    "op10_quality_classifier": quality.query,
}
ORACLE = {"op1_decontamination": decontaminate.ORACLE, "op8_url_filters": urls.ORACLE}
