"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline

from vellumine.llm import chat_format, decontaminate, fingerprint, html_extract, license_scan, ngram_join, packing, secret_scan, suffix_dedup, toxicity

_QUERIES = {
    "op1_ngram_jaccard_join": (ngram_join.op1_ngram_jaccard_join, ngram_join.ORACLE_SQL),
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
    "op2_chat_formatting": (chat_format.op2_chat_formatting, chat_format.ORACLE_SQL),
    "op3_decontamination": (decontaminate.op3_decontamination, decontaminate.ORACLE_SQL),
    "op4_html_extraction": (html_extract.op4_html_extraction, None),
    "op5_secret_scan": (secret_scan.op5_secret_scan, None),
    "op6_toxicity": (toxicity.op6_toxicity, None),
    "op7_packing": (packing.op7_packing, None),
    "op8_license_scan": (license_scan.op8_license_scan, None),
    "op9_suffix_dedup": (suffix_dedup.op9_suffix_dedup, suffix_dedup.ORACLE_SQL),
    "op10_document_fingerprints": (fingerprint.op10_document_fingerprints, fingerprint.ORACLE_SQL),
}


def queries() -> dict:
    return {k: f for k, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _QUERIES.items() if s}
