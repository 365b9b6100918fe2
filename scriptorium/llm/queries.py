"""Queries over the corpus operators and their SQL."""

from __future__ import annotations

from scriptorium.llm import common, fingerprint, html_extract, langid, licenses, merkle, mixing, neardup, negatives, pieces, quality, secrets, topk, urlfilter

QUERIES = {
    "op1_secret_scan": lambda s, d: secrets.report(common.table(s, d, "documents")),
    "op2_sentencepiece": lambda s, d: pieces.report(common.table(s, d, "documents")),
    "op3_fingerprint": lambda s, d: fingerprint.against_next(common.table(s, d, "documents")),
    "op4_quality_rules": lambda s, d: quality.report(common.table(s, d, "documents")),
    "op5_source_mix": lambda s, d: mixing.report(common.table(s, d, "documents")),
    "op6_html_extract": lambda s, d: html_extract.report(common.table(s, d, "pages")),
    "op7_minhash_neardup": lambda s, d: neardup.report(common.table(s, d, "documents")),
    "op8_url_filter": lambda s, d: urlfilter.report(common.table(s, d, "pages")),
    "op9_language_id": lambda s, d: langid.report(common.table(s, d, "documents")),
    "op9_language_id_pages": lambda s, d: langid.pages_by_documents(common.table(s, d, "pages"), common.table(s, d, "documents")),
    "op10_license_scan": lambda s, d: licenses.report(common.table(s, d, "documents")),
    "op11_merkle_manifest": lambda s, d: merkle.report(common.table(s, d, "documents")),
    "op12_hard_negatives": lambda s, d: negatives.report(common.table(s, d, "embeddings")),
    "op13_exact_topk": lambda s, d: topk.report(common.table(s, d, "embeddings")),
}

ORACLE = {
    "op4_quality_rules": quality.oracle(),
    "op8_url_filter": urlfilter.oracle(),
    "op11_merkle_manifest": merkle.oracle(),
    "op12_hard_negatives": negatives.oracle(),
    "op13_exact_topk": topk.oracle(),
}
