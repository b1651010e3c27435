"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmesh.llm import language, licenses, manifest, middle, mixing, ngrams, packing, pieces, pii, quality, rules, urls, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_ngram_jaccard": ngrams.op2_ngram_jaccard,
    "op3_language_id": language.op3_language_id,
    "op4_url_filters": urls.op4_url_filters,
    "op5_sentencepiece": pieces.op5_sentencepiece,
    "op6_quality_rules": rules.op6_quality_rules,
    "op7_quality_classifier": quality.op7_quality_classifier,
    "op8_embedding_near_dedup": vectors.op8_embedding_near_dedup,
    "op9_license_scans": licenses.op9_license_scans,
    "op10_pii": pii.op10_pii,
    "op11_fill_in_middle": middle.op11_fill_in_middle,
    "op12_source_mix": mixing.op12_source_mix,
    "op13_merkle_manifest": manifest.op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op4_url_filters": urls.OP4_SQL,
    "op6_quality_rules": rules.OP6_SQL,
    "op11_fill_in_middle": middle.OP11_SQL,
    "op12_source_mix": mixing.OP12_SQL,
    "op13_merkle_manifest": manifest.OP13_SQL,
}
