"""Queries of this package by name, and the SQL that gives the same rows where SQL can."""

from lodestrata.llm import archive, centroids, filter_audit, fingerprint, language, license_scan, neardup, neighbours, packing, pieces, quality, scoring, suffix_dedup

QUERIES = {
    "op1_sentencepiece": pieces.op1_sentencepiece,
    "op2_warc": archive.op2_warc,
    "op3_scoring": scoring.op3_scoring,
    "op4_packing": packing.op4_packing,
    "op5_suffix": suffix_dedup.op5_suffix,
    "op6_license": license_scan.op6_license,
    "op7_fingerprint": fingerprint.op7_fingerprint,
    "op8_quality": quality.op8_quality,
    "op9_language": language.op9_language,
    "op10_neardup": neardup.op10_neardup,
    "op11_neighbours": neighbours.op11_neighbours,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_centroids": centroids.op13_centroids,
}
SQL = {"op2_warc": archive.SQL, "op6_license": license_scan.SQL, "op8_quality": quality.SQL, "op11_neighbours": neighbours.SQL, "op12_filter_audit": filter_audit.SQL, "op13_centroids": centroids.SQL}
