"""The driver's queries of this package, and the SQL of those that DuckDB can express."""

from __future__ import annotations

from . import bpe, exact_dedup, fingerprints, html_text, language, packing, personal_data, quality, repeats, resampling, simhash, token_counts, vector_codes

QUERIES = {
    "op1_fingerprints": fingerprints.op1,
    "op2_packing": packing.op2,
    "op3_exact_dedup": exact_dedup.op3,
    "op4_token_counts": token_counts.op4,
    "op5_bpe": bpe.op5,
    "op6_simhash": simhash.op6,
    "op7_personal_data": personal_data.op7,
    "op8_language": language.op8,
    "op9_repeats": repeats.op9,
    "op10_quality": quality.op10,
    "op11_vector_codes": vector_codes.op11,
    "op12_resampling": resampling.op12,
    "op13_html_text": html_text.op13,
}

ORACLES: dict[str, str] = {
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op11_vector_codes": vector_codes.ORACLE,
    "op12_resampling": resampling.ORACLE,
}
