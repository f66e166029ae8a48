"""The queries of this folder, by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import anagram_variants, best_fit_packing, digest_index, html_template, langid_crf, licences, periodic_runs, pii_semicrf, sentencepiece_bpe, simhash_vptree, token_scan, toxicity, wu_manber


def queries() -> dict:
    return {
        "op1_token_counts": token_scan.query,
        "op2_simhash_neardup": simhash_vptree.query,
        "op3_licences": licences.query,
        "op4_exact_dedup": digest_index.query,
        "op5_toxicity": toxicity.query,
        "op6_sentencepiece": sentencepiece_bpe.query,
        "op7_personal_data": pii_semicrf.query,
        "op8_language_id": langid_crf.query,
        "op9_decontamination": wu_manber.query,
        "op10_html_extraction": html_template.query,
        "op11_periodic_runs": periodic_runs.query,
        "op12_packing": best_fit_packing.query,
        "op13_spelling_variants": anagram_variants.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": digest_index.SQL, "op9_decontamination": wu_manber.SQL, "op13_spelling_variants": anagram_variants.SQL}
