"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from codeweft.llm import chat, decontam, langid, licenses, manifest, neardup, packing, periods, pii, quality, substrings, tokens, urls

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_decontamination": decontam.op2_decontamination,
    "op3_substring_dedup": substrings.op3_substring_dedup,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_token_count": tokens.op5_token_count,
    "op6_chat_format": chat.op6_chat_format,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_minhash_neardup": neardup.op8_minhash_neardup,
    "op9_license_scan": licenses.op9_license_scan,
    "op10_url_filter": urls.op10_url_filter,
    "op11_periodic_runs": periods.op11_periodic_runs,
    "op12_language_id": langid.op12_language_id,
    "op13_merkle_manifest": manifest.op13_merkle_manifest,
}

ORACLES = {
    "op3_substring_dedup": substrings.OP3_SQL,
    "op10_url_filter": urls.OP10_SQL,
    "op2_decontamination": decontam.OP2_SQL,
    "op6_chat_format": chat.OP6_SQL,
    "op8_minhash_neardup": neardup.OP8_SQL,
    "op9_license_scan": licenses.OP9_SQL,
    "op13_merkle_manifest": manifest.OP13_SQL,
}
