"""The corpus operators' registered queries, and the SQL that some of them equal."""

from __future__ import annotations

from importlib import import_module

_HOMES = {
    "op3_html_extraction": "html_extraction",
    "op2_additive_quantisation": "additive_quantisation",
    "op5_ngram_join": "ngram_join",
    "op8_substring_dedup": "substring_dedup",
    "op7_quality_classifier": "quality_classifier",
    "op4_packing": "packing",
    "op10_byte_bpe": "bpe",
    "op1_warc": "warc",
    "op9_secret_scan": "secret_scan",
    "op6_quality_rules": "quality_rules",
    "op11_spelling_variants": "spelling",
    "op12_personal_data": "personal_data",
    "op13_whitening": "whitening",
}


def queries() -> dict:
    return {name: getattr(import_module(f"peakloom.llm.{home}"), name) for name, home in _HOMES.items()}


def oracle_sql() -> dict[str, str]:
    from peakloom.llm.oracles import ORACLES

    return dict(ORACLES)
