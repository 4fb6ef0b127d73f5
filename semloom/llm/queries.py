"""The queries of this folder, as the driver's entry registers them."""

from __future__ import annotations

import importlib

#: name -> module; the function of that name takes (spark, sf_dir), a string SQL in the module is its check.
_MODULES = {
    "op1_personal_data": "pii",
    "op2_sentencepiece": "sentencepiece",
    "op3_html_extraction": "html_text",
    "op4_secret_scan": "secrets",
    "op5_mix_sources": "mixing",
    "op6_top_k": "topk",
    "op7_ngram_join": "ngram_join",
    "op8_fingerprints": "fingerprints",
    "op9_license_scan": "licenses",
    "op10_toxicity": "toxicity",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"{__package__}.{module}"), "SQL", None) for name, module in _MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
