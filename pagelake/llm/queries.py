"""Registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from importlib import import_module

from .common import importable

MODULES = {
    "op1_license_scan": "licenses",
    "op2_quality_rules": "quality",
    "op3_near_duplicates": "neardup",
    "op4_sharding": "sharding",
    "op5_quality_classifier": "classifier",
    "op6_substring_dedup": "substring",
    "op7_url_filter": "urlfilter",
    "op8_mixing": "mixing",
    "op9_decontamination": "decontam",
    "op10_warc": "warc",
    "op11_token_alignment": "alignment",
    "op12_secret_scan": "secrets",
    "op13_ranked_search": "ranking",
}


def _query(module: str):
    def run(spark, sf_dir):
        importable(spark)
        return import_module(f"pagelake.llm.{module}").query(spark, sf_dir)
    return run


QUERIES = {name: _query(module) for name, module in MODULES.items()}
_SQL = ("neardup", "substring", "urlfilter", "warc", "secrets", "ranking")
ORACLES = {name: import_module(f"pagelake.llm.{m}").ORACLE for name, m in MODULES.items() if m in _SQL}
