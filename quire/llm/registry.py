"""Queries and SQL of every operator of this subpackage."""

from quire.llm import decontamination, jaccard_join, language_id, license_scan, mixing, quality_rules, secret_scan, sharding, substring_dedup, web_archive

MODULES = (license_scan, web_archive, decontamination, mixing, sharding, substring_dedup, quality_rules, jaccard_join, secret_scan, language_id)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: sql for m in MODULES for k, sql in getattr(m, "SQL", {}).items()}
