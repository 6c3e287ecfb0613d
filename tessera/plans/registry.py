"""All core queries by name, and their SQL."""

from __future__ import annotations

from tessera.plans import annotations, attribution, audit, contrast, decisions, essay_records, features, joined, models, ratings, raw_files, sampling

MODULES = (essay_records, raw_files, ratings, attribution, contrast, features, decisions, sampling, annotations, audit, models, joined)


def queries() -> dict:
    out: dict = {}
    for m in MODULES:
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= m.SQL
    return out
