"""All registered queries of the library proper, and their SQL."""

from __future__ import annotations

from marginalia.operators import aggregate, dedup, documents, duplicates, evidence, retrieval, sets, spreadsheets, tags, textops, threads, timeline, trust
from marginalia.plans import analysis
from marginalia.sources import audit, files, models
from marginalia.streaming import ledger

FLAGSHIP = "overview"

_MODULES = (aggregate, trust, textops, dedup, duplicates, documents, threads, timeline, evidence, retrieval, sets, analysis, files, audit, models, spreadsheets, tags, ledger)


def queries() -> dict:
    return {name: pair[0] for m in _MODULES for name, pair in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: pair[1] for m in _MODULES for name, pair in m.QUERIES.items() if pair[1]}
