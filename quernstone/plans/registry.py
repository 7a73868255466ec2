"""All registered queries outside the training-data operators."""

from __future__ import annotations

from quernstone.plans import analysis, archive, finding, retrieval, shown, upkeep

MODULES = (archive, retrieval, finding, upkeep, shown, analysis)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
