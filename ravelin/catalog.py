"""All queries of the engine and the SQL each is checked against."""

from __future__ import annotations

from .queries import contexts, pages, retrieval, tables, texts

MODULES = (retrieval, texts, tables, contexts, pages)
QUERIES = {name: f for m in MODULES for name, f in m.register.queries.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.register.oracles.items()}
