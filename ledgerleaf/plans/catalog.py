"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from ledgerleaf.plans import chunk_plans, corpus_plans, issue_plans, more_plans, pattern_plans, relate_plans, stream_plans

MODULES = [corpus_plans, issue_plans, chunk_plans, relate_plans, stream_plans, more_plans, pattern_plans]
QUERIES: dict = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE: dict[str, str] = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
