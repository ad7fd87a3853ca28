"""Registry of the engine's queries and of their SQL counterparts."""

from __future__ import annotations

from loamline.plans import code_queries, corpus_queries, edit_queries, form_queries, run_queries

QUERIES = corpus_queries.QUERIES | run_queries.QUERIES | code_queries.QUERIES | edit_queries.QUERIES | form_queries.QUERIES
SQL = corpus_queries.SQL | run_queries.SQL | code_queries.SQL | edit_queries.SQL | form_queries.SQL
flagship = corpus_queries.flagship
