"""All registered queries outside of training-data pipelines, by the inventory's ids."""

from __future__ import annotations

from tidemark.plans import event_queries, market_queries, study_queries, text_queries, upkeep_queries

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _module in (market_queries, text_queries, event_queries, upkeep_queries, study_queries):
    QUERIES |= _module.book.queries
    SQL |= _module.book.sql
