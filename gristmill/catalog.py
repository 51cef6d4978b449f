"""The registry of queries: name -> (spark, folder) -> DataFrame, and the SQL of each."""

from __future__ import annotations

from .plans import knowledge, listing, records, search, streams, tabular, web

FLAGSHIP = "agg_group_summary"
QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _plan in (tabular, search, records, web, streams, listing, knowledge):
    QUERIES |= _plan.QUERIES
    ORACLE |= _plan.ORACLE
