"""The engine's queries and their DuckDB oracles, by name."""

from __future__ import annotations

from tidemill.plans import business, content, keywords, landed, markup, outreach, paged, phrases, recommend, routine, streams, traffic

QUERIES: dict = {}
ORACLES: dict = {}
for module in (traffic, business, content, recommend, outreach, keywords, routine, landed, markup, streams, phrases, paged):
    QUERIES.update(module.QUERIES)
    ORACLES.update(module.ORACLES)
