"""Registered queries: each pairs a DataFrame function over the star-schema tables with the same result in SQL."""

from __future__ import annotations

from gradewell.queries import corpus, distributions, functions, preferences, projections, scoring, sources, summaries, votes
from gradewell.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "corpus", "distributions", "functions", "preferences", "projections", "scoring",
           "sources", "summaries", "votes"]
