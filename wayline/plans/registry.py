"""The registered queries and their SQL."""

from __future__ import annotations

from wayline.plans import distances, tracks

QUERIES = tracks.QUERIES | distances.QUERIES
SQL = tracks.SQL | distances.SQL
