"""Every query of the library with its SQL, by name."""

from __future__ import annotations

from sluice.queries import QUERIES, SQL, analytics, commerce, governance, ingest, learning, loading, mining, models, panel, quality, relations, statistics, streams, text

MODULES = (analytics, commerce, governance, ingest, learning, loading, mining, models, panel, quality, relations, statistics, streams, text)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
