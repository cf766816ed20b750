"""Collects registered queries and the SQL that checks them."""

from __future__ import annotations

from verification.views import sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(text: str | None = None, raw: bool = False):
    """Register a query under its function name; ``text`` is its SQL (with the shared tables unless ``raw``)."""

    def add(build):
        name = build.__name__
        assert name not in QUERIES, name
        QUERIES[name] = build
        if text is not None:
            ORACLES[name] = text.strip() if raw else sql(text)
        return build

    return add
