"""All queries of the library itself."""

from __future__ import annotations

from . import bins, files, matrices, more, registry, relational, sequences, similarity  # noqa: F401


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
