"""All queries of the core and their SQL."""

from __future__ import annotations

from gridspark.plans import core_found, core_sql, reference, stores  # noqa: F401, the last one registers with the third


def queries() -> dict:
    return {**core_found.QUERIES, **reference.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**core_sql.SQL, **reference.SQL}
