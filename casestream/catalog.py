"""All queries of the library by name, with their DuckDB SQL."""

from __future__ import annotations

from .plans import live, oracle
from .plans import queries as batch


def queries() -> dict:
    return {**batch.QUERIES, **live.QUERIES}


def oracle_sql() -> dict:
    return {**oracle.ORACLES, **live.ORACLES}
