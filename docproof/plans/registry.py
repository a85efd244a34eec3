"""Where queries are registered by name, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docproof.settings import DEFAULTS
from docproof.sources.tables import RAW, load, with_clause

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW = f"timestamp '{DEFAULTS.as_of}'"


def query(name: str, *tables: str, sql: str | None = None):
    """Registers a function of DataFrames as a query over those tables; ``sql`` follows their definitions."""

    def put(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(*[load(spark, sf_dir, t) for t in tables])
        if sql:
            adapted = [t for t in tables if t not in RAW]
            body = sql.strip()
            head = with_clause(*adapted) if adapted else ""
            ORACLES[name] = f"{head}{',' if head else ''} {body[5:]}" if body.lower().startswith("with ") and head else f"{head} {body}"
        return f

    return put
