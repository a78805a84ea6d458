"""Registered queries, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimspark.catalog.roles_sql import with_parts
from claimspark.catalog.sql_parts import PARTS
from claimspark.session import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; `sql` may use the tables and the named parts."""

    def register(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = with_parts(sql, PARTS)
        return build

    return register


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/claimspark-queries/{label}-{uuid.uuid4().hex}"
