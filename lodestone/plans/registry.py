"""The named queries of the retrieval engine and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracle
from . import queries as bound

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {name: getattr(bound, name) for name in bound.NAMES}


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
