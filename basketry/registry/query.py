from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    """``build(spark, sf_dir)`` and, where SQL can say it, the equivalent text."""

    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
