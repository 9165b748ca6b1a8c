"""Registered queries: a DataFrame builder, its output columns and the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {"l": ("bigint", "BIGINT"), "d": ("double", "DOUBLE"), "s": ("string", "VARCHAR")}


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    columns: tuple[tuple[str, str], ...]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(spark, sf_dir)
        return df.select(*[F.col(c).cast(KINDS[k][0]).alias(c) for c, k in self.columns])

    def check(self) -> str | None:
        if self.sql is None:
            return None
        cols = ", ".join(f"CAST({c} AS {KINDS[k][1]}) AS {c}" for c, k in self.columns)
        return f"SELECT {cols} FROM (\n{self.sql}\n) AS q"


REGISTRY: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None):
    """Register a builder; ``columns`` lists ``name:kind`` with kind l(ong), d(ouble), s(tring)."""
    cols = tuple(tuple(c.strip().split(":")) for c in columns.split(","))

    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query registered twice: {name}")
        REGISTRY[name] = Query(name, fn, cols, sql)
        return fn

    return keep
