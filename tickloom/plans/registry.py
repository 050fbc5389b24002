"""Registered queries: a Spark plan and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import ship_package

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    plan: Plan
    sql: str | None
    exact: tuple[str, ...]
    floats: tuple[str, ...]
    digits: int


REGISTRY: dict[str, Query] = {}


def query(name: str, exact: str, floats: str = "", sql: str | None = None, digits: int = 4):
    """Register a query. ``exact`` columns compare as they are, ``floats`` rounded."""

    def add(plan: Plan) -> Plan:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(plan, sql, tuple(exact.split()), tuple(floats.split()), digits)
        return plan

    return add


def _shaped(q: Query, df: DataFrame) -> DataFrame:
    def rounded(c: str):
        r = F.round(F.col(c).cast("double"), q.digits)
        return F.when(r == 0, F.lit(0.0)).otherwise(r).alias(c)

    if q.exact == ("*",):  # every column, those of floating point rounded
        return df.select(*[rounded(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    return df.select(*[F.col(c) for c in q.exact], *[rounded(c) for c in q.floats])


def _shaped_sql(q: Query) -> str:
    def rounded(c: str) -> str:
        r = f"round(CAST({c} AS DOUBLE), {q.digits})"
        return f"CASE WHEN {r} = 0 THEN 0.0::DOUBLE ELSE {r} END AS {c}"

    cols = ", ".join([*[f'"{c}"' for c in q.exact], *[rounded(c) for c in q.floats]])
    return f"SELECT {cols} FROM (\n{q.sql.strip()}\n) AS answer"


def plans() -> dict[str, Plan]:
    def bind(q: Query) -> Plan:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return _shaped(q, q.plan(spark, sf_dir))

        return run

    return {name: bind(q) for name, q in REGISTRY.items()}


def oracle() -> dict[str, str]:
    return {name: _shaped_sql(q) for name, q in REGISTRY.items() if q.sql}
