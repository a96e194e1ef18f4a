"""Catalogue of runnable plans: a Spark job, its output columns and, where SQL
can say the same, the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLANS: dict[str, "Plan"] = {}


@dataclass(frozen=True)
class Plan:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    columns: str
    covers: tuple[str, ...]
    sql: str | None = None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return shape(self.build(spark, sf_dir), self.columns)


def plan(name: str, columns: str, covers: str, sql: str | None = None):
    """Register the decorated ``(spark, sf_dir) -> DataFrame`` under ``name``."""

    def decorate(build):
        if name in PLANS:
            raise ValueError(f"duplicate plan {name}")
        checked = shape_sql(sql, columns) if sql else None
        PLANS[name] = Plan(name, build, columns, tuple(covers.split()), checked)
        return build

    return decorate


def _fields(columns: str):
    for item in columns.split():
        name, kind = item.split(":")
        yield name, kind


def shape(df: DataFrame, columns: str) -> DataFrame:
    """Project to the declared columns: s text, d date as text, i long, b boolean,
    f double rounded to 6 digits (fN to N digits)."""
    out = []
    for name, kind in _fields(columns):
        c = F.col(name)
        if kind in ("s", "d"):
            c = c.cast("string")
        elif kind == "i":
            c = c.cast("long")
        elif kind == "b":
            c = c.cast("boolean")
        else:
            c = F.round(c.cast("double"), int(kind[1:] or 6))
        out.append(c.alias(name))
    return df.select(*out)


def shape_sql(sql: str, columns: str) -> str:
    out = []
    for name, kind in _fields(columns):
        if kind in ("s", "d"):
            c = f"CAST({name} AS VARCHAR)"
        elif kind == "i":
            c = f"CAST({name} AS BIGINT)"
        elif kind == "b":
            c = f"CAST({name} AS BOOLEAN)"
        else:
            c = f"round(CAST({name} AS DOUBLE), {int(kind[1:] or 6)}) + 0.0"
        out.append(f"{c} AS {name}")
    return f"SELECT {', '.join(out)} FROM (\n{sql}\n) AS answer"
