"""Temporary SQL functions, the single definition of the text and date rules.

Each function is a ``CREATE TEMPORARY FUNCTION ... RETURN <expression>``. Spark inlines the
body and evaluates every argument once in a projection below it, so a chain of functions
becomes a chain of projections inside whole-stage codegen, with no repeated regex work.
They are callable from SQL and, through the wrappers in this package, from DataFrames.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from feedloom.functions import datesql, entities, textsql


def definitions() -> Iterable[tuple[str, str]]:
    """(name, signature and body) of every function, callees first."""
    yield from datesql.definitions()
    yield from textsql.definitions()
    yield from entities.definitions()


def register_functions(spark: SparkSession) -> None:
    """Create the functions in ``spark`` for use from SQL."""
    for name, rest in definitions():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{rest}")


def call(name: str, *args: Column) -> Column:
    """Column that calls one of the functions, creating them in this session if needed."""
    spark = SparkSession.active()
    if not spark.catalog.functionExists(name):
        register_functions(spark)
    return F.call_function(name, *args)
