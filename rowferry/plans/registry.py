"""The table of registered queries."""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rowferry.plans import inputs
from rowferry.sources.relational import load_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables and the inputs derived from them, by attribute."""

    def __init__(self, spark: SparkSession, directory: str) -> None:
        self.spark = spark
        self.directory = directory

    def __getattr__(self, name: str) -> DataFrame:
        derive = inputs.DERIVED.get(name)
        if derive is not None:
            found = derive(self)
        else:
            found = load_table(self.spark, self.directory, name)
        # found again as a plain attribute, so each file schema is read once
        self.__dict__[name] = found
        return found


def query(name: str, sql: str | None = None):
    """Register a query over the tables, with its SQL counterpart if it has one.

    The SQL may name derived inputs as ``@name``; they become common table
    expressions.
    """

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = lambda spark, directory: build(Tables(spark, directory))
        QUERIES[name].__doc__ = inspect.getdoc(build)
        if sql:
            ORACLES[name] = with_inputs(sql)
        return build

    return register


def with_inputs(sql: str) -> str:
    """Put the SQL of every derived input that a query names in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"@(\w+)", text):
            if name not in needed:
                visit(inputs.DERIVED_SQL[name])
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    parts = [f"{n} AS ({re.sub(r'@(\w+)', r'\1', inputs.DERIVED_SQL[n])})" for n in needed]
    return f"WITH {', '.join(parts)} {re.sub(r'@(\w+)', r'\1', sql)}"
