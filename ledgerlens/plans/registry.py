"""Catalogue of runnable queries and their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Result columns in the widest plain type, so both engines name the same types."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.FloatType, T.DecimalType)):
            c = c.cast("double")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder)`` and, where it exists, the equivalent SQL."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query name used twice: {name}")
        QUERIES[name] = lambda spark, folder: plain(fn(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def with_tables(body: str) -> str:
    """Prefix the CTEs that ``body`` mentions, directly or through another CTE."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text, re.I):
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in needed)
    text = body.lstrip()
    if re.match(r"with\s", text, re.I):
        recursive = re.match(r"with\s+recursive\s", text, re.I)
        rest = text[recursive.end():] if recursive else re.sub(r"^with\s+", "", text, flags=re.I)
        return f"WITH {'RECURSIVE ' if recursive else ''}{head},\n{rest}"
    return f"WITH {head}\n{text}"
