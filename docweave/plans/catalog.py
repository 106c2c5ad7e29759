"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import answers, changes, documents, graphs, indexes, lookups, messages, names, tables, texts, vectors

MODULES = (documents, texts, tables, graphs, vectors, answers, changes, indexes, names, lookups, messages)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.SQL.items()}
