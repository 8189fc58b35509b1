"""Queries by operator key: how Spark builds each, and the SQL that says what it must return."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from millrace.plans.engine import Engine
from millrace.sources import tables

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Builder
    oracle: str | None


def asked(spark: SparkSession, folder: str, text: str, args: dict | None = None) -> DataFrame:
    """A statement in the engine's dialect over the folder's tables; only those that it names are opened."""
    e = Engine(spark, None)
    for name in tables.named(text):
        e.attach(name, tables.read(spark, folder, name))
    return e.sql(text, args).df


def same(text: str) -> Query:
    """One text that the engine and the oracle run."""
    return Query(lambda spark, folder: asked(spark, folder, text), text)


def pair(text: str, oracle: str, args: dict | None = None) -> Query:
    return Query(lambda spark, folder: asked(spark, folder, text, args), oracle)


def frame(build: Callable[..., DataFrame], oracle: str | None, *names: str) -> Query:
    """A DataFrame program over the named tables."""
    return Query(lambda spark, folder: build(*[tables.read(spark, folder, n) for n in names]), oracle)
