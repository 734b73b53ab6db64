"""Query registration, table access and shared views."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from changeloom.catalog.views import VIEWS
from changeloom.session import ship_package

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_PLACEHOLDER = re.compile("\\{(" + "|".join([*TABLES, *VIEWS]) + ")\\}")


def _references(text: str) -> list[str]:
    return _PLACEHOLDER.findall(text)


class Tables:
    """Tables of one directory, and views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, directory: str):
        ship_package(spark)
        self.spark = spark
        self.directory = directory
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._cache:
            if name in TABLES:
                self._cache[name] = self.spark.read.parquet(f"{self.directory}/{name}.parquet")
            else:
                self._cache[name] = self.sql(VIEWS[name])
        return self._cache[name]

    def sql(self, text: str) -> DataFrame:
        names = set(_references(text))
        parts = _PLACEHOLDER.split(text)
        # Braces of JSON texts are doubled, so that only table references are substituted.
        quoted = "".join(
            f"{{{part}}}" if i % 2 else part.replace("{", "{{").replace("}", "}}") for i, part in enumerate(parts))
        return self.spark.sql(quoted, **{name: getattr(self, name) for name in names})


def query(name: str, oracle: str | None = None):
    """Register ``build(tables) -> DataFrame`` under a name, with the oracle SQL if one exists."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, directory: build(Tables(spark, directory))
        if oracle is not None:
            ORACLES[name] = expand(oracle)
        return build

    return register


def _needed(text: str, found: list[str]) -> None:
    for name in _references(text):
        if name in VIEWS and name not in found:
            _needed(VIEWS[name], found)
            found.append(name)


def expand(text: str) -> str:
    """Turn ``{view}`` references into common table expressions and ``{table}`` references into plain names."""
    views: list[str] = []
    _needed(text, views)
    ctes = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in views)
    body = text.strip()
    recursive = body.upper().startswith("WITH RECURSIVE ")
    if recursive or body.upper().startswith("WITH "):
        body = body[15 if recursive else 5:]
        ctes = f"{ctes},\n" if ctes else ""
        body = f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{body}"
    elif ctes:
        body = f"WITH {ctes}\n{body}"
    return _PLACEHOLDER.sub(lambda m: m.group(1), body)
