"""Registry of named queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Build
    sql: str | None


class Catalogue:
    def __init__(self) -> None:
        self.items: dict[str, Query] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Build], Build]:
        """Register the decorated (spark, sf_dir) function, with its SQL if it has one."""

        def register(build: Build) -> Build:
            if name in self.items:
                raise ValueError(f"query {name} registered twice")
            self.items[name] = Query(build, sql)
            return build

        return register
