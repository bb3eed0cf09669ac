"""How a plan module declares its queries: one callable and, where SQL can say it, one twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Build] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Build], Build]:
        def keep(build: Build) -> Build:
            def run(spark: SparkSession, sf: str) -> DataFrame:
                spark.conf.set("spark.sql.session.timeZone", "UTC")
                return build(spark, sf)

            self.queries[name] = run
            if sql is not None:
                self.oracles[name] = sql
            return build

        return keep
