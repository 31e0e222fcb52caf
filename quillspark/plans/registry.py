"""How queries register themselves with their oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .adapter import portfolio
from .oracle import with_base


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None, base: bool = True):
        """Decorates a function of a Portfolio (or, if it takes spark and sf_dir, of those)."""

        def keep(f):
            takes = f.__code__.co_varnames[: f.__code__.co_argcount]
            self.queries[name] = f if "sf_dir" in takes else lambda spark, sf_dir: f(portfolio(spark, sf_dir))
            if sql:
                self.sql[name] = with_base(sql) if base else sql.strip()
            return f

        return keep
