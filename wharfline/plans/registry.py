"""Registration of a query beside the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


#: Result columns that are long integers in every query.
LONGS = {"rank", "p50", "p80", "p95", "n", "offset", "margin", "day", "mark", "seq", "days", "legs", "loops", "ordinal", "position", "units", "chunks"}


def widened(function: Query) -> Query:
    @wraps(function)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = function(spark, sf_dir)
        return out.withColumns({c: out[c].cast("long") for c, kind in out.dtypes if kind == "int" and c in LONGS})

    return run


@dataclass
class Registry:
    queries: dict[str, Query] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a function under its name; ``sql`` is DuckDB SQL with the same rows, None where SQL can't express it."""

        def add(function: Query) -> Query:
            name = function.__name__
            if name in self.queries:
                raise ValueError(f"a second query named {name}")
            self.queries[name] = widened(function)
            if sql is not None:
                self.sql[name] = sql
            return function

        return add
