"""A registry of data-quality rules: name -> (population, violations)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Rule = Callable[[dict[str, DataFrame]], tuple[DataFrame, DataFrame]]


@dataclass(frozen=True)
class Registered:
    """A rule: either a predicate that rows of one table break (``table`` and ``broken``), or a function of all tables."""

    name: str
    rule: Rule | None = None
    table: str | None = None
    broken: str | None = None


def report(rules: list[Registered], tables: dict[str, DataFrame]) -> DataFrame:
    """(rule, population, failures, status) for all rules; an empty population fails.

    All predicates on rows of one table are counted in one scan of it; the other rules read what they compare.
    """
    rows = []
    by_table: dict[str, list[Registered]] = {}
    for r in rules:
        if r.broken is not None:
            by_table.setdefault(r.table, []).append(r)
            continue
        population, violations = r.rule(tables)
        n = population.agg(F.count("*").alias("population"))
        bad = violations.agg(F.count("*").alias("failures"))
        rows.append(n.crossJoin(bad).select(F.lit(r.name).alias("rule"), "population", "failures"))  # one row each
    for name, own in by_table.items():
        counts = tables[name].agg(F.count("*").alias("population"), *(F.count_if(F.coalesce(F.expr(r.broken), F.lit(False))).alias(f"r{i}") for i, r in enumerate(own)))
        each = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.col(f"r{i}").alias("failures")) for i, r in enumerate(own)))).alias("x")
        rows.append(counts.select("population", each).select("x.rule", "population", "x.failures"))
    status = F.when(F.col("population") == 0, "FAIL").when(F.col("failures") > 0, "FAIL").otherwise("PASS")
    return reduce(DataFrame.unionByName, rows).withColumn("status", status)


def where(name: str, table: str, broken: str) -> Registered:
    """Rows that meet a predicate are violations."""
    return Registered(name, table=table, broken=broken)


def unique(name: str, table: str, *keys: str) -> Registered:
    return Registered(name, lambda t: (t[table], t[table].groupBy(*keys).count().where("count > 1")))


def present(name: str, table: str, column: str, other: str, other_column: str) -> Registered:
    """Every value of a column occurs in another table."""
    return Registered(name, lambda t: (t[table], t[table].select(F.col(column).alias("k")).where("k is not null").join(t[other].select(F.col(other_column).alias("k")), "k", "left_anti")))


def bijection(name: str, left: str, left_column: str, right: str, right_column: str) -> Registered:
    """Two columns hold the same set of values."""

    def rule(t: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
        a, b = t[left].select(F.col(left_column).cast("string").alias("k")).distinct(), t[right].select(F.col(right_column).cast("string").alias("k")).distinct()
        return a.unionAll(b), a.join(b, "k", "left_anti").unionAll(b.join(a, "k", "left_anti"))

    return Registered(name, rule)


def floor(name: str, table: str, least: int, *distinct: str) -> Registered:
    """At least so many rows, or distinct values of columns."""

    def rule(t: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
        rows = t[table].select(*distinct).distinct() if distinct else t[table]
        return t[table], rows.agg(F.count("*").alias("n")).where(F.col("n") < least)

    return Registered(name, rule)


def closed(name: str, table: str, column: str, domain: list) -> Registered:
    members = ", ".join(f"'{d}'" if isinstance(d, str) else str(d) for d in domain)
    return Registered(name, table=table, broken=f"{column} is null or {column} not in ({members})")


def covers(name: str, table: str, column: str, domain: list) -> Registered:
    """Every member of the domain occurs."""

    def rule(t: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
        members = t[table].sparkSession.createDataFrame([(d,) for d in domain], f"k {t[table].schema[column].dataType.simpleString()}")
        return t[table], members.join(t[table].select(F.col(column).alias("k")).distinct(), "k", "left_anti")

    return Registered(name, rule)


def one_of(name: str, table: str, key: str, value: str) -> Registered:
    """A key has one value only (an alias table is a function)."""
    return Registered(name, lambda t: (t[table], t[table].groupBy(key).agg(F.countDistinct(value).alias("n")).where("n > 1")))


def recomputed(name: str, table: str, stored: str, derived: str) -> Registered:
    """A stored value equals the one an expression derives from its row."""
    return Registered(name, table=table, broken=f"{stored} is distinct from {derived}")
