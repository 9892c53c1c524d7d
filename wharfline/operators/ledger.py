"""Prices, costs, token rollups, outcomes; reconciliation of two tables; draining a spool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wharfline.shared import checked_broadcast

CLASSES = ("input", "cache_write", "cache_read", "output")


def price_intervals(prices: DataFrame) -> DataFrame:
    """``prices`` with effective_to: the next effective date of the same version and model."""
    own = Window.partitionBy("version", "model").orderBy("effective_from")
    return prices.withColumn("effective_to", F.lead("effective_from").over(own))


def priced(invocations: DataFrame, prices: DataFrame, *, version: str) -> DataFrame:
    """Invocations joined with the price in force on their UTC day; a price table is small, the ledger is not moved."""
    table = price_intervals(prices.where(F.col("version") == version)).drop("version").withColumnRenamed("model", "priced_model")
    day = F.to_date("at")
    on = (F.col("model") == F.col("priced_model")) & (day >= F.col("effective_from")) & (F.col("effective_to").isNull() | (day < F.col("effective_to")))
    return invocations.join(checked_broadcast(table), on, "left")


def cost(tokens: list[Column], rates: list[Column]) -> Column:
    """Sum of tokens times rate (USD for a million) at full precision, rounded half to even once, to ten places."""
    total = tokens[0].cast("decimal(12,0)") * rates[0].cast("decimal(12,6)")
    for t, r in zip(tokens[1:], rates[1:], strict=True):
        total = total + t.cast("decimal(12,0)") * r.cast("decimal(12,6)")
    # a million shifts six places: the sum has scale 6, so the quotient has 12 and is exact
    return F.bround(total.cast("decimal(26,6)") * F.lit("0.000001").cast("decimal(7,6)"), 10).cast("decimal(18,10)")


def outcome(valid_first: Column, attempts: Column, valid_last: Column) -> Column:
    return F.when(valid_first, "valid").when((attempts > 1) & valid_last, "repaired").otherwise("failed")


def symmetric_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, as bags, with side; nulls equal nulls."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionAll(right.exceptAll(left).withColumn("side", F.lit("right")))


def unseen(new: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key isn't held: what an insert-if-absent appends.  One row for each key."""
    return new.join(held.select(*keys), keys, "left_anti").dropDuplicates(keys)


def drain(spool: DataFrame, ledger: DataFrame, *, versions: tuple[int, ...] = (1,)) -> tuple[DataFrame, DataFrame]:
    """(appended, retained): spooled rows of a known payload version and whole, once each and not yet in the ledger; the rest stays."""
    fit = F.col("payload_version").isin(*versions) & F.col("invocation_id").isNotNull() & (F.col("tokens") >= 0)
    fit = F.coalesce(fit, F.lit(False))
    return unseen(spool.where(fit), ledger, ["invocation_id"]), spool.where(~fit)


def reconciled(attempted: DataFrame, recorded: DataFrame, key: str) -> DataFrame:
    """(key, attempted, recorded, verdict) over the rows of two ledgers: counts of both sides for every key of either.

    ``matched``, ``unrecorded`` (more attempts), ``unattempted`` (more records).  Each side is folded by key before they
    meet; a null key is a key like others.
    """
    side = lambda rows, name: rows.groupBy(F.col(key).alias(f"{name}_key")).agg(F.count("*").alias(name))
    left, right = side(attempted, "attempted"), side(recorded, "recorded")
    both = left.join(right, F.col("attempted_key").eqNullSafe(F.col("recorded_key")), "full")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("attempted", "recorded")]
    out = both.select(F.coalesce("attempted_key", "recorded_key").alias(key), *counts)
    return out.withColumn("verdict", F.when(F.col("attempted") > F.col("recorded"), "unrecorded").when(F.col("attempted") < F.col("recorded"), "unattempted").otherwise("matched"))


def scope_proof(members: DataFrame, scoped: DataFrame, key: str) -> DataFrame:
    """(scope, n, complete): rows of each scope, and whether ``scoped`` (key, scope) puts every one of ``members`` (key) into one scope.

    A member without a scope counts under ``unscoped``, one with several under ``contested``, and a scoped row that is no
    member under ``unknown``; the partition is complete if there are none of them.
    """
    held = scoped.groupBy(F.col(key).alias("k")).agg(F.min("scope").alias("least"), F.max("scope").alias("most"), F.count("*").alias("times"))
    own = members.select(F.col(key).alias("m")).distinct()
    present, found = F.col("times").isNotNull(), F.col("is_member")
    both = own.withColumn("is_member", F.lit(True)).join(held, F.col("m").eqNullSafe(F.col("k")), "full")
    scope = F.when(found.isNull(), "unknown").when(~present | F.col("least").isNull(), "unscoped").when((F.col("least") != F.col("most")) | (F.col("times") > 1), "contested").otherwise(F.col("least"))
    counts = both.groupBy(scope.alias("scope")).agg(F.count("*").alias("n"))
    faults = F.max(F.col("scope").isin("unknown", "unscoped", "contested").cast("int")).over(Window.partitionBy(F.lit(0)))  # a row for each scope
    return counts.select("scope", "n", (faults == 0).alias("complete"))


def apportioned(weights: DataFrame, *, stratum: str, weight: str, total: int) -> DataFrame:
    """(stratum, allotted): ``total`` dealt to the strata by whole weights: floors, one at least, then the largest remainders.

    Equal remainders go to the lesser stratum.  A row for each stratum is all that the window sees.
    """
    every = Window.partitionBy(F.lit(0))
    w = weights.select(stratum, F.col(weight).cast("long").alias("w")).withColumn("declared", F.sum("w").over(every))
    w = w.withColumn("low", F.greatest(F.lit(1).cast("long"), F.expr(f"w * {total} div declared")))
    placed = w.withColumn("r", F.row_number().over(every.orderBy(F.desc(F.col("w") * total % F.col("declared")), stratum))).withColumn("missing", total - F.sum("low").over(every))
    return placed.select(stratum, (F.col("low") + F.when(F.col("r") <= F.col("missing"), 1).otherwise(0)).alias("allotted"))
