"""Latest rows: of records sent more than once the last one stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the one with the greatest `order`; null keys are equal.
    An aggregation with partial results, so a hot key is no hot task."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(last.alias("_last")).select(*keys, *(F.col("_last")[c].alias(c) for c in rest))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("_first")).select(*keys, *(F.col("_first")[c].alias(c) for c in rest))


def sequence(df: DataFrame, keys: list[str], order: list[Column], name: str = "seq") -> DataFrame:
    """Numbers rows from 0 within their key."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("bigint"))


#: Width of the blocks of an order column that running() reads at once.
BLOCK = 100_000


def running(df: DataFrame, keys: list[str], order: str, sums: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """Adds running sums within a key, in the order of a whole-number column
    (ties share a place in no set order), each up to and with its row. Windows run
    over blocks of the order column, and what the blocks before hold is added from
    their totals: no task holds all rows of a hot key."""
    rows = df.withColumn("_block", F.floor(F.col(order) / F.lit(block)))
    for name, value in sums.items():
        rows = rows.withColumn(name, value)
    totals = rows.groupBy(*keys, "_block").agg(*(F.sum(n).alias(f"_{n}") for n in sums))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_block").alias("_b"), *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums))
    within = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select(*df.columns, "_block", *(F.sum(n).over(within).alias(n) for n in sums))
    same = F.col("_block") == F.col("_b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(carried, same).select(*df.columns, *((F.col(n) + F.col(f"_{n}")).alias(n) for n in sums))


def missing_from(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not among those done."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")
