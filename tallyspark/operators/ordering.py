"""Orders of reports, as sort keys; each is total, so a limit is repeatable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import saved


def sku_number(sku: str = "sku") -> Column:
    """The digits that a sku begins with, null if none or 0."""
    return F.nullif(F.regexp_extract(sku, r"\A\s*(-?[0-9]+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def by_sku(sku: str = "sku") -> list[Column]:
    """Numeric skus by number, then the others by collation."""
    return [sku_number(sku).asc_nulls_last(), F.expr(f"`{sku}` COLLATE UNICODE").asc(), F.col(sku).asc()]


def by_name(name: str = "name") -> list[Column]:
    return [F.expr(f"`{name}` COLLATE UNICODE").asc(), F.col(name).asc()]


def by_label(label: str) -> list[Column]:
    """Groups of a report by their label's collation."""
    return by_name(label)


def by_amount(amount: str, *ties: str) -> list[Column]:
    return [F.desc(amount), *[F.asc(t) for t in ties]]


def top(rows: DataFrame, n: int, order: list) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def placed(rows: DataFrame, order: list, place: str = "place") -> DataFrame:
    """Every row with its ``place``, a long from 1, in the whole order, or without an order in the one that rows have.

    A range-partitioned sort is written once, each row with its partition and its number there, and counts of the
    partitions are offsets: what is read later is always the same table, whatever is lost meanwhile. Equal rows of the order
    get places of their own; which of them comes first is open.
    """
    part, within = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    cut = saved((rows.orderBy(*order) if order else rows).select("*", part.alias("_part"), within.alias("_within")), "placed")
    counts = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return cut.join(F.broadcast(offsets), "_part").withColumn(place, F.col("_before") + F.col("_within") + 1).drop("_part", "_within", "_before")


def top_of_each(rows: DataFrame, keys: list[str], n: int, order: list) -> DataFrame:
    """The first ``n`` rows of each key with their ``rank``."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)
