"""Review queue: gating and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Decisions that let a row go on.
CLEARED = ("approved", "corrected")


def exportable(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.where(F.col(status).isin(*CLEARED))


def export_report(rows: DataFrame, status: str = "status") -> DataFrame:
    """One row: how many go out, wait, and are rejected."""
    return rows.agg(F.count_if(F.col(status).isin(*CLEARED)).alias("exported"), F.count_if(F.col(status) == "pending").alias("pending"), F.count_if(F.col(status) == "rejected").alias("rejected"))


def goes_on(status: Column) -> Column:
    """Whether a row of this decision counts; one without a decision does."""
    return status.isNull() | status.isin(*CLEARED)


def with_correction(field: str, status: Column, correction: Column) -> Column:
    """A field of a row as its decision leaves it."""
    return F.when(status == "corrected", F.coalesce(correction[field], F.col(field))).otherwise(F.col(field))


def decided(rows: DataFrame, decisions: DataFrame, fields: list[str]) -> DataFrame:
    """``rows`` with the corrections of their decisions (item_id, status, correction) in ``fields``; approved and corrected rows and rows that were never in review."""
    found = rows.join(decisions.select("item_id", F.col("status").alias("_status"), "correction"), "item_id", "left")
    changed = {c: with_correction(c, F.col("_status"), F.col("correction")) for c in fields}
    return found.where(goes_on(F.col("_status"))).withColumns(changed).drop("_status", "correction")
