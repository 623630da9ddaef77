"""Case and unit totals with their sources: rows to pages to jobs. The two kinds never mix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rollups import SUM


def source() -> Column:
    """The source of a row's value."""
    return F.struct(F.col("page"), F.col("row"), F.col("unit"), F.col("quantity").cast("decimal(18,3)").alias("quantity"))


def calculated(rows: DataFrame) -> DataFrame:
    """``rows`` with cases, units, success and warnings: needs a rule, a product and a quantity of 0 or more; units only if both rule and product allow them."""
    warnings = F.array_compact(F.array(F.when(F.col("rule_allows").isNull(), "missing_rule"), F.when(F.col("product_allows").isNull(), "missing_product"), F.when(~F.coalesce(F.col("quantity") >= 0, F.lit(False)), "invalid_quantity")))
    first = F.slice(warnings, 1, 1)
    fine = F.size(warnings) == 0
    quantity, none = F.col("quantity").cast("decimal(18,3)"), F.lit(0).cast("decimal(18,3)")
    units = F.col("rule_allows") & F.col("product_allows")
    return rows.withColumns({"units": F.when(fine & units, quantity).otherwise(none), "cases": F.when(fine & ~units, quantity).otherwise(none), "success": fine, "warnings": first})


def batch_totals(rows: DataFrame) -> DataFrame:
    """One row of a calculated batch: totals, number of warnings, success if there is none; ``batch_warnings`` has the warnings."""
    return rows.agg(F.coalesce(F.sum("cases"), F.lit(0)).cast(SUM).alias("cases"), F.coalesce(F.sum("units"), F.lit(0)).cast(SUM).alias("units"), F.coalesce(F.sum(F.size("warnings")), F.lit(0)).cast("long").alias("warning_count"), (F.coalesce(F.sum(F.size("warnings")), F.lit(0)) == 0).alias("success"))


def batch_warnings(rows: DataFrame, order: list[str]) -> DataFrame:
    """The warnings of all rows of a calculated batch, one a row, with the row's ``order`` columns and their place in it."""
    return rows.select(*order, F.posexplode("warnings").alias("place", "warning"))


def _amount(unit: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("unit") == unit, F.col("quantity").cast("decimal(18,3)"))), F.lit(0)).cast(SUM)


def page_totals(rows: DataFrame, sources: bool = True) -> DataFrame:
    """Cases and units of each product on each page; rows of quantity 0 are among the sources too."""
    extra = [F.array_sort(F.collect_list(source())).alias("sources")] if sources else []
    return rows.groupBy("job_id", "page", "product_key").agg(_amount("case").alias("cases"), _amount("unit").alias("units"), F.count(F.lit(1)).alias("row_count"), *extra)


def job_totals(pages: DataFrame) -> DataFrame:
    """Page totals summed over each job, sources gathered; rows without a product key are left out."""
    extra = [F.array_sort(F.flatten(F.collect_list("sources"))).alias("sources")] if "sources" in pages.columns else []
    return pages.where("product_key is not null").groupBy("job_id", "product_key").agg(F.sum("cases").cast(SUM).alias("cases"), F.sum("units").cast(SUM).alias("units"), F.sum("row_count").alias("row_count"), *extra)


def source_rows(totals: DataFrame) -> DataFrame:
    """The flat form of lineage: a row for each source of each total."""
    keys = [c for c in ("job_id", "product_key") if c in totals.columns]
    return totals.select(*keys, F.explode("sources").alias("s")).select(*keys, "s.*")


def traced(sources: DataFrame, pages: DataFrame) -> DataFrame:
    """Sources with what is known about their page."""
    return sources.join(pages, ["job_id", "page"], "left")


def traced_jobs(sources: DataFrame, jobs: DataFrame) -> DataFrame:
    """Sources with what is known about their job."""
    return sources.join(jobs, "job_id", "left")


def zero_totals(totals: DataFrame) -> DataFrame:
    return totals.where("cases = 0 and units = 0")


def high_totals(totals: DataFrame, threshold: float | None) -> DataFrame:
    """Totals over the threshold; none if it isn't set."""
    return totals.where(F.lit(False)) if threshold is None else totals.where((F.col("cases") > threshold) | (F.col("units") > threshold))
