"""Aggregations of enriched rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import round_half_up
from .ordering import by_label, placed

SUM = "decimal(38,3)"


def total(column: str) -> Column:
    """Sum as decimal, 0 for nothing."""
    return F.coalesce(F.sum(F.col(column).cast("decimal(18,3)")), F.lit(0)).cast(SUM)


def mean(column: str) -> Column:
    """Mean of a share, from an exact sum, so that it doesn't depend on the order of rows."""
    return F.sum(F.col(column).cast("decimal(18,6)")).cast("double") / F.nullif(F.count(column), F.lit(0))


def summarize(rows: DataFrame, seq: list[str] | None = None) -> DataFrame:
    """For each sku the name of its first row, total quantity, units and cases, and the number of invoices; '' is a sku too."""
    name = F.min_by("name", F.struct(*seq)) if seq else F.min("name")
    return rows.groupBy("sku").agg(name.alias("name"), total("quantity").alias("total_quantity"), total("units").alias("total_units"), total("cases").alias("total_cases"), F.count_distinct("invoice").alias("invoice_count"))


def grouped(products: DataFrame, *keys: str, items: bool = False) -> DataFrame:
    """Count and totals of each group; with its items in sku order if asked for, for groups that fit a row, such as a report's. ``group_items`` has the items of groups of any size."""
    extra = [F.sort_array(F.collect_list(F.struct("sku", *[c for c in products.columns if c not in ("sku", *keys)]))).alias("items")] if items else []
    return products.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), total("quantity").alias("total_quantity"), total("cases").alias("total_cases"), total("units").alias("total_units"), *extra)


def status(confidence: Column) -> Column:
    """Over 0.98 excellent, over 0.90 good, else to be reviewed."""
    return F.when(confidence > 0.98, "Excellent").when(confidence > 0.90, "Good").otherwise("Needs Review")


def status_rank(name: Column) -> Column:
    return F.when(name == "Excellent", 1).when(name == "Good", 2).otherwise(3)


def by_status(products: DataFrame, items: bool = False) -> DataFrame:
    return grouped(products.withColumn("status", status(F.col("confidence"))), "status", items=items).withColumn("status_order", status_rank(F.col("status")))


def flattened(groups: DataFrame) -> DataFrame:
    """The items of all groups that hold theirs."""
    return groups.select(F.explode("items").alias("item")).select("item.*")


def group_items(products: DataFrame, *keys: str) -> DataFrame:
    """What ``flattened`` gives of ``grouped(..., items=True)``, without gathering a group: every product of a group, without its group's keys."""
    groups = grouped(products, *keys).select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return products.join(groups, same).drop(*keys, *[f"_{k}" for k in keys])


def flattened_in_order(products: DataFrame, key: str, order: list, place: str = "place") -> DataFrame:
    """The items of all groups one after the other, groups by their label and each group's items in order, with their ``place`` from 1; no group is gathered."""
    return placed(products, [*by_label(key), *order], place)


def group_summary(groups: DataFrame) -> DataFrame:
    """One row: number of groups and totals of their totals."""
    return groups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("count"), F.lit(0)).alias("total_items"), *[F.coalesce(F.sum(c), F.lit(0)).cast(SUM).alias(c) for c in ("total_quantity", "total_cases", "total_units")])


def with_totals(rows: DataFrame, group: str, item: str) -> DataFrame:
    """Detail and a total row for each group, as a report's sheet has them; ``is_total`` tells them apart."""
    sets = rows.groupingSets([(group, item), (group,)], group, item)
    return sets.agg(total("quantity").alias("quantity"), total("cases").alias("cases"), total("units").alias("units"), F.grouping(item).cast("int").alias("is_total"))


def warning_groups(warnings: DataFrame) -> DataFrame:
    """Warnings by type and message with their number; the severity is the first one's."""
    return warnings.groupBy("type", "message").agg(F.count(F.lit(1)).alias("count"), F.min_by("severity", "seq").alias("severity"))


def warning_counts(warnings: DataFrame) -> DataFrame:
    return warnings.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count_if(F.col("type") == "unknown_sku").alias("unknown_sku"), F.count_if(F.col("type") == "ocr_warning").alias("ocr_warning"))


def batch_statistics(rows: DataFrame) -> DataFrame:
    """One row about a batch: share of rows without a warning, mean confidence, row, product and quantity counts. Rows need sku, quantity, cases, units, confidence and ``warned``."""
    n = F.count(F.lit(1))
    good = F.count_if(~F.col("warned"))
    return rows.agg(
        F.coalesce(good / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("ocr_accuracy"),
        F.coalesce(mean("confidence"), F.lit(0.0)).alias("average_confidence"),
        n.alias("total_rows"), good.alias("successful_rows"), F.count_if("warned").alias("rows_with_warnings"), F.count_distinct("sku").alias("total_products"),
        total("cases").alias("total_cases"), total("units").alias("total_units"), total("quantity").alias("total_quantity"),
    )


def product_rows(rows: DataFrame) -> DataFrame:
    """A product for each sku: totals, mean confidence, number of rows, distinct warnings in order.

    What is gathered is each combination of warnings once, made distinct before rows are shuffled.
    """
    warnings = F.collect_set(F.when(F.size("warnings") > 0, F.col("warnings")))
    return rows.groupBy("sku").agg(F.min("barcode").alias("barcode"), F.min("name").alias("name"), total("quantity").alias("quantity"), total("cases").alias("cases"), total("units").alias("units"), mean("confidence").alias("confidence"), F.count(F.lit(1)).alias("rowCount"), F.array_sort(F.array_distinct(F.flatten(warnings))).alias("warnings"))


def price_totals(items: DataFrame) -> DataFrame:
    """One row: price times quantity, quantity, their mean for each line, number of lines, least and greatest price; zeros for nothing."""
    amount = F.coalesce(F.sum((F.col("price").cast("decimal(18,2)") * F.col("quantity").cast("decimal(18,3)")).cast("decimal(28,5)")), F.lit(0)).cast("double")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return items.agg(round_half_up(amount).alias("total_price"), total("quantity").cast("double").alias("total_quantity"), zero(round_half_up(amount / F.nullif(F.count(F.lit(1)), F.lit(0)))).alias("average_price"), F.count(F.lit(1)).alias("item_count"), zero(F.min("price")).alias("min_price"), zero(F.max("price")).alias("max_price"))


#: Accuracy of the sketch that brackets a median: it lies within three parts of so many of a group's rows.
ACCURACY = 10_000


def price_statistics(items: DataFrame, *keys: str) -> DataFrame:
    """Least, greatest, mean, exact median, sum and number of prices; zeros for nothing.

    One aggregation gives all but the median, and by a sketch two prices that the median is between: their ranks are
    a few ten-thousandths of the group apart. A second one counts what is below and, price by price, between them. Only
    prices between them are put in order, so no group of any size comes to one task.
    """
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    price = F.col("price").cast("double")
    near = [0.5 - 2 / ACCURACY, 0.5 + 2 / ACCURACY]
    whole = F.sum(F.col("price").cast("decimal(18,2)").cast("decimal(28,2)")).cast("double")
    facts = items.groupBy(*keys).agg(F.min("price").alias("min_price"), F.max("price").alias("max_price"), whole.alias("_sum"), F.count("price").alias("price_count"), F.percentile_approx(price, near, ACCURACY).alias("_near"))
    found = facts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_near")[0].alias("_low"), F.col("_near")[1].alias("_high"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    some = items.where("price is not null").join(found if keys else F.broadcast(found), same)  # without keys a row
    place = F.when(price < F.col("_low"), F.lit(None)).otherwise(price)  # all that is below together
    each = some.where(price <= F.col("_high")).groupBy(*keys, place.alias("_price")).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*keys).orderBy(F.col("_price").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = each.withColumn("_upto", F.sum("_n").over(upto))
    counts = facts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("price_count").alias("_all"))
    ranked = ranked.join(counts if keys else F.broadcast(counts), same)
    middle = lambda half: F.min(F.when((F.col("_upto") >= half) & F.col("_price").isNotNull(), F.col("_price")))
    medians = ranked.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(((middle(F.floor((F.col("_all") + 1) / 2)) + middle(F.ceil((F.col("_all") + 1) / 2))) / 2).alias("_median"))
    out = facts.join(medians if keys else F.broadcast(medians), same, "left")
    count = F.col("price_count")
    return out.select(*keys, zero(F.col("min_price")).alias("min_price"), zero(F.col("max_price")).alias("max_price"), zero(round_half_up(F.col("_sum") / F.nullif(count, F.lit(0)))).alias("mean_price"), zero(F.col("_median")).alias("median_price"), zero(round_half_up(F.col("_sum"))).alias("sum_price"), "price_count")
