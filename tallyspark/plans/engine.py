"""Pipelines: text to summary, and rows with lineage to totals, places and reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import or_text
from ..operators import catalog as C
from ..operators import ordering, parse, places, rollups, rules, totals
from ..services import Services


def process(pages: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, summary by sku) of pages of text."""
    rows = parse.parse_table(pages, catalog)
    return rows, rollups.summarize(rows, ["job_id", "page", "row"] if {"job_id", "page", "row"} <= set(rows.columns) else None)


@dataclass
class BatchResult:
    """What a batch comes to."""

    batch: DataFrame
    products: DataFrame
    rows: DataFrame
    warnings: DataFrame


def batch(pages: DataFrame, catalog: DataFrame, rule_list: list) -> BatchResult:
    """Picking text to products: lines parsed and corrected, matched to catalog and name rules, quantities put to cases or units.

    Products come in sku order.
    """
    lines = parse.picking_lines(parse.lines(pages))
    facts = catalog.select("sku", F.col("name").alias("_name"), "barcode", F.col("allowUnits").alias("product_allows"))
    rows = lines.join(facts, "sku", "left").withColumn("name", F.coalesce("_name", "name")).drop("_name")
    rows = rules.match_names(rows, rule_list).withColumn("rule_allows", F.coalesce("rule_allows", "product_allows"))
    rows = totals.calculated(rows).withColumn("confidence", F.when(F.col("product_allows").isNull(), 0.5).otherwise(1.0))
    warned = rows.where(F.size("warnings") > 0).select(F.xxhash64("job_id", "page", "row").alias("seq"), F.when(F.col("product_allows").isNull(), "unknown_sku").otherwise("ocr_warning").alias("type"), F.when(F.col("product_allows").isNull(), "error").otherwise("warning").alias("severity"), F.concat(F.lit("sku "), "sku").alias("message"))
    products = rollups.product_rows(rows).orderBy(*ordering.by_sku())
    return BatchResult(rollups.batch_statistics(rows.withColumn("warned", F.size("warnings") > 0)), products, rows, warned)


def sheets(result: BatchResult, catalog: DataFrame) -> dict[str, DataFrame]:
    """The eight report sheets of a batch."""
    facts = result.products.select("sku", "barcode", "name", "quantity", "cases", "units", "confidence", "rowCount", F.array_join("warnings", "; ").alias("warnings"))
    known = facts.join(catalog.select("sku", "category", "supplier", "packSize"), "sku", "left")
    named = known.withColumns({c: or_text(F.col(c).cast("string"), "N/A") for c in ("category", "supplier", "packSize")})
    group = lambda c, default: rollups.with_totals(facts.join(catalog.select("sku", F.col(c).alias("_g")), "sku", "left").withColumn(c, or_text(F.col("_g"), default)), c, "sku")
    levels = facts.withColumn("status", rollups.status(F.col("confidence")))
    summary = result.batch.select(F.expr("stack(9, " + ", ".join(f"'{c}', cast({c} as string)" for c in result.batch.columns) + ") as (item, value)"))
    return {
        "Summary": summary,
        "Products": facts,
        "By Product": named.orderBy(*ordering.by_sku()),
        "By Category": group("category", "Uncategorized"),
        "By Supplier": group("supplier", "No Supplier"),
        "By Status": rollups.with_totals(levels, "status", "sku"),
        "Warnings": rollups.warning_groups(result.warnings),
        "Raw Data": result.rows,
    }


def stats(catalog: DataFrame) -> dict[str, DataFrame]:
    """What a catalog holds: statistics, its categories and its suppliers."""
    return {"statistics": C.statistics(catalog), "categories": C.values_of(catalog, "category"), "suppliers": C.values_of(catalog, "supplier")}


def lineage(rows: DataFrame, products: DataFrame, cities: DataFrame, routes: DataFrame) -> dict[str, DataFrame]:
    """Rows with lineage through resolution, rules, totals by page and job, and places; rows that a rule fails wait in ``queue``."""
    found = C.resolved(rows, products)
    facts = products.select("product_key", "name", F.col("allowUnitPicking").alias("allow_unit_picking"), F.col("caseOnly").alias("case_only"))
    checked = rules.row_checks(found.join(facts, "product_key", "left"))
    forced = checked.withColumn("unit", F.when(F.col("case_only"), "case").otherwise(F.coalesce("unit", rules.unit_type(F.col("name"), F.col("case_only")))))
    go = forced.where(F.col("gate") != "queue")
    pages = totals.page_totals(go)
    placed = places.assigned(go, cities, routes)
    amount = lambda kind: F.when(F.col("unit") == kind, F.col("quantity")).otherwise(0).cast("decimal(18,3)")
    return {
        "queue": forced.where(F.col("gate") == "queue"),
        "review": forced.where(F.col("gate") == "review"),
        "pages": pages,
        "jobs": totals.job_totals(pages),
        "cities": places.city_route_totals(placed.withColumns({"cases": amount("case"), "units": amount("unit")})),
        "unassigned": places.unassigned(placed),
    }


class LineParser:
    """Picking lines of pages."""

    def parse(self, pages: DataFrame) -> DataFrame:
        return parse.picking_lines(parse.lines(pages))


class CatalogResolver:
    """Facts of the catalog by sku; rows that it lacks keep their name."""

    def resolve(self, rows: DataFrame, products: DataFrame) -> DataFrame:
        facts = products.select("sku", F.col("name").alias("_name"), F.col("allowUnits").alias("product_allows"))
        return rows.join(facts, "sku", "left").withColumns({"name": F.coalesce("_name", "name"), "rule_allows": F.col("product_allows"), "product_key": F.when(F.col("_name").isNotNull(), F.col("sku"))}).drop("_name")


class KnownQuantities:
    """Leaves out rows without a product or with a quantity below 0."""

    def validate(self, rows: DataFrame) -> DataFrame:
        return rows.where("product_key is not null and quantity >= 0")


class CasesAndUnits:
    """Quantities as cases or units."""

    def calculate(self, rows: DataFrame) -> DataFrame:
        return totals.calculated(rows)


class ProductTotals:
    """Totals of each product."""

    def aggregate(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("product_key").agg(rollups.total("cases").alias("cases"), rollups.total("units").alias("units"), F.count(F.lit(1)).alias("row_count"))


def standard_services() -> Services:
    """The stages as this library has them."""
    return Services(LineParser(), CatalogResolver(), KnownQuantities(), CasesAndUnits(), ProductTotals())
