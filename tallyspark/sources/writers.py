"""Sinks: CSV, JSON, XLSX and HTML reports, stored results (``results``). Files of their own are streamed by the tasks that hold their rows (``workbooks``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import percent_text
from ..functions.text import or_text, source_codes
from .results import get_result as get_result
from .results import list_results as list_results
from .results import save_result as save_result
from .workbooks import SHEET_ROWS, lines_of, page_ends, sheet_pieces, table_pieces, write_files
from .workbooks import write_workbook as write_workbook

#: Columns of an exported catalog, of exported products and of a city's report.
CATALOG_COLUMNS = ("sku", "barcode", "name", "packSize", "allowUnits", "category", "supplier", "price")
PRODUCT_COLUMNS = ("sku", "barcode", "name", "quantity", "cases", "units", "confidence", "rowCount")
CITY_COLUMNS = ("product_key", "name", "cases", "units", "sources", "notes")


def catalog_csv_line(columns: tuple[str, ...] = CATALOG_COLUMNS) -> Column:
    """A catalog entry's line: null as empty, quoted only where there is a comma."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.concat_ws(",", *[F.when(x.contains(","), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(x) for x in shown])


def product_csv_line() -> Column:
    """A product's line: every value quoted, no barcode as N/A, confidence in percent."""
    shown = [or_text(F.col("barcode"), "N/A") if c == "barcode" else percent_text(F.col(c)) if c == "confidence" else F.coalesce(F.col(c).cast("string"), F.lit("")) for c in PRODUCT_COLUMNS]
    return F.concat_ws(",", *[F.concat(F.lit('"'), x, F.lit('"')) for x in shown])


def product_json() -> Column:
    return F.to_json(F.struct(*[percent_text(F.col(c)).alias(c) if c == "confidence" else F.col(c) for c in PRODUCT_COLUMNS]))


def warning_numbers(warnings: DataFrame) -> DataFrame:
    """One row: the warnings of a batch, counted."""
    return warnings.agg(F.count_if(F.col("type") == "unknown_sku").alias("unknown_sku"), F.count_if(F.col("type") == "ocr_warning").alias("ocr_warning"), F.count(F.lit(1)).alias("all"))


def document_pieces(batch: DataFrame, products: DataFrame, warnings: DataFrame, file: str, order: list) -> DataFrame:
    """Pieces of the nested JSON document of a batch: the fields of its one row, its products in order, its warning counts."""
    piece = lambda section, sheet, body: [F.lit(file).alias("file"), F.lit(section).alias("section"), sheet.cast("int").alias("sheet"), F.lit("").alias("name"), F.lit("").alias("head"), body.alias("body")]
    fields = F.to_json(F.struct(*batch.columns))
    start = batch.select(*piece("0", F.lit(0), F.concat(F.substr(fields, F.lit(1), F.length(fields) - 1), F.lit(',"products":['))))
    each = lines_of(products.select(*PRODUCT_COLUMNS), [], order).select("line", F.concat(F.when(F.col("line") > 0, ",").otherwise(""), F.to_json(F.struct(*PRODUCT_COLUMNS))).alias("j"))
    blocks = each.groupBy(F.floor(F.col("line") / SHEET_ROWS).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "j"))), lambda r: r["j"]), "").alias("j"))  # SHEET_ROWS each
    end = warning_numbers(warnings).select(*piece("2", F.lit(0), F.concat(F.lit('],"warnings":'), F.to_json(F.struct("*")), F.lit("}"))))
    return start.unionByName(blocks.select(*piece("1", F.col("block"), F.col("j")))).unionByName(end)


def write_document(batch: DataFrame, products: DataFrame, warnings: DataFrame, path: str, name: str, order: list | None = None) -> None:
    """The nested result of a batch as one JSON document of any size, ``name``.json in a folder, products in order of sku unless told otherwise."""
    write_files(document_pieces(batch, products, warnings, name, order or [F.asc("sku")]), path, ".json")


def write_result(batch: DataFrame, products: DataFrame, warnings: DataFrame, path: str) -> None:
    """The nested result of a batch as folders of JSON lines, of any size: batch with its warning counts, and products."""
    batch.crossJoin(warning_numbers(warnings).select(F.struct("*").alias("warnings"))).write.mode("overwrite").json(f"{path}/batch")  # single rows
    products.select(*PRODUCT_COLUMNS).write.mode("overwrite").json(f"{path}/products")


def write_sheets(sheets: dict[str, DataFrame], path: str) -> None:
    """Report sheets as folders of CSV files of any size, a folder for each."""
    for name, rows in sheets.items():
        raw_cells(rows).write.mode("overwrite").csv(f"{path}/{name.replace(' ', '_')}", header=True)


def city_report(totals: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the routes' sheets, summary) of totals by city_id, delivery_route and product_key with cases, units and sources, and names by product_key.

    A sheet row has key, name, cases, units, sources as text and notes; a route's sheet goes on in another after
    SHEET_ROWS rows. The summary has each city's totals.
    """
    note = F.array_join(F.array_compact(F.array(F.when(F.col("delivery_route") == "UNASSIGNED_ROUTE", "no route"), F.when((F.col("cases") == 0) & (F.col("units") == 0), "zero total"))), "; ")
    rows = totals.join(names.select("product_key", "name"), "product_key", "left").select("city_id", "delivery_route", "product_key", F.coalesce("name", F.lit("")).alias("name"), "cases", "units", source_codes(F.col("sources")).alias("sources"), note.alias("notes"))
    summary = totals.groupBy("city_id").agg(F.count_distinct("delivery_route").alias("routes"), F.count(F.lit(1)).alias("products"), F.sum("cases").alias("cases"), F.sum("units").alias("units"))
    return sheet_numbers(rows, ["city_id", "delivery_route"], ["product_key"]), summary


def write_city_report(totals: DataFrame, names: DataFrame, path: str) -> None:
    """``city_report`` as CSV: a folder for each city, route and sheet, and one for the summary, written by the tasks that hold them."""
    rows, summary = city_report(totals, names)
    rows.write.mode("overwrite").partitionBy("city_id", "delivery_route", "sheet").csv(f"{path}/routes", header=True)
    summary.write.mode("overwrite").csv(f"{path}/summary", header=True)


def _sections(rows: DataFrame, summary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and summaries of cities with their places in a city's report: the summary, then a section for each route."""
    route, city = F.coalesce("delivery_route", F.lit("")), F.coalesce("city_id", F.lit(""))
    ours = rows.withColumns({"_file": city, "_section": F.concat(F.lit("1"), route), "_title": route})
    return ours, summary.withColumns({"_file": city, "_section": F.lit("0"), "_title": F.lit("Summary")})


def write_city_workbooks(totals: DataFrame, names: DataFrame, path: str) -> None:
    """``city_report`` as workbooks: one for each city, with a summary sheet and a sheet for each route, which goes on in another after SHEET_ROWS rows."""
    rows, summary = _sections(*city_report(totals, names))
    pieces = sheet_pieces(rows, list(CITY_COLUMNS), [F.asc("product_key")])
    write_files(pieces.unionByName(sheet_pieces(summary, ["city_id", "routes", "products", "cases", "units"], [])), path, ".xlsx")


def write_city_pages(totals: DataFrame, names: DataFrame, path: str, job: str, stamp: str) -> None:
    """``city_report`` as HTML pages for printing: one for each city, with its name, time and job in the header, a table for each route and a footer."""
    rows, summary = _sections(*city_report(totals, names))
    ends = page_ends(summary.select(F.col("_file").alias("file")), F.col("file"), F.lit(f"{job}, {stamp}"))
    write_files(table_pieces(rows, list(CITY_COLUMNS), [F.asc("product_key")]).unionByName(table_pieces(summary, ["city_id", "routes", "products", "cases", "units"], [])).unionByName(ends), path, ".html")


def write_catalog_csv(entries: DataFrame, path: str) -> None:
    entries.select(*CATALOG_COLUMNS).write.mode("overwrite").csv(path, header=True)


def write_json(entries: DataFrame, path: str) -> None:
    entries.write.mode("overwrite").json(path)


def sheet_numbers(rows: DataFrame, group: list[str], order: list, limit: int = SHEET_ROWS) -> DataFrame:
    """``rows`` with ``sheet``, from 0: each group's rows in order, ``limit`` to a sheet."""
    ordered = [F.col(c) if isinstance(c, str) else c for c in order]
    return lines_of(rows, group, ordered, "_line").withColumn("sheet", F.floor(F.col("_line") / limit).cast("int")).drop("_line")


def raw_cells(rows: DataFrame) -> DataFrame:
    """Every column as a cell: null as empty, nested values as JSON."""
    nested = ("array", "map", "struct")
    return rows.select(*[F.coalesce(F.to_json(c) if kind.startswith(nested) else F.col(c).cast("string"), F.lit("")).alias(c) for c, kind in rows.dtypes])


def write_page(title: str, rows: DataFrame, path: str, name: str, order: list | None = None) -> None:
    """A report of any size as an HTML page for printing, ``name``.html in a folder; rows in the order that they have unless told otherwise."""
    named = rows.withColumns({"_file": F.lit(name), "_section": F.lit("1"), "_title": F.lit(title)})
    ends = page_ends(rows.sparkSession.range(1).select(F.lit(name).alias("file")), F.lit(title), F.lit(""))
    write_files(table_pieces(named, rows.columns, order or []).unionByName(ends), path, ".html")
