"""Text to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .catalog import enrich


def lines(pages: DataFrame, text: str = "text") -> DataFrame:
    """A row for each line of ``text``, with ``row`` from 1; other columns stay."""
    kept = [c for c in pages.columns if c != text]
    return pages.select(*kept, F.posexplode(F.split(text, "\n")).alias("_at", "line")).select(*kept, (F.col("_at") + 1).alias("row"), "line")


def line_fields(rows: DataFrame) -> DataFrame:
    """``rows`` of lines with sku (5 digits), barcode (13 digits) and the trailing quantity.

    They are unpacked from an array of one element, so that each pattern is matched once for a line, whatever filters
    and columns use its result.
    """
    found = F.struct(T.whole_number(F.col("line"), 5).alias("sku"), T.whole_number(F.col("line"), 13).alias("barcode"), T.trailing_quantity(F.col("line")).alias("quantity"))
    return rows.select(*[c for c in rows.columns if c not in ("sku", "barcode", "quantity")], F.inline(F.array(found)))


def _found(rows: DataFrame, invoice: Column | str = "") -> DataFrame:
    rows = rows if "invoice" in rows.columns else rows.withColumn("invoice", F.lit(invoice) if isinstance(invoice, str) else invoice)
    return rows.where((F.col("sku") != "") & (F.col("barcode") != "")).withColumnRenamed("line", "name")


def parse_table(pages: DataFrame, catalog: DataFrame, text: str = "text") -> DataFrame:
    """Lines with both a sku and a barcode, enriched from the catalog; a line without a quantity has 0."""
    return enrich(_found(line_fields(lines(pages, text))), catalog)


def parse_with_tracking(pages: DataFrame, catalog: DataFrame, allow_negative: bool = False, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, rows whose sku the catalog lacks): like parse_table without zero quantities, and without negative ones unless allowed."""
    rows = _found(line_fields(lines(pages, text))).where(F.col("quantity") > 0 if not allow_negative else F.col("quantity") != 0)
    found = enrich(rows, catalog, known="_in_catalog")
    return found.drop("_in_catalog"), found.where(~F.col("_in_catalog")).drop("_in_catalog")


def parse_with_validation(pages: DataFrame, catalog: DataFrame, allow_negative: bool = False, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(valid rows, errors by line): the first of no sku, no barcode, zero and negative quantity; blank lines are passed over."""
    checked = line_fields(lines(pages, text)).where(~T.is_blank(F.col("line")))
    error = F.when(F.col("sku") == "", "No valid SKU found (5 digits)").when(F.col("barcode") == "", "No valid barcode found (13 digits)").when(F.col("quantity") == 0, "Quantity is 0")
    if not allow_negative:
        shown = F.regexp_replace(F.regexp_replace(F.col("quantity").cast("string"), r"(\.[0-9]*?)0+\z", "$1"), r"\.\z", "")
        error = error.when(F.col("quantity") < 0, F.concat(F.lit("Negative quantity ("), shown, F.lit(")")))
    checked = checked.withColumn("error", F.concat(F.lit("Line "), F.col("row").cast("string"), F.lit(": "), error))
    wrong = (F.col("sku") == "") | (F.col("barcode") == "") | (F.col("quantity") == 0)
    wrong = wrong if allow_negative else wrong | (F.col("quantity") < 0)
    return enrich(_found(checked.where(~wrong).drop("error")), catalog), checked.where(wrong)


def split_tables(pages: DataFrame, delimiter: str = "---", text: str = "text") -> DataFrame:
    """A row for each table of a text, with ``table`` from 0."""
    kept = [c for c in pages.columns if c != text]
    quoted = "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return pages.select(*kept, F.posexplode(F.split(text, quoted)).alias("table", text))


def parse_multiple_tables(pages: DataFrame, catalog: DataFrame, delimiter: str = "---", text: str = "text") -> DataFrame:
    return parse_table(split_tables(pages, delimiter, text), catalog, text)


def after_header(pages: DataFrame, header: str, text: str = "text") -> DataFrame:
    """Texts from behind the first match of ``header`` on; a text without a match stays whole."""
    # cut once, at the first match: what is behind it stands in the second part
    parts = F.split(F.col(text), header, 2)
    return pages.withColumn(text, F.coalesce(F.try_element_at(parts, F.lit(2)), F.col(text)))


def parse_structured(pages: DataFrame, catalog: DataFrame, header: str | None = None, text: str = "text") -> DataFrame:
    return parse_table(after_header(pages, header, text) if header else pages, catalog, text)


def spec_fields(rows: DataFrame, sku_pattern: str = "[A-Z]{2}[0-9]{4,6}") -> DataFrame:
    """Fields in the form of the specification: barcode of 8, 12 or 13 digits, a sku only without one, one quantity, and the rest as product hint.

    The quantity is the last number that isn't the key, never split; with more than one such number the
    column is ambiguous and ``issue`` says so.
    """
    line = F.col("line")
    barcode = F.regexp_extract(line, f"{T.EDGE_LEFT}([0-9]{{13}}|[0-9]{{12}}|[0-9]{{8}}){T.EDGE_RIGHT}", 1)
    sku = F.when(barcode == "", F.regexp_extract(line, f"{T.EDGE_LEFT}({sku_pattern}){T.EDGE_RIGHT}", 1)).otherwise("")
    key = F.when(barcode != "", barcode).otherwise(sku)
    rest = F.when(key != "", F.regexp_replace(line, F.concat(F.lit(T.EDGE_LEFT), key, F.lit(T.EDGE_RIGHT)), " ")).otherwise(line)
    free = rf"(?<![^\s])(-?[0-9]+(?:\.[0-9]+)?)(?![^\s])"  # noqa: F541
    numbers = F.regexp_extract_all(rest, F.lit(free), F.lit(1))
    quantity = F.try_element_at(numbers, F.lit(-1)).try_cast("decimal(18,3)")
    hint = T.normalize_field(F.regexp_replace(rest, free, " "))
    pack = F.coalesce(F.nullif(F.regexp_extract(line, r"\(([0-9]+)\)", 1), F.lit("")), F.nullif(F.regexp_extract(line, r"1/([0-9]+)", 1), F.lit(""))).try_cast("int")
    return rows.withColumns({"barcode": F.nullif(barcode, F.lit("")), "sku": F.nullif(sku, F.lit("")), "quantity": quantity, "product_hint": hint, "pack_size_hint": pack, "issue": F.when(F.size(numbers) > 1, "AMBIGUOUS_QUANTITY_COLUMN")})


def picking_lines(rows: DataFrame) -> DataFrame:
    """``SKU name quantity cases|units`` lines: sku with scanned letters fixed, name, quantity, unit (null if not said)."""
    pattern = r"^\s*(\S+)\s+(.+?)\s+(-?\d+(?:\.\d+)?)\s*(cases?|units?)?\s*$"
    part = lambda i: F.regexp_extract("line", pattern, i)
    unit = F.when(part(4).startswith("case"), "case").when(part(4).startswith("unit"), "unit")
    return rows.where(F.col("line").rlike(pattern)).select("*", T.correct_sku(part(1)).alias("sku"), part(2).alias("name"), part(3).try_cast("decimal(18,3)").alias("quantity"), unit.alias("unit"))


def right_to_left(rows: DataFrame) -> DataFrame:
    """Hebrew lines in reading order, the scanned line kept as ``raw_text``."""
    return rows.withColumn("raw_text", F.col("line")).withColumn("line", T.reading_order(F.col("line")))
