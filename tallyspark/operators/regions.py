"""Layout-driven parsing: words of a line by their position on the page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: The standard page is 1200 wide; regions of a picking list and their edges. Both languages share them.
PAGE_WIDTH = 1200
REGIONS = (("sku", 60, 120), ("productName", 250, 700), ("barcode", 720, 900), ("quantity", 980, 1040))
LAYOUTS = {"hebrew_standard": ("he", REGIONS), "english_standard": ("en", REGIONS)}


def layout(name: str) -> tuple:
    if name not in LAYOUTS:
        raise KeyError(f"no layout {name}")
    return LAYOUTS[name][1]


def layout_by_language(language: str) -> tuple:
    return next(regions for spoken, regions in LAYOUTS.values() if spoken == language)


def words_between(line: Column, low: float, high: float, width: float = PAGE_WIDTH) -> Column:
    """The words of a line that overlap the region, joined by spaces.

    A word's place runs on by its length and one for the gap, however wide the gap is, over the length of the
    line: so wide gaps shift what follows to the left.
    """
    words = F.filter(F.split(line, f"{T.WS}+"), lambda w: w != "")
    lead = F.when(line.rlike(rf"\A{T.WS}"), 1).otherwise(0)
    first = F.struct(lead.alias("at"), F.array().cast("array<string>").alias("hit"))
    size = F.length(line).cast("double")

    def step(state: Column, word: Column) -> Column:
        start, end = state["at"] / size, (state["at"] + F.length(word)) / size
        inside = (start < high / width) & (end > low / width)
        return F.struct((state["at"] + F.length(word) + 1).alias("at"), F.when(inside, F.concat(state["hit"], F.array(word))).otherwise(state["hit"]).alias("hit"))

    return F.aggregate(words, first, step, lambda state: F.array_join(state["hit"], " "))


def region_texts(line: Column, regions: tuple = REGIONS, width: float = PAGE_WIDTH) -> dict[str, Column]:
    return {name: words_between(line, low, high, width) for name, low, high in regions}


def extract_regions(pages: DataFrame, regions: tuple = REGIONS, width: float = PAGE_WIDTH, text: str = "text") -> DataFrame:
    """``pages`` with ``regions``: for each region its name, the words of all lines that are not blank, joined by spaces, and the text's confidence."""
    kept = F.filter(F.split(text, "\n"), lambda x: T.trim(x) != "")

    def one(name: str, low: int, high: int) -> Column:
        hits = F.filter(F.transform(kept, lambda x: words_between(x, low, high, width)), lambda x: x != "")
        joined = F.array_join(hits, " ")
        return F.struct(F.lit(name).alias("name"), joined.alias("text"), T.text_confidence(joined).alias("confidence"))

    return pages.withColumn("regions", F.array(*[one(*r) for r in regions]))


def region_by_name(regions: Column, name: str) -> Column:
    return F.get(F.filter(regions, lambda r: r["name"] == name), F.lit(0))


def region_issues(regions: Column) -> Column:
    """Names of required regions without text, and of regions under half confidence."""
    empty = [F.when(F.coalesce(region_by_name(regions, n)["text"], F.lit("")) == "", F.lit(f"Missing {n}")) for n in ("sku", "productName", "quantity")]
    weak = F.transform(F.filter(regions, lambda r: r["confidence"] < 0.5), lambda r: F.concat(F.lit("Low confidence: "), r["name"]))
    return F.concat(F.array_compact(F.array(*empty)), weak)


def parse_layout(rows: DataFrame, regions: tuple = REGIONS, width: float = PAGE_WIDTH, normalize: bool = True) -> DataFrame:
    """Lines as rows of a picking list: those whose sku region holds something, cleaned; confidence is the sku region's, 0.8 if that is 0."""
    found = region_texts(F.col("line"), regions, width)
    clean = T.normalize_hebrew if normalize else (lambda x: x)
    sku = T.clean_sku(clean(found["sku"]))
    confidence = T.text_confidence(found["sku"])
    name = clean(found["productName"])
    return rows.withColumns({
        "sku": sku,
        "product_name": name,
        "barcode": T.clean_barcode(found["barcode"]) if "barcode" in found else F.lit(""),
        "quantity": T.clean_quantity(found["quantity"]).try_cast("decimal(18,3)"),
        "unit": F.lit("units"),
        "confidence": F.when(confidence == 0, 0.8).otherwise(confidence),
        "language": T.language_mix(name),
        "status": F.lit("Pending"),
    }).where("sku <> ''")


def display_line() -> Column:
    """A parsed row as a line of text for people, in Hebrew."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    amount = F.regexp_replace(F.regexp_replace(shown("quantity"), r"(\.[0-9]*?)0+\z", "$1"), r"\.\z", "")
    return F.concat(F.lit('מק"ט: '), shown("sku"), F.lit(" | שם: "), shown("product_name"), F.lit(" | כמות: "), amount)


def row_issues() -> Column:
    """What is wrong with a parsed row: no sku, no name, no positive quantity, confidence under half."""
    return F.array_compact(F.array(
        F.when(T.or_text(F.col("sku"), None).isNull(), "missing_sku"),
        F.when(T.or_text(F.col("product_name"), None).isNull(), "missing_name"),
        F.when(~F.coalesce(F.col("quantity") > 0, F.lit(False)), "invalid_quantity"),
        F.when(F.col("confidence") < 0.5, "low_confidence"),
    ))
