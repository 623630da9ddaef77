"""The products that a catalog starts with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schemas
from .readers import catalog_rows

#: Sku, barcode, name, brand, pack size and whether units may be picked.
PRODUCTS = [
    ("88135", "7290018813505", "לואקר אדום אגוז", "Loacker", 6, True),
    ("88136", "7290018813512", "לואקר צהוב", "Loacker", 6, True),
    ("88137", "7290018813529", "לואקר לבן", "Loacker", 6, True),
    ("88107", "7290018810758", "פראנוי פטל פינק", "Pranoy", 12, False),
    ("88108", "7290018810765", "פראנוי פטל חלב", "Pranoy", 12, False),
    ("88109", "7290018810772", "פראנוי פטל מריר", "Pranoy", 12, False),
]


def seed_products(spark: SparkSession) -> DataFrame:
    """A catalog as it is before anything is loaded, and again after a reset."""
    return catalog_rows(spark, PRODUCTS, schemas.SEED_PRODUCT)


#: The view that holds the session's catalog.
CURRENT = "tally_catalog"


def set_catalog(entries: DataFrame) -> None:
    """Makes ``entries`` the session's catalog."""
    entries.createOrReplaceTempView(CURRENT)


def get_catalog(spark: SparkSession) -> DataFrame:
    """The session's catalog; before any is set and after a reset, the one that a catalog starts with."""
    if not spark.catalog.tableExists(CURRENT):
        reset_catalog(spark)
    return spark.table(CURRENT)


def reset_catalog(spark: SparkSession) -> None:
    set_catalog(seed_products(spark))
