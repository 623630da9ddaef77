"""Catalog operators: lookups, validation, upserts, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import or_text

def last_wins(entries: DataFrame, key: str = "sku", seq: str = "load_seq") -> DataFrame:
    """One entry for each key, the one loaded last."""
    rest = [c for c in entries.columns if c != key]
    return entries.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_last")).select(key, "_last.*")


def first_by_barcode(entries: DataFrame, seq: str = "load_seq") -> DataFrame:
    """One entry for each barcode, the one loaded first."""
    rest = [c for c in entries.columns if c != "barcode"]
    return entries.where("barcode is not null and barcode <> ''").groupBy("barcode").agg(F.min_by(F.struct(*rest), F.col(seq)).alias("_first")).select("barcode", "_first.*")


def by_sku(catalog: DataFrame, sku: str) -> DataFrame:
    return catalog.where(F.col("sku") == sku)


def search_by_name(catalog: DataFrame, query: str) -> DataFrame:
    """Entries whose name holds ``query``, in any case; % and _ mean themselves."""
    return catalog.where(F.contains(F.lower("name"), F.lower(F.lit(query))))


def search_equal(catalog: DataFrame, column: str, value) -> DataFrame:
    return catalog.where(F.col(column) == value)


def search_by_barcode(catalog: DataFrame, barcode: str) -> DataFrame:
    """The first loaded entry of the barcode, or none."""
    return first_by_barcode(catalog.where(F.col("barcode") == barcode))


def without(catalog: DataFrame, *skus: str) -> DataFrame:
    return catalog.where(~F.col("sku").isin(*skus)) if skus else catalog


def entry_errors() -> Column:
    """What a full validation finds wrong with an entry."""
    return F.array_compact(F.array(
        F.when(or_text(F.col("sku"), None).isNull(), "Missing SKU"),
        F.when(or_text(F.col("name"), None).isNull(), "Missing name"),
        F.when(F.col("packSize").isNull() | (F.col("packSize") <= 0), "Invalid pack size"),
        F.when(~F.coalesce(or_text(F.col("barcode"), "0").rlike(r"\A[0-9]+\z"), F.lit(True)), "Invalid barcode"),
    ))


def can_be_added() -> Column:
    """The weaker check on adding: a missing pack size passes."""
    return or_text(F.col("sku"), None).isNotNull() & or_text(F.col("name"), None).isNotNull() & (F.col("packSize").isNull() | (F.col("packSize") > 0))


def entry_problem() -> Column:
    """The first reason why an entry can't be added, null if it can."""
    return F.when(or_text(F.col("sku"), None).isNull(), "Missing SKU").when(or_text(F.col("name"), None).isNull(), "Missing name").when(F.col("packSize") <= 0, "Invalid pack size")


def validated(entries: DataFrame) -> DataFrame:
    """``entries`` with ``errors``; rows without any can be imported."""
    return entries.withColumn("errors", entry_errors())


def merged(left: DataFrame, right: DataFrame, key: str = "sku") -> DataFrame:
    """Entries of both, field by field: the right one's where it has a value, else the left one's. Fields that only one side has are kept."""
    theirs = right.select(key, *[F.col(c).alias(f"_new_{c}") for c in right.columns if c != key])
    fields = [*[c for c in left.columns if c != key], *[c for c in right.columns if c not in left.columns]]
    value = lambda c: F.col(c) if c not in right.columns else F.col(f"_new_{c}") if c not in left.columns else F.coalesce(f"_new_{c}", c)
    return left.join(theirs, key, "full_outer").select(key, *[value(c).alias(c) for c in fields])


upserted = merged


def enrich(rows: DataFrame, catalog: DataFrame, known: str | None = None) -> DataFrame:
    """``rows`` with name and barcode of the catalog where it knows the sku, and the quantity as units or cases, as it says; unknown skus keep their text and count neither. ``known`` names a column that tells whether it knows it."""
    facts = catalog.select("sku", F.col("name").alias("_name"), F.col("barcode").alias("_barcode"), F.col("allowUnits").alias("_units"), F.lit(True).alias("_known"))
    found = rows.join(facts, "sku", "left")
    none = F.lit(0).cast("decimal(18,3)")
    flag = {known: F.coalesce("_known", F.lit(False))} if known else {}
    return found.withColumns({
        **flag,
        "name": F.when(F.col("_known"), F.col("_name")).otherwise(F.col("name")),
        "barcode": F.when(F.col("_known"), F.col("_barcode")).otherwise(F.col("barcode")),
        "units": F.when(F.col("_known") & F.col("_units"), F.col("quantity")).otherwise(none),
        "cases": F.when(F.col("_known") & ~F.coalesce("_units", F.lit(False)), F.col("quantity")).otherwise(none),
    }).drop("_name", "_barcode", "_units", "_known")


def unknown(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows whose sku the catalog lacks."""
    return rows.join(catalog.select("sku"), "sku", "left_anti")


def with_default(rows: DataFrame, catalog: DataFrame, column: str, default: str) -> DataFrame:
    """``rows`` with a catalog column by sku, the default where it is unknown or empty."""
    return rows.join(catalog.select("sku", F.col(column).alias("_found")), "sku", "left").withColumn(column, or_text(F.col("_found"), default)).drop("_found")


def statistics(catalog: DataFrame) -> DataFrame:
    """One row: products, distinct categories, suppliers and brands, unit and case products, pack sizes in order."""
    count = lambda c: F.count_distinct(F.nullif(F.col(c), F.lit("")))
    some = [count(c).alias(n) for c, n in (("category", "categories"), ("supplier", "suppliers"), ("brand", "brands")) if c in catalog.columns]
    return catalog.agg(F.count(F.lit(1)).alias("products"), *some, F.count_if("allowUnits").alias("unit_products"), F.count_if(~F.col("allowUnits")).alias("case_products"), F.array_sort(F.collect_set("packSize")).alias("pack_sizes"))


def counts_by(catalog: DataFrame, column: str) -> DataFrame:
    """Products of each value, blanks left out."""
    return catalog.where(or_text(F.col(column), None).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("products"))


def values_of(catalog: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column, blanks left out, in code unit order."""
    return catalog.where(or_text(F.col(column), None).isNotNull()).select(column).distinct().orderBy(column)


def resolved(rows: DataFrame, products: DataFrame) -> DataFrame:
    """``rows`` with ``product_key`` and ``resolved_by``: barcode, else sku, else normalised name, else alias.

    A row with a barcode resolves by it or not at all, and one with a sku likewise. A key that several products
    claim goes to the one loaded first. So each row asks for one key of one kind, and one join with the table of all
    keys answers; rows that ask for nothing are spread by a hash, as no key can meet them. Rows pass by a hash table of
    their task's keys and are never sorted: they shrink so much in a shuffle that Spark gives a task many of them, and a
    name may be asked for by any number, but each key is in the table once.
    """
    from ..functions.text import normalize_field

    key = lambda kind, tier, value: F.struct(F.lit(kind).alias("_kind"), value.alias("_key"), F.lit(("barcode", "sku", "name", "alias").index(tier)).alias("_tier"), F.lit(tier).alias("_by"))
    aliases = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: key("hint", "alias", normalize_field(a)))
    own = F.array(key("barcode", "barcode", F.col("barcode")), key("sku", "sku", F.col("sku")), key("hint", "name", normalize_field(F.col("name"))))
    keys = products.select("load_seq", "product_key", F.explode(F.concat(own, aliases)).alias("_k")).select("load_seq", "product_key", "_k.*").where("_key <> ''")
    table = keys.groupBy("_kind", "_key").agg(F.min_by(F.struct("product_key", "_by"), F.struct("_tier", "load_seq", "product_key")).alias("_found"))
    barcode, sku = (F.nullif(F.col(c), F.lit("")) for c in ("barcode", "sku"))
    hint = F.nullif(normalize_field(F.col("product_hint")), F.lit(""))
    kind = F.when(barcode.isNotNull(), "barcode").when(sku.isNotNull(), "sku").when(hint.isNotNull(), "hint").otherwise("none")
    nothing = F.xxhash64(*[F.col(c).cast("string") for c, t in rows.dtypes if not t.startswith(("map", "array", "struct"))]).cast("string")
    asked = rows.drop("product_key", "resolved_by").withColumns({"_kind": kind, "_key": F.coalesce(barcode, sku, hint, nothing)})
    found = asked.join(table.hint("shuffle_hash"), ["_kind", "_key"], "left")
    return found.withColumns({"product_key": F.col("_found.product_key"), "resolved_by": F.col("_found._by")}).drop("_kind", "_key", "_found")


def first_seen(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
