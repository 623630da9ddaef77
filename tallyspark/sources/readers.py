"""Scans: catalogs, pages and uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..operators.catalog import entry_problem

#: File types that an upload may have.
UPLOAD_TYPES = ("application/pdf", "image/jpeg", "image/png", "image/webp")


def catalog_json(spark: SparkSession, path: str, schema: str = schemas.CATALOG) -> DataFrame:
    """A JSON array of entries; ``load_seq`` keeps the file's order."""
    return in_file_order(spark.read.schema(schema).option("multiLine", True).json(path))


def catalog_rows(spark: SparkSession, rows: list, schema: str = schemas.CATALOG) -> DataFrame:
    return numbered(spark.createDataFrame(rows, schema))


def catalog_csv(spark: SparkSession, path: str, schema: str = schemas.CATALOG) -> DataFrame:
    """A CSV with a header. Keys stay text, so leading zeros are kept."""
    return in_file_order(spark.read.schema(schema).csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True))


def numbered(entries: DataFrame) -> DataFrame:
    """Rows of a list, numbered in its order."""
    return entries.withColumn("load_seq", F.monotonically_increasing_id())


def in_file_order(entries: DataFrame) -> DataFrame:
    """Rows of files with ``load_seq``: files by path, a file's blocks by place, then rows as they stand.

    Spark reads blocks in an order of its own, but a block's rows in a row; so blocks are ranked, a row for each.
    """
    found = entries.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"))
    blocks = found.select("_file", "_start").distinct().withColumn("_block", F.row_number().over(Window.orderBy("_file", "_start")).cast("long"))
    return found.join(blocks, ["_file", "_start"]).select(*entries.columns, (F.col("_block") * F.lit(1 << 33) + F.col("_row")).alias("load_seq"))


def loaded(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries that a catalog takes, entries passed over with ``problem``): a sku, a name and no pack size below 1 are needed."""
    found = entries.withColumn("problem", entry_problem())
    return found.where("problem is null").drop("problem"), found.where("problem is not null")


def versioned(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """A versioned catalog: one object with a version and a list under ``field``."""
    rows = spark.read.schema(f"version STRING, `{field}` ARRAY<STRUCT<{_struct(schema)}>>").option("multiLine", True).json(path)
    return rows.select("version", F.posexplode(field).alias("load_seq", "item")).select("version", F.col("load_seq").cast("long").alias("load_seq"), "item.*")


def _struct(schema: str) -> str:
    import re

    return re.sub(r"(^|, )(\w+) (?=[A-Z])", r"\1\2: ", schema)


def highest_version(catalogs: DataFrame) -> DataFrame:
    """Rows of the highest dotted version."""
    key = F.transform(F.split("version", r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    top = catalogs.agg(F.max(key).alias("_top"))
    return catalogs.join(F.broadcast(top), key == F.col("_top"), "left_semi")  # one row


def text_pages(spark: SparkSession, path: str) -> DataFrame:
    """(job_id, page, text): a file is a page; the job is its folder, pages count in file name order within it."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    job = F.element_at(F.split("file", "/"), -2)
    return files.select(job.alias("job_id"), F.row_number().over(Window.partitionBy(job).orderBy("file")).alias("page"), "text")


def images(spark: SparkSession, path: str) -> DataFrame:
    """Bytes of scanned files with their type; reading pixels is left to a function of the caller's."""
    rows = spark.read.format("binaryFile").load(path)
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in (("pdf", "application/pdf"), ("jpg", "image/jpeg"), ("jpeg", "image/jpeg"), ("png", "image/png"), ("webp", "image/webp")) for x in pair]), F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)))
    return rows.withColumn("mime", kind)


def accepted_uploads(files: DataFrame, mime: str = "mime") -> DataFrame:
    """``files`` with ``accepted``: whether the type is one that can be read."""
    return files.withColumn("accepted", F.coalesce(F.col(mime).isin(*UPLOAD_TYPES), F.lit(False)))
