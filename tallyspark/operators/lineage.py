"""Lineage as a flat table: a row for each source of each total, stored so that a product's sources are read without the others.

The table is partitioned by a hash of job and product and sorted within; a product's sources may fill many files, but are
never one row. Reports gather them, nothing else does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a table; 64 suit some gigabytes, and each should hold a few hundred megabytes.
BUCKETS = 64
KEYS = ("job_id", "product_key")


def bucket(job: Column, product: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(job.cast("string"), product.cast("string")), F.lit(buckets)).cast("int")


def source_refs(rows: DataFrame) -> DataFrame:
    """(job_id, product_key, page, row, unit, quantity) of every row with a product."""
    return rows.where("product_key is not null").select(*KEYS, "page", "row", "unit", F.col("quantity").cast("decimal(18,3)").alias("quantity"))


def write_refs(refs: DataFrame, path: str, buckets: int = BUCKETS, mode: str = "overwrite") -> None:
    """Writes ``source_refs`` as a table of so many buckets. Ranges go on through pages and rows, so that a product with many sources is dealt to many tasks."""
    placed = refs.withColumn("bucket", bucket(F.col("job_id"), F.col("product_key"), buckets))
    order = ["bucket", *KEYS, "page", "row"]
    placed.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).partitionBy("bucket").parquet(path)


def read_refs(spark: SparkSession, path: str) -> DataFrame:
    """All sources."""
    return spark.read.parquet(path).drop("bucket")


def refs_of(spark: SparkSession, path: str, job: str, product: str, buckets: int = BUCKETS) -> DataFrame:
    """The sources of one total, from its bucket alone."""
    place = bucket(F.lit(job), F.lit(product), buckets)
    return spark.read.parquet(path).where((F.col("bucket") == place) & (F.col("job_id") == job) & (F.col("product_key") == product)).drop("bucket")


def refs_of_totals(spark: SparkSession, path: str, totals: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The sources of some totals (job_id, product_key), which must not repeat; where those are few Spark reads their buckets only."""
    keys = totals.select(*KEYS, bucket(F.col("job_id"), F.col("product_key"), buckets).alias("bucket"))
    return spark.read.parquet(path).join(keys, ["bucket", *KEYS]).drop("bucket")


def gathered(refs: DataFrame) -> DataFrame:
    """(job_id, product_key, sources) for a report: the sources of each total in one array, in order."""
    return refs.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("page", "row", "unit", "quantity"))).alias("sources"))
