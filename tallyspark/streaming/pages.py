"""Page totals kept up to date as pages arrive.

Totals of pages and jobs are sums, so the same operators run in update mode; lineage stays in the flat rows. Pages that can
be sent again go through a state for each page: a newer version takes back what the older one stood for, so the rows that are
appended, each with a sign, always add up to the latest versions, and nothing that was written is written again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import schemas
from ..operators import parse
from ..operators.rollups import total


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """Pages (job_id, page, text) from JSON files as they arrive."""
    return spark.readStream.schema(schemas.PAGE).json(path)


def running_totals(pages: DataFrame, catalog: DataFrame) -> DataFrame:
    """Quantity, units and cases of each sku so far; a stream joined with a static catalog."""
    rows = parse.parse_table(pages, catalog)
    return rows.groupBy("sku").agg(total("quantity").alias("total_quantity"), total("units").alias("total_units"), total("cases").alias("total_cases"), F.count(F.lit(1)).alias("row_count"))


def start(totals: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs what has arrived, writes the totals so far to a table of their own for each batch, and stops; a later start goes on from the checkpoint.

    A batch that is run again writes its table again.
    """
    write = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{path}/batch={batch:020d}")
    return totals.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The totals that the last batch wrote."""
    rows = spark.read.parquet(path)
    return rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0]).drop("batch")


def append_rows(pages: DataFrame, catalog: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends parsed rows as Parquet; exactly once through the sink's log."""
    return parse.parse_table(pages, catalog).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Pages that may be sent again: of one page the highest version counts, of equal versions the greatest text.
VERSIONED_PAGE = schemas.PAGE + ", version BIGINT"
SIGNED_PAGE = schemas.PAGE + ", sign INT"
#: States that pages share by a hash of job and page, fixed for a checkpoint; a batch rewrites those that its pages meet.
STATES = 1 << 16
HELD = "jobs ARRAY<STRING>, pages ARRAY<INT>, versions ARRAY<BIGINT>, texts ARRAY<STRING>"


def arriving_versions(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """Pages (VERSIONED_PAGE) from JSON files as they arrive, so many files in a batch."""
    read = spark.readStream.schema(VERSIONED_PAGE)
    return (read.option("maxFilesPerTrigger", files) if files else read).json(path)


def signed_pages(pages: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """Pages with a sign: 1 for a version that counts from now on, -1 for the one that it replaces.

    Versions that come late, and those that come again, change nothing. States hold the text of each page's latest version, those of some
    pages in each, so that Python isn't called for every page; with ``keep_ms`` a page has a state of its own, which is forgotten when nothing
    was sent for so long, and what is sent later counts as a new page; such a stream
    runs on until it is stopped, as it waits for times and not for pages.
    """

    def latest_version(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else None
        best = max(((int(v), t) for b in batches for v, t in zip(b["version"], b["text"], strict=True)), default=held)
        if keep_ms:
            state.setTimeoutDuration(keep_ms)
        if best is None or (held is not None and best <= tuple(held)):
            return
        state.update(best)
        out = [(*key, best[1], 1)] if held is None else [(*key, held[1], -1), (*key, best[1], 1)]
        yield pd.DataFrame(out, columns=["job_id", "page", "text", "sign"])

    wait = GroupStateTimeout.ProcessingTimeTimeout if keep_ms else GroupStateTimeout.NoTimeout
    named = pages.where("job_id is not null and page is not null").select("job_id", "page", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("version", F.lit(0)).alias("version"))
    if keep_ms:
        return named.groupBy("job_id", "page").applyInPandasWithState(latest_version, SIGNED_PAGE, "version BIGINT, text STRING", "append", wait)

    def latest_versions(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {(j, p): (v, t) for j, p, v, t in zip(*state.get, strict=True)} if state.exists else {}
        best: dict = {}
        for b in batches:
            for j, p, t, v in zip(b["job_id"].tolist(), b["page"].tolist(), b["text"].tolist(), b["version"].tolist(), strict=True):
                if (old := best.get((j, p))) is None or (v, t) > old:
                    best[j, p] = v, t
        out = []
        for key, new in best.items():
            old = held.get(key)
            if old is not None and new <= old:
                continue
            if old is not None:
                out.append((*key, old[1], -1))
            out.append((*key, new[1], 1))
            held[key] = new
        if out:
            state.update(([j for j, _ in held], [p for _, p in held], [v for v, _ in held.values()], [t for _, t in held.values()]))
            yield pd.DataFrame(out, columns=["job_id", "page", "text", "sign"])

    shared = named.withColumn("state", F.pmod(F.xxhash64("job_id", "page"), F.lit(STATES)).cast("int"))
    return shared.groupBy("state").applyInPandasWithState(latest_versions, SIGNED_PAGE, HELD, "append", wait)


def append_signed(pages: DataFrame, catalog: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the parsed rows of ``signed_pages`` with their sign as Parquet, for all that has arrived; exactly once through the sink's log, and a later start goes on from there."""
    rows = parse.parse_table(signed_pages(pages), catalog).select("job_id", "page", "row", "sku", "name", "quantity", "units", "cases", "sign")
    return rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def signed_totals(rows: DataFrame, *keys: str) -> DataFrame:
    """Totals and row counts of signed rows by ``keys``; keys whose rows have all been taken back are left out."""
    part = lambda c, name: F.sum(F.col(c).cast("decimal(18,3)") * F.col("sign")).cast("decimal(38,3)").alias(name)
    return rows.groupBy(*keys).agg(part("quantity", "total_quantity"), part("units", "total_units"), part("cases", "total_cases"), F.sum("sign").alias("row_count")).where("row_count > 0")


def signed_duplicates(rows: DataFrame) -> DataFrame:
    """(job_id, page, sku, row_count) of products that are on a page more than once by now."""
    return rows.groupBy("job_id", "page", "sku").agg(F.sum("sign").alias("row_count")).where("row_count > 1")
