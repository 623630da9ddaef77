"""Totals that follow review decisions: each decision adds what it changes, with a sign, to a log; totals are sums of the log.

A row counts as ``review.decided`` lets it. When a decision on it arrives, what the row stood for so far is taken back and
what it stands for now is added, in totals and in lineage; a row that stands for the same as before adds nothing, and no other row is read again for its amount. The decision with the highest
``seq`` holds, whenever it arrives. A batch that runs again writes its own part of the log again.

A batch joins the rows once. Its signed sources are the log itself: readers sum what came after the last compaction,
so nothing is grouped for each batch. A batch of few decisions is sent to all tasks, any other one meets rows and
earlier decisions by shuffles: how small its files are says nothing of that, as ids in order take few bytes there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.results import get_result, list_results, save_result
from .review import goes_on, with_correction
from .rollups import SUM

REF = ("job_id", "product_key", "page", "row", "unit", "quantity")
DECISION = "item_id string, seq long, status string, correction struct<quantity:decimal(18,3),unit:string>"
#: Decisions up to which a batch goes to all tasks.
FEW = 50_000
SOURCE = "job_id string, product_key string, page int, row int, unit string, quantity decimal(18,3), sign int"


def _amounts(refs: DataFrame) -> DataFrame:
    """(job_id, page, product_key, cases, units, n) of each signed source."""
    signed = F.when(F.col("sign") < 0, -F.col("quantity")).otherwise(F.col("quantity"))
    part = lambda unit: F.coalesce(F.when(F.col("unit") == unit, signed), F.lit(0)).cast(SUM)
    return refs.select("job_id", "page", "product_key", part("case").alias("cases"), part("unit").alias("units"), F.col("sign").cast("long").alias("n"))


class RunningTotals:
    """The log in a folder: rows, and for each batch decisions, the changes of what holds, and signed sources; sums once they are compacted."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _read(self, part: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema + ", batch long").parquet(f"{self.path}/{part}")

    def _write(self, frame: DataFrame, part: str, batch: int) -> DataFrame:
        """``frame`` as a batch's table, read back."""
        path = f"{self.path}/{part}/batch={batch}"
        frame.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def start(self, rows: DataFrame, waiting: str = "waiting") -> None:
        """Rows (item_id and REF); those that wait for a decision, by the column ``waiting``, don't count yet. Rows of one id share its decisions."""
        kept = rows.select("item_id", *[F.col(c).cast({"quantity": "decimal(18,3)", "page": "int", "row": "int"}.get(c, "string")).alias(c) for c in REF], F.coalesce(F.col(waiting), F.lit(False)).alias("waiting"))
        kept.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/rows")
        kept = self.spark.read.parquet(f"{self.path}/rows")
        self._write(self.spark.createDataFrame([], DECISION), "decisions", 0)
        self._write(kept.where("not waiting and product_key is not null").select(*REF, F.lit(1).alias("sign")), "sources", 0)

    def decide(self, decisions: DataFrame, batch: int) -> None:
        """Adds a batch (from 1) of decisions (DECISION). Items that aren't among the rows are left out."""
        decision = F.struct("seq", "status", "correction")
        last = lambda frame: frame.groupBy("item_id").agg(F.max_by(decision, "seq").alias("d"))
        new = self._write(last(decisions).select("item_id", "d.*"), "decisions", batch)
        met = F.broadcast if new.count() <= FEW else lambda frame: frame.hint("merge")  # what is held of a batch and what it changes isn't more
        earlier = self._read("decisions", DECISION).where(F.col("batch") < batch).join(met(new.select("item_id")), "item_id", "left_semi")
        held = last(earlier).withColumnRenamed("d", "was")
        changes = new.select("item_id", decision.alias("now")).join(met(held), "item_id", "left").where("was is null or now.seq > was.seq")
        changes = self._write(changes, "changes", batch)
        rows = self.spark.read.parquet(f"{self.path}/rows").where("product_key is not null")
        kinds = dict(rows.dtypes)
        stood = lambda d: F.struct(*[with_correction(c, F.col(f"{d}.status"), F.col(f"{d}.correction")).cast(kinds[c]).alias(c) for c in ("unit", "quantity")])
        before = F.when(F.when(F.col("was").isNull(), ~F.col("waiting")).otherwise(goes_on(F.col("was.status"))), stood("was"))
        after = F.when(goes_on(F.col("now.status")), stood("now"))
        found = rows.join(met(changes), "item_id").select(*REF[:4], before.alias("before"), after.alias("after")).where(~F.col("before").eqNullSafe(F.col("after")))
        signed = F.array(F.struct(F.lit(-1).alias("sign"), F.col("before").alias("s")), F.struct(F.lit(1).alias("sign"), F.col("after").alias("s")))
        each = found.select(*REF[:4], F.explode(signed).alias("e")).where("e.s is not null")
        self._write(each.select(*REF[:4], "e.s.unit", "e.s.quantity", "e.sign"), "sources", batch)

    def _amounts(self, upto: int | None = None) -> DataFrame:
        """Signed amounts of all batches, or of those to ``upto``: the last compacted ones and the sources after them."""
        done = list_results(self.spark, f"{self.path}/compacted", 1).first()
        after = int(done.result_id) if done else -1
        every = self._read("sources", SOURCE).where(F.col("batch") > after)
        if upto is not None:
            every = every.where(F.col("batch") <= upto)
        every = _amounts(every)
        return every.unionByName(get_result(self.spark, f"{self.path}/compacted", done.result_id).drop("result_id")) if done else every

    def pages(self) -> DataFrame:
        """(job_id, page, product_key, cases, units, row_count): totals of pages now."""
        return self._summed(self._amounts(), "row_count", "job_id", "page", "product_key").where("row_count > 0")

    @staticmethod
    def _summed(every: DataFrame, n: str, *keys: str) -> DataFrame:
        sums = [F.sum(c).cast(SUM).alias(c) for c in ("cases", "units")]
        return every.groupBy(*keys).agg(*sums, F.sum("n").alias(n))

    def jobs(self) -> DataFrame:
        """(job_id, product_key, cases, units, row_count): totals of jobs now. Pages without rows add nothing to them, so they come straight from the log."""
        return self._summed(self._amounts(), "row_count", "job_id", "product_key").where("row_count > 0")

    def sources(self) -> DataFrame:
        """REF and n, how many rows are like it: lineage now."""
        return self._read("sources", SOURCE).groupBy(*REF).agg(F.sum("sign").alias("n")).where("n > 0")

    def compact(self, upto: int) -> None:
        """Sums the batches to ``upto`` once and for all; readers take the sums from the moment they are whole."""
        save_result(self._summed(self._amounts(upto), "n", "job_id", "page", "product_key").where("n <> 0"), f"{self.path}/compacted", f"{upto:012d}")
