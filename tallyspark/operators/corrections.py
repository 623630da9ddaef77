"""Corrections of scanned text: what was changed, how sure that is, and the status that follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import automaton
from ..functions import text as T
from .fuzzy import nearest
from .rollups import status

STEP = "struct<kind:string,before:string,after:string>"


def _step(kind: str, before: Column, after: Column) -> Column:
    """The correction that a step made, null where it left the text alone."""
    return F.when(before != after, F.struct(F.lit(kind).alias("kind"), before.alias("before"), after.alias("after")))


def message(made: Column) -> Column:
    """What a result says of its corrections: how many, and their kinds in order."""
    kinds = F.array_join(F.transform(made, lambda c: c["kind"]), ", ")
    n = F.size(made)
    return F.when(n == 0, "No corrections").otherwise(F.concat(n.cast("string"), F.when(n == 1, " correction: ").otherwise(" corrections: "), kinds))


def _result(text: Column, steps: list[Column]) -> Column:
    made = F.array_compact(F.array(*steps)).cast(f"array<{STEP}>")
    sure = T.correction_confidence(F.size(made))
    return F.struct(text.alias("text"), made.alias("corrections"), sure.alias("confidence"), status(sure).alias("status"), message(made).alias("message"))


def fixed_characters(x: Column) -> Column:
    """Letters that scanners take for digits become them in every token with a digit."""
    return F.array_join(F.transform(F.split(x, " "), T.fix_digits), " ")


def looked_up(rows: DataFrame, column: str, to: str, entries: list[dict]) -> DataFrame:
    """``rows`` with ``to``: the correction of a text that is a misread of a dictionary, by the first entry that names it, else the text. A long dictionary is a table to join."""
    first = {}
    for e in entries:
        first.setdefault(e["misread"], e["correction"])
    if len(first) > automaton.PLAIN:
        table = rows.sparkSession.createDataFrame(list(first.items()), "_misread string, _correction string")
        found = rows.join(F.broadcast(table), F.col(column) == F.col("_misread"), "left")  # the configuration
        return found.withColumn(to, F.coalesce("_correction", column)).drop("_misread", "_correction")
    out = F.col(column)
    for misread, correction in reversed(first.items()):
        out = F.when(F.col(column) == misread, correction).otherwise(out)
    return rows.withColumn(to, out)


def corrected(rows: DataFrame, entries: list[dict], column: str = "text", to: str = "correction") -> DataFrame:
    """``rows`` with ``to``, (text, corrections, confidence, status): characters fixed, then the dictionary. Null stays null in text and has no corrections."""
    one = looked_up(rows.withColumn("_0", T.trim(F.col(column))).withColumn("_1", fixed_characters(F.col("_0"))), "_1", "_2", entries)
    return one.withColumn(to, _result(F.col("_2"), [_step("character", F.col("_0"), F.col("_1")), _step("dictionary", F.col("_1"), F.col("_2"))])).drop("_0", "_1", "_2")


def corrected_skus(rows: DataFrame, column: str = "sku", to: str = "correction") -> DataFrame:
    """``rows`` with ``to``: characters fixed, all but digits and hyphens taken out, 12 or 13 digits made a valid EAN-13."""
    one = rows.withColumn("_0", T.trim(F.col(column))).withColumn("_1", fixed_characters(F.col("_0"))).withColumn("_2", F.regexp_replace("_1", r"[^0-9\-]", "")).withColumn("_3", T.correct_ean13(F.col("_2")))
    steps = [_step(kind, F.col(f"_{i}"), F.col(f"_{i + 1}")) for i, kind in enumerate(("character", "cleaning", "ean13"))]
    return one.withColumn(to, _result(F.col("_3"), steps)).drop("_0", "_1", "_2", "_3")


def corrected_names(rows: DataFrame, candidates: DataFrame, entries: list[dict], column: str = "name", to: str = "correction", least: float = 0.85) -> DataFrame:
    """``rows`` with ``to``: characters fixed, then the dictionary, then the nearest of ``candidates`` (candidate, cand_seq) above ``least``."""
    one = looked_up(rows.withColumn("_0", T.trim(F.col(column))).withColumn("_1", fixed_characters(F.col("_0"))), "_1", "_2", entries)
    best = nearest(one.select(F.col("_2").alias("name")), candidates, least).select(F.col("name").alias("_2"), F.col("candidate").alias("_best"))
    found = one.join(best, "_2", "left").withColumn("_3", F.coalesce("_best", "_2"))
    steps = [_step(kind, F.col(f"_{i}"), F.col(f"_{i + 1}")) for i, kind in enumerate(("character", "dictionary", "fuzzy"))]
    return found.withColumn(to, _result(F.col("_3"), steps)).select(*rows.columns, to)
