"""Exact medians against plain Python, of groups on both sides of the sketch's accuracy."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import rollups


def prices(draw, kind, n):
    return {
        "even": lambda: [round(draw.uniform(0, 1000), 2) for _ in range(n)],
        "one": lambda: [5.0] * n,
        "two": lambda: [1.0 if i < n // 2 else 9.0 for i in range(n)],
        "skewed": lambda: [round(draw.paretovariate(0.7), 2) for _ in range(n)],
        "negative": lambda: [-float(i) for i in range(n)],
    }[kind]()


@pytest.mark.parametrize("accuracy", [10_000, 50])
def test_medians_are_exact(spark, monkeypatch, accuracy):
    monkeypatch.setattr(rollups, "ACCURACY", accuracy)
    draw, rows = random.Random(accuracy), []
    for k, (kind, n) in enumerate((kind, n) for kind in ("even", "one", "two", "skewed", "negative") for n in (1, 2, 3, 100, 1001, 5000)):
        rows += [(f"{kind}{n}" if k else None, p) for p in prices(draw, kind, n)]
    rows += [("nulls", None), ("nulls", None), ("half", 4.0), ("half", None), ("half", 2.0)]
    items = spark.createDataFrame(rows, "g string, price double").repartition(5)
    groups = {}
    for g, p in rows:
        groups.setdefault(g, []).extend([] if p is None else [p])
    got = {r.g: (r.median_price, r.price_count, r.min_price, r.max_price) for r in rollups.price_statistics(items, "g").collect()}
    assert got == {g: (statistics.median(p), len(p), min(p), max(p)) if p else (0.0, 0, 0.0, 0.0) for g, p in groups.items()}
    whole = rollups.price_statistics(items).first()
    every = [p for _, p in rows if p is not None]
    assert (whole.median_price, whole.price_count) == (statistics.median(every), len(every))


def test_few_prices_of_a_large_group_are_put_in_order(spark):
    items = spark.range(400_000).select(F.lit("hot").alias("g"), (F.col("id") * 7 % 399_989 + F.col("id") / 1_000_000).alias("price"))
    got = rollups.price_statistics(items, "g").first()
    assert got.median_price == items.agg(F.expr("percentile(price, 0.5)")).first()[0] and got.price_count == 400_000


def test_combinations_of_warnings(spark):
    rows = spark.createDataFrame([("A", ["x", "y"]), ("A", ["y"]), ("A", ["x", "y"]), ("A", []), ("B", []), (None, ["z"])], "sku string, warnings array<string>")
    rows = rows.withColumns({c: F.lit("") for c in ("barcode", "name")} | {c: F.lit(1) for c in ("quantity", "cases", "units", "confidence")})
    assert {r.sku: r.warnings for r in rollups.product_rows(rows).collect()} == {"A": ["x", "y"], "B": [], None: ["z"]}
