"""Lineage tables, stored results and running totals."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import lineage, review, totals
from tallyspark.operators.running import DECISION, FEW, RunningTotals
from tallyspark.sources import results


def test_sources_of_a_product_are_read_from_its_bucket(spark, tmp_path):
    path = str(tmp_path / "refs")
    rows = spark.range(20_000).selectExpr("concat('j', id % 20) as job_id", "if(id % 100 = 3, null, concat('P', id % 50)) as product_key", "cast(id % 9 as int) as page", "cast(id as int) as row", "'case' as unit", "cast(id % 7 as decimal(18,3)) as quantity")
    lineage.write_refs(lineage.source_refs(rows), path, 16)
    found = lineage.refs_of(spark, path, "j1", "P1", 16)
    assert found.count() == rows.where("job_id = 'j1' and product_key = 'P1'").count() > 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[isnotnull\(bucket#\d+\), \(bucket#\d+ = \d+\)\]", plan)
    assert len({r.f.split("bucket=")[1].split("/")[0] for r in found.select(F.input_file_name().alias("f")).distinct().collect()}) == 1
    some = spark.createDataFrame([("j1", "P1"), ("j2", "P2"), ("j2", "none")], "job_id string, product_key string")
    assert lineage.refs_of_totals(spark, path, some, 16).count() == rows.join(some, ["job_id", "product_key"]).count()
    assert lineage.read_refs(spark, path).count() == rows.where("product_key is not null").count()


def test_a_product_of_many_sources_fills_many_files(spark, tmp_path):
    path = str(tmp_path / "refs")
    rows = spark.range(300_000).selectExpr("'j' as job_id", "if(id % 10 = 0, concat('P', id), 'hot') as product_key", "cast(id % 1000 as int) as page", "cast(id as int) as row", "'case' as unit", "cast(1 as decimal(18,3)) as quantity")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lineage.write_refs(lineage.source_refs(rows), path, 4)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    files = lineage.refs_of(spark, path, "j", "hot", 4).groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in files) == 270_000 and max(r["count"] for r in files) < 150_000
    assert not any(kind.startswith("array") for _, kind in lineage.read_refs(spark, path).dtypes)


def test_sources_gathered_for_a_report(spark):
    rows = spark.createDataFrame([("j", "A", 2, 1, "case", 3), ("j", "A", 1, 9, "unit", 1), ("j", None, 1, 1, "unit", 1)], "job_id string, product_key string, page int, row int, unit string, quantity int")
    assert [(r.job_id, r.product_key, [(s.page, s.row) for s in r.sources]) for r in lineage.gathered(lineage.source_refs(rows)).collect()] == [("j", "A", [(1, 9), (2, 1)])]


def test_saving_an_id_again_replaces_it(spark, tmp_path):
    path = str(tmp_path / "store")
    assert results.list_results(spark, path).count() == 0
    with pytest.raises(KeyError):
        results.get_result(spark, path, "a")
    for i, name in enumerate(["a", "b/ת", "a"]):
        results.save_result(spark.range(i + 1), path, name)
    assert [r.result_id for r in results.list_results(spark, path).collect()] == ["a", "b/ת"]
    assert results.get_result(spark, path, "a").count() == 3 and results.get_result(spark, path, "b/ת").count() == 2
    assert results.clear_versions(spark, path) == 1 and results.get_result(spark, path, "a").count() == 3
    for i in range(12):
        results.save_result(spark.range(1), path, f"r{i}")
    assert results.list_results(spark, path).count() == 10 and results.list_results(spark, path).first().result_id == "r11"


def test_two_writers_of_one_id_leave_one_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    plain, done = results.opened, []

    def opened(place):
        if not done:  # another writer comes between this one's rows and its manifest
            done.append(1)
            results.save_result(spark.range(5), path, "x")
        return plain(place)

    monkeypatch.setattr(results, "opened", opened)
    results.save_result(spark.range(2), path, "x")
    assert results.get_result(spark, path, "x").count() == 2 and results.list_results(spark, path).count() == 1


def test_listing_reads_manifests_only(spark, tmp_path):
    path = str(tmp_path / "store")
    results.save_result(spark.range(2), path, "x")
    for part in (tmp_path / "store" / "data").rglob("*.parquet"):
        part.write_bytes(b"not a table")
    assert [r.result_id for r in results.list_results(spark, path).collect()] == ["x"]


def picks(draw, n):
    return [(f"i{i}", f"j{draw.randrange(4)}", draw.choice(["A", "B", None]), draw.randrange(3), draw.randrange(5), draw.choice(["case", "unit", None]), draw.choice([None, *range(9)]), draw.random() < 0.5) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_totals_after_decisions_in_any_order_equal_a_full_run(spark, tmp_path, seed):
    draw = random.Random(seed)
    rows = spark.createDataFrame(picks(draw, 60), "item_id string, job_id string, product_key string, page int, row int, unit string, quantity int, waiting boolean")
    made = [(f"i{draw.randrange(64)}", seq, draw.choice(["approved", "corrected", "rejected", "pending"]), (draw.choice([None, 4, 11]), draw.choice([None, "case", "unit"]))) for seq in range(150)]
    last = {}
    for item, seq, status, correction in made:
        last[item] = (item, seq, status, correction)
    draw.shuffle(made)
    cast = lambda some: spark.createDataFrame(some, "item_id string, seq long, status string, correction struct<quantity:int,unit:string>").select("item_id", "seq", "status", F.col("correction").cast("struct<quantity:decimal(18,3),unit:string>").alias("correction"))
    running = RunningTotals(spark, str(tmp_path / "log"))
    running.start(rows)
    for batch in range(1, 4):
        some = made[(batch - 1) * 50 : batch * 50]
        running.decide(cast(some), batch)
        if batch == 2:
            running.decide(cast(some), batch)  # runs again
            running.compact(1)
    known = cast(list(last.values()))
    assert known.schema.simpleString() == spark.createDataFrame([], DECISION).schema.simpleString()
    plain = rows.withColumn("quantity", F.col("quantity").cast("decimal(18,3)"))
    free = plain.where("not waiting").join(known.select("item_id"), "item_id", "left_anti")
    whole = review.decided(plain.join(known.select("item_id"), "item_id", "left_semi"), known, ["quantity", "unit"]).unionByName(free).where("product_key is not null")
    key = lambda frame, *c: sorted(map(str, (tuple(r[x] for x in c) for r in frame.collect())))
    pages = totals.page_totals(whole, sources=False)
    assert key(running.pages(), "job_id", "page", "product_key", "cases", "units", "row_count") == key(pages, "job_id", "page", "product_key", "cases", "units", "row_count")
    assert key(running.jobs(), "job_id", "product_key", "cases", "units", "row_count") == key(totals.job_totals(pages), "job_id", "product_key", "cases", "units", "row_count")
    refs = lineage.source_refs(whole).groupBy(*lineage.KEYS, "page", "row", "unit", "quantity").agg(F.count(F.lit(1)).alias("n"))
    assert key(running.sources(), "job_id", "product_key", "page", "row", "unit", "quantity", "n") == key(refs, "job_id", "product_key", "page", "row", "unit", "quantity", "n")
    before = key(running.jobs(), "job_id", "product_key", "cases", "units", "row_count")
    running.compact(3)
    assert key(running.jobs(), "job_id", "product_key", "cases", "units", "row_count") == before


def test_a_decision_that_changes_nothing_adds_nothing_to_the_log(spark, tmp_path):
    rows = spark.range(40).selectExpr("concat('i', id) as item_id", "'j' as job_id", "if(id % 10 = 9, null, 'A') as product_key", "1 as page", "cast(id as int) as row", "if(id % 2 = 0, 'case', null) as unit", "if(id % 4 = 0, null, id) as quantity", "id % 2 = 0 as waiting")
    said = lambda seq, status, quantity=None: rows.select("item_id", F.lit(seq).cast("long").alias("seq"), F.lit(status).alias("status"), F.struct(F.lit(quantity).cast("decimal(18,3)").alias("quantity"), F.lit(None).cast("string").alias("unit")).alias("correction"))
    path = str(tmp_path / "log")
    running = RunningTotals(spark, path)
    running.start(rows)
    added = lambda batch: sorted(r.sign for r in spark.read.parquet(f"{path}/sources/batch={batch}").collect())
    assert added(0) == [1] * 16
    for batch, (decision, expected) in enumerate([(said(2, "approved"), [1] * 20), (said(3, "corrected"), []), (said(1, "rejected"), []), (said(4, "corrected", 5), [-1] * 35 + [1] * 35), (said(5, "rejected"), [-1] * 36)], 1):
        running.decide(decision, batch)
        assert added(batch) == expected
        if batch == 4:
            assert [(r.cases, r.units, r.row_count) for r in running.jobs().collect()] == [(100, 0, 36)]
    assert running.jobs().count() == running.pages().count() == running.sources().count() == 0


def test_a_batch_of_many_decisions_is_not_sent_to_all_tasks(spark, tmp_path, monkeypatch):
    rows = spark.range(60_000).selectExpr("cast(id as string) as item_id", "'j' as job_id", "'A' as product_key", "1 as page", "1 as row", "'case' as unit", "1 as quantity", "id % 2 = 0 as waiting")
    said = lambda seq, n: rows.limit(n).select("item_id", F.lit(seq).cast("long").alias("seq"), F.lit("corrected").alias("status"), F.struct(F.lit(seq).cast("decimal(18,3)").alias("quantity"), F.lit(None).cast("string").alias("unit")).alias("correction"))
    plans, write = [], RunningTotals._write
    monkeypatch.setattr(RunningTotals, "_write", lambda self, frame, part, batch: plans.append(frame._jdf.queryExecution().sparkPlan().toString()) or write(self, frame, part, batch))
    running = RunningTotals(spark, str(tmp_path / "log"))
    running.start(rows)
    for batch, (n, kind) in enumerate([(FEW + 1, "SortMergeJoin"), (FEW, "BroadcastHashJoin"), (FEW + 1, "SortMergeJoin")], 1):
        plans.clear()
        running.decide(said(batch, n), batch)
        assert re.findall(r"\w+Join\b", "".join(plans)) == [kind] * 3
    assert [(r.cases, r.row_count) for r in running.jobs().collect()] == [(3 * (FEW + 1) + (60_000 - FEW) // 2, FEW + 1 + (60_000 - FEW) // 2)]
