import datetime
import json
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyspark import schemas, services
from tallyspark.config import Config
from tallyspark.functions import numbers as N
from tallyspark.functions import text as T
from tallyspark.operators import catalog as C
from tallyspark.operators import places, rules, totals
from tallyspark.plans import engine
from tallyspark.sources import readers, writers

PRODUCTS = "sku string, barcode string, name string, quantity int, cases int, units int, confidence double, rowCount int"


def test_product_export(spark, tmp_path):
    rows = spark.createDataFrame([("1", "", 'say "x"', 3, 0, 3, 0.987, 2)], PRODUCTS)
    assert rows.select(writers.product_csv_line().alias("l")).first().l == '"1","N/A","say "x"","3","0","3","98.7%","2"'
    assert json.loads(rows.select(writers.product_json().alias("j")).first().j)["confidence"] == "98.7%"
    batch = spark.createDataFrame([("b1",)], "id string")
    warned = spark.createDataFrame([(1, "unknown_sku", "error", "m"), (2, "ocr_warning", "warning", "m")], schemas.WARNING)
    more = rows.unionByName(spark.createDataFrame([("0", "1", "q", 1, 1, 0, 0.5, 1)], PRODUCTS))
    writers.write_document(batch, more, warned, str(tmp_path / "d"), "b/1")
    document = json.loads((tmp_path / "d" / "b%2F1.json").read_text())
    assert document["id"] == "b1" and [p["sku"] for p in document["products"]] == ["0", "1"] and document["warnings"]["unknown_sku"] == 1
    writers.write_document(batch, more.limit(0), warned, str(tmp_path / "d"), "b2")
    assert json.loads((tmp_path / "d" / "b2.json").read_text())["products"] == [] and not (tmp_path / "d" / "b%2F1.json").exists()


def test_sheets_split_at_the_limit(spark):
    rows = spark.range(5).selectExpr("id", "'c' as city")
    assert [r.sheet for r in writers.sheet_numbers(rows, ["city"], ["id"], 2).orderBy("id").collect()] == [0, 0, 1, 1, 2]


def test_raw_cells(spark):
    rows = spark.createDataFrame([(None, [1, 2])], "a string, b array<int>")
    assert tuple(writers.raw_cells(rows).first()) == ("", "[1,2]")


def test_catalog_writers(spark, tmp_path):
    rows = readers.catalog_rows(spark, [("01", "2", "n", 1, True, "c", "s", 1.0)])
    writers.write_catalog_csv(rows, str(tmp_path / "c"))
    assert readers.catalog_csv(spark, str(tmp_path / "c")).first().sku == "01"
    writers.write_json(rows.drop("load_seq"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1
    (tmp_path / "a.json").write_text('[{"sku": "7", "name": "x", "packSize": 3}]')
    assert readers.catalog_json(spark, str(tmp_path / "a.json")).first().packSize == 3


def test_files(spark, tmp_path):
    (tmp_path / "job1").mkdir()
    (tmp_path / "job1" / "a.txt").write_text("one\ntwo")
    (tmp_path / "job1" / "b.txt").write_text("three")
    got = [tuple(r) for r in readers.text_pages(spark, str(tmp_path / "job1")).orderBy("page").collect()]
    assert got == [("job1", 1, "one\ntwo"), ("job1", 2, "three")]
    (tmp_path / "x.png").write_bytes(b"1")
    assert readers.images(spark, str(tmp_path / "x.png")).select("mime").first().mime == "image/png"
    files = spark.createDataFrame([("image/png",), ("text/plain",), (None,)], "mime string")
    assert [r.accepted for r in readers.accepted_uploads(files).collect()] == [True, False, False]


def test_small_functions(spark):
    row = spark.createDataFrame([(datetime.datetime(2026, 1, 2),)], "t timestamp").select(T.batch_id(F.col("t")).alias("b")).first()
    assert row.b.startswith("2026-01-02-") and int(row.b.rpartition("-")[2], 36) % 1000 == 0
    got = spark.range(1).select(N.clamp(F.lit(120.0), 0, 100).alias("a"), N.share_percent(F.lit(1), F.lit(3)).alias("b"), N.share_percent(F.lit(1), F.lit(0)).alias("c")).first()
    assert tuple(got) == (100.0, 33.3, 0.0)
    assert Config.load({"TALLY_ENV": "nowhere", "TALLY_LOG_LEVEL": "warn"}) == Config("development", "warn")
    assert Config(log_level="warn").logs("error") and not Config(log_level="warn").logs("info")


def test_pattern_checks(spark):
    rows = spark.createDataFrame([("a 1/12", "unit", None), ("a 1/12", "unit", False), ("b (24)", "case", None), ("c", "unit", None)], "name string, unit string, case_only boolean")
    got = [[x.status for x in r.c] for r in rows.select(rules.pattern_checks(F.col("name"), F.col("unit"), F.col("case_only")).alias("c")).collect()]
    assert got == [["fail", "pass"], ["pass", "pass"], ["pass", "warn"], ["pass", "pass"]]


def test_lineage_end_to_end(spark):
    products = spark.createDataFrame([(1, "A", "111", "s1", "Milk", ["dairy"], True, False), (2, "B", None, "s2", "Beer 1/24", [], False, True)], "load_seq long, product_key string, barcode string, sku string, name string, aliases array<string>, allowUnitPicking boolean, caseOnly boolean")
    rows = spark.createDataFrame([("j", 1, 1, "x", "milk", None, None, 2, "unit", 0.9, "TLV", "r1"), ("j", 2, 1, "x", None, "111", None, 3, "case", 0.9, "TLV", "r1"), ("j", 2, 2, "x", None, None, "s2", 4, None, 0.9, None, None), ("j", 2, 3, "x", "what", None, None, 1, "case", 0.9, None, None)], "job_id string, page int, row int, raw_text string, product_hint string, barcode string, sku string, quantity int, unit string, confidence double, city string, route_id string")
    rows = rows.withColumns({"quantity": F.col("quantity").cast("decimal(18,3)"), "job_city": F.lit(None).cast("string"), "job_route": F.lit(None).cast("string")})
    cities = spark.createDataFrame([("TLV", "Tel Aviv", "", True)], schemas.CITY)
    routes = spark.createDataFrame([("r1", "TLV", "", "", 2, True)], schemas.ROUTE)
    out = engine.lineage(rows, products, cities, routes)
    jobs = {r.product_key: (int(r.cases), int(r.units), len(r.sources)) for r in out["jobs"].collect()}
    assert jobs == {"A": (3, 2, 2), "B": (4, 0, 1)}
    assert out["queue"].count() == 1 and out["unassigned"].count() == 1
    assert {(r.city_id, int(r.cases), int(r.units)) for r in out["cities"].where("level = 2").collect()} == {("TLV", 3, 2), ("UNASSIGNED", 4, 0)}
    traced = totals.traced(totals.source_rows(out["jobs"]), spark.createDataFrame([("j", 1, "img1")], "job_id string, page int, image string"))
    assert traced.where("image = 'img1'").count() == 1
    ordered = places.in_route_order(out["cities"], routes)
    assert ordered.count() == out["cities"].count()


def test_reports_as_folders(spark, tmp_path):
    rows = spark.createDataFrame([("c", f"r{i % 2}", f"K{i}", Decimal(i), Decimal(0), [(1, i, "case", Decimal(i))]) for i in range(4)], "city_id string, delivery_route string, product_key string, cases decimal(18,3), units decimal(18,3), sources array<struct<page:int,row:int,unit:string,quantity:decimal(18,3)>>")
    names = spark.createDataFrame([("K1", "one")], "product_key string, name string")
    writers.write_city_report(rows, names, str(tmp_path / "city"))
    found = spark.read.csv(str(tmp_path / "city" / "routes"), header=True)
    assert sorted((r.city_id, r.delivery_route, r.sheet, r.product_key, r.name, r.sources, r.notes) for r in found.collect()) == [("c", "r0", 0, "K0", None, "p1r0", "zero total"), ("c", "r0", 0, "K2", None, "p1r2", None), ("c", "r1", 0, "K1", "one", "p1r1", None), ("c", "r1", 0, "K3", None, "p1r3", None)]
    assert spark.read.csv(str(tmp_path / "city" / "summary"), header=True).first().routes == "2"
    writers.write_sheets({"Raw Data": rows}, str(tmp_path / "sheets"))
    assert spark.read.csv(str(tmp_path / "sheets" / "Raw_Data"), header=True).count() == 4


def test_catalogs_of_several_files_keep_the_files_order(spark, tmp_path):
    for name, skus in (("a", range(5000)), ("b", range(3)), ("c", range(4000, 4002))):
        (tmp_path / f"{name}.csv").write_text("sku,barcode,name,packSize,allowUnits,category,supplier,price\n" + "".join(f"{i},,{name},1,true,,,1\n" for i in skus))
    rows = readers.catalog_csv(spark, str(tmp_path)).orderBy("load_seq").collect()
    assert [(r.name, r.sku) for r in rows] == [*(("a", str(i)) for i in range(5000)), *(("b", str(i)) for i in range(3)), ("c", "4000"), ("c", "4001")]
    last = {r.sku: r.name for r in C.last_wins(readers.catalog_csv(spark, str(tmp_path))).collect()}
    assert last["1"] == "b" and last["4001"] == "c" and last["77"] == "a"


def test_coded_errors(spark):
    with pytest.raises(ValueError):
        services.coded((F.lit(True), "NO_SUCH_CODE", "x"))
    rows = spark.range(3).withColumn("error", services.coded((F.col("id") == 1, "PARSE_FAILED", "first"), (F.col("id") > 0, "INTERNAL_ERROR", "second")))
    assert [(r.id, r.code, r.message) for r in services.err(rows).orderBy("id").collect()] == [(1, "PARSE_FAILED", "first"), (2, "INTERNAL_ERROR", "second")]
    assert [r.id for r in services.ok(rows).collect()] == [0]


def test_corrections_of_nulls(spark):
    from tallyspark.operators import corrections

    row = corrections.corrected(spark.createDataFrame([(None,)], "text string"), []).first().correction
    assert (row.text, row.corrections, row.confidence) == (None, [], 1.0)


def test_batch_ids_of_years_after_9999(spark, tmp_path):
    duckdb.sql("COPY (SELECT unnest([0, 2900000, 2950000, 6000000])::BIGINT AS event_id) TO '%s'" % (tmp_path / "events.parquet"))
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
        want = con.sql(entry.oracle_sql()["batch_ids"]).fetchall()
    got = [tuple(r) for r in entry.queries()["batch_ids"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and any(day.startswith("10") for _, day in got)
    ids = spark.range(1).select(T.batch_id_utc(F.lit(300_000_000_000_000)).alias("a"), T.batch_id(F.timestamp_millis(F.lit(300_000_000_000_000))).alias("b")).first()
    assert ids.a == ids.b and ids.a.startswith("11476-")
