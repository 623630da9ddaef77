"""Further queries with their SQL, in the same tables as those of ``queries``: text and layout fields, configured rules, corrections, reports, reading and writing, similarity."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .. import services
from ..config import Config
from ..functions import numbers as N
from ..functions import similarity as S
from ..functions import text as T
from ..operators import catalog as C
from ..operators import corrections, fuzzy, ordering, parse, places, regions, rollups, rules, totals
from ..sources import readers, seeds, workbooks, writers
from ..sources.tables import new_path, saved
from ..streaming import pages as stream
from . import engine
from .queries import _CALCED, _CASES, _CAT, _CODES, _CONF, _D, _EAN, _ENR, _KNOWN, _NAMED, _PARSED, _PICKS, _PLACED, _PROD, _UNITS, _WARN, _WORDS, ORACLE, _calculated, _named, _names, _placed, _warnings, catalog, enriched, pages, picks, products, query, table
from .queries import QUERIES as QUERIES


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    return new_path(spark, "query")


# reading and writing


@query(f"SELECT sku, barcode, name, packSize, allowUnits, category FROM ({_CAT})")
def catalog_csv_round_trip(spark, d):
    path = scratch(spark)
    writers.write_catalog_csv(catalog(spark, d).withColumn("supplier", F.lit("")), path)
    return readers.catalog_csv(spark, path).select("sku", "barcode", "name", "packSize", "allowUnits", "category")


@query(f"SELECT sku, name, packSize, CAST(price AS DOUBLE) AS price FROM ({_CAT})")
def catalog_json_round_trip(spark, d):
    path = scratch(spark)
    writers.write_json(catalog(spark, d).select("sku", "name", "packSize", "price"), path)
    return spark.read.schema("sku string, name string, packSize int, price double").json(path)


@query(f"SELECT coalesce(problem, 'none') AS problem, count(*) AS n FROM (SELECT CASE WHEN load_seq % 11 = 0 THEN 'Missing SKU' WHEN load_seq % 13 = 0 THEN 'Missing name' WHEN load_seq % 17 = 0 THEN 'Invalid pack size' END AS problem FROM ({_CAT})) GROUP BY problem")
def load_skips_invalid(spark, d):
    seq = F.col("load_seq")
    broken = catalog(spark, d).withColumns({"sku": F.when(seq % 11 != 0, F.col("sku")), "name": F.when(seq % 13 == 0, "").otherwise(F.col("name")), "packSize": F.when(seq % 17 == 0, 0).when(seq % 19 != 0, F.greatest("packSize", F.lit(1)))})
    good, passed = readers.loaded(broken)
    return good.select(F.lit("none").alias("problem")).unionByName(passed.select("problem")).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'region=' || n_regionkey AS job_id, 1 AS page, CAST(count(*) AS INT) AS lines FROM nation GROUP BY n_regionkey")
def text_pages_read(spark, d):
    path = scratch(spark)
    table(spark, d, "nation").select(F.col("n_regionkey").alias("region"), "n_name").repartition(1).write.partitionBy("region").text(path)
    found = readers.text_pages(spark, f"{path}/*")
    return found.select("job_id", "page", (F.size(F.split("text", "\n")) - 1).alias("lines"))


@query("SELECT mime, mime IN ('application/pdf', 'image/png') AS accepted, count(*) AS n FROM (SELECT CASE event_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN 'text/plain' ELSE 'image/gif' END AS mime FROM events) GROUP BY mime")
def accepted_uploads(spark, d):
    kind = F.col("event_id") % 4
    mime = F.when(kind == 0, "application/pdf").when(kind == 1, "image/png").when(kind == 2, "text/plain").otherwise("image/gif")
    return readers.accepted_uploads(table(spark, d, "events").select(mime.alias("mime"))).groupBy("mime", "accepted").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, '1.11.0' AS version FROM events WHERE event_id % 12 = 11")
def highest_version_rows(spark, d):
    rows = table(spark, d, "events").select("event_id", F.concat(F.lit("1."), (F.col("event_id") % 12).cast("string"), F.lit(".0")).alias("version"))
    return readers.highest_version(rows)


@query("SELECT sku, barcode, name, brand, packSize, allowUnits FROM (VALUES " + ", ".join(str((a, b, c, e, f, g)).replace("True", "true").replace("False", "false") for a, b, c, e, f, g in seeds.PRODUCTS) + ") v(sku, barcode, name, brand, packSize, allowUnits)")
def seed_catalog(spark, d):
    return seeds.seed_products(spark).drop("load_seq")


@query(f"SELECT result_id, total_rows FROM (SELECT count(*) AS total_rows FROM ({_PICKS})), (VALUES ('first'), ('second')) v(result_id)")
def stored_results(spark, d):
    path = scratch(spark)
    rows = picks(spark, d).agg(F.count(F.lit(1)).alias("total_rows"))
    for name in ("first", "second"):
        writers.save_result(rows, path, name)
    listed = writers.list_results(spark, path).select("result_id")
    return listed.join(writers.get_result(spark, path, "first").unionByName(writers.get_result(spark, path, "second")), "result_id").select("result_id", "total_rows")


_TEXT_PRODUCT = f"SELECT sku, barcode, name, quantity, cases, units, floor(confidence * 1000 + 0.5) / 10 AS percent, rowCount FROM ({_PROD})"


@query(f"""SELECT '"' || sku || '","' || CASE WHEN barcode = '' THEN 'N/A' ELSE barcode END || '","' || name || '","' || CAST(CAST(quantity AS DECIMAL(38,3)) AS VARCHAR) || '","' || CAST(CAST(cases AS DECIMAL(38,3)) AS VARCHAR) || '","' || CAST(CAST(units AS DECIMAL(38,3)) AS VARCHAR) || '","' || printf('%.1f%%', percent) || '","' || rowCount || '"' AS line FROM ({_TEXT_PRODUCT})""")
def product_export_lines(spark, d):
    return products(spark, d).select(writers.product_csv_line().alias("line"))


@query(f"SELECT category, printf('%.1f%%', floor(confidence * 1000 + 0.5) / 10) AS confidence, CAST(n AS VARCHAR) AS n FROM (SELECT category, CAST(sum(CAST(p.confidence AS DECIMAL(18,6))) AS DOUBLE) / count(*) AS confidence, count(*) AS n FROM ({_ENR}) p JOIN ({_CAT}) c ON p.sku = c.sku GROUP BY category)")
def product_json_fields(spark, d):
    rows = enriched(spark, d).join(catalog(spark, d).select("sku", "category"), "sku").withColumn("warnings", F.array().cast("array<string>"))
    found = rollups.product_rows(rows.withColumn("sku", F.col("category"))).select(writers.product_json().alias("j"))
    return found.select(F.get_json_object("j", "$.sku").alias("category"), F.get_json_object("j", "$.confidence").alias("confidence"), F.get_json_object("j", "$.rowCount").alias("n"))


@query(f"SELECT (SELECT CAST(count(DISTINCT category) AS INT) FROM ({_CAT})) AS products, CAST(count(*) FILTER (type = 'unknown_sku') AS VARCHAR) AS unknown_sku, CAST(count(*) AS VARCHAR) AS warnings FROM ({_WARN})")
def batch_document(spark, d):
    rows = catalog(spark, d).groupBy(F.col("category").alias("sku")).agg(F.count(F.lit(1)).alias("quantity"))
    rows = rows.select("sku", F.lit("").alias("barcode"), F.lit("").alias("name"), "quantity", F.lit(0).alias("cases"), F.lit(0).alias("units"), F.lit(1.0).alias("confidence"), F.lit(1).alias("rowCount"))
    batch = spark.range(1).select(F.lit("b1").alias("id"))
    path = scratch(spark)
    writers.write_document(batch, rows, _warnings(spark, d), path, "b1")
    document = spark.read.text(path, wholetext=True).withColumnRenamed("value", "document")
    held = F.from_json(F.get_json_object("document", "$.products"), "array<struct<sku:string>>")
    return document.select(F.size(held).alias("products"), F.get_json_object("document", "$.warnings.unknown_sku").alias("unknown_sku"), F.get_json_object("document", "$.warnings.all").alias("warnings"))


@query(f"SELECT 'products' AS part, count(*) AS n FROM ({_PROD}) UNION ALL SELECT 'batch', 1")
def batch_folders(spark, d):
    path = scratch(spark)
    writers.write_result(spark.range(1).select(F.lit("b1").alias("id")), products(spark, d), _warnings(spark, d), path)
    read = lambda part: spark.read.text(f"{path}/{part}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "n")
    return read("products").unionByName(read("batch"))


def _sheets(spark, d):
    rows = enriched(spark, d)
    known = catalog(spark, d, True).withColumn("supplier", F.when(F.col("load_seq") % 5 != 0, F.concat(F.lit("S"), (F.col("load_seq") % 10).cast("string"))))
    stats = rollups.batch_statistics(rows.withColumn("warned", F.col("name") == ""))
    return engine.sheets(engine.BatchResult(stats, saved(products(spark, d), "products"), rows, _warnings(spark, d)), known)


_NUMBERS = "CAST(p.quantity AS DOUBLE) AS quantity, CAST(p.cases AS DOUBLE) AS cases, CAST(p.units AS DOUBLE) AS units"


@query(f"SELECT sku, barcode, name, {_NUMBERS}, confidence, rowCount, '' AS warnings FROM ({_PROD}) p")
def products_sheet(spark, d):
    return _sheets(spark, d)["Products"]


@query(f"SELECT p.sku, p.barcode, p.name, {_NUMBERS}, confidence, rowCount, '' AS warnings, coalesce(c.category, 'N/A') AS category, coalesce(CASE WHEN c.load_seq % 5 <> 0 THEN 'S' || (c.load_seq % 10) END, 'N/A') AS supplier, coalesce(CAST(c.packSize AS VARCHAR), 'N/A') AS packSize FROM ({_PROD}) p LEFT JOIN ({_KNOWN}) c ON p.sku = c.sku")
def by_product_sheet(spark, d):
    return _sheets(spark, d)["By Product"]


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, coalesce(CASE WHEN p_partkey % 3 <> 0 THEN p_name END, '') AS p_name, '[' || p_size || ',' || p_partkey || ']' AS pair FROM part")
def raw_data_cells(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")).alias("p_name"), F.array(F.col("p_size").cast("long"), "p_partkey").alias("pair"))
    return writers.raw_cells(rows)


@query(f"SELECT p_partkey, 'Batch_' || regexp_replace(name, '[^a-zA-Z0-9-]', '_', 'g') || '.xlsx' AS file FROM ({_NAMED})")
def export_names(spark, d):
    return _named(spark, d).select("p_partkey", T.export_name(F.col("name")).alias("file"))


_CITY = f"SELECT city_id, delivery_route, sku AS product_key, {_CASES}, {_UNITS}, {_CODES.replace('AS codes', 'AS sources')} FROM ({_PLACED}) GROUP BY city_id, delivery_route, sku"


def _city_totals(spark, d):
    rows = _placed(spark, d)
    return rows.groupBy("city_id", "delivery_route", "product_key").agg(rollups.total("cases").alias("cases"), rollups.total("units").alias("units"), F.array_sort(F.collect_list(totals.source())).alias("sources"))


@query(f"SELECT t.city_id, t.delivery_route, t.product_key, coalesce(c.name, '') AS name, cases, units, sources, CASE WHEN t.delivery_route = 'UNASSIGNED_ROUTE' THEN 'no route' ELSE '' END || CASE WHEN t.delivery_route = 'UNASSIGNED_ROUTE' AND cases = 0 AND units = 0 THEN '; ' ELSE '' END || CASE WHEN cases = 0 AND units = 0 THEN 'zero total' ELSE '' END AS notes, CAST((row_number() OVER (PARTITION BY t.city_id, t.delivery_route ORDER BY t.product_key) - 1) // 10000 AS INT) AS sheet FROM ({_CITY}) t LEFT JOIN ({_KNOWN}) c ON t.product_key = c.sku")
def city_report_rows(spark, d):
    names = catalog(spark, d, True).select(F.col("sku").alias("product_key"), "name")
    return writers.city_report(_city_totals(spark, d), names)[0]


@query(f"SELECT city_id, count(DISTINCT delivery_route) AS routes, count(*) AS products, sum(cases) AS cases, sum(units) AS units FROM ({_CITY}) GROUP BY city_id")
def city_report_summary(spark, d):
    names = catalog(spark, d, True).select(F.col("sku").alias("product_key"), "name")
    return writers.city_report(_city_totals(spark, d), names)[1]


_CITY_NOTES = "CASE WHEN t.delivery_route = 'UNASSIGNED_ROUTE' THEN 'no route' ELSE '' END || CASE WHEN t.delivery_route = 'UNASSIGNED_ROUTE' AND cases = 0 AND units = 0 THEN '; ' ELSE '' END || CASE WHEN cases = 0 AND units = 0 THEN 'zero total' ELSE '' END"
_CITY_FILES = f"SELECT t.city_id, t.delivery_route AS route, t.product_key, coalesce(c.name, '') AS name, cases, units, sources, {_CITY_NOTES} AS notes, row_number() OVER (PARTITION BY t.city_id, t.delivery_route ORDER BY t.product_key) - 1 AS line FROM ({_CITY}) t LEFT JOIN ({_KNOWN}) c ON t.product_key = c.sku"


@query(f"SELECT city_id || '.xlsx' AS file, route || CASE WHEN line >= 10000 THEN ' (' || CAST(line // 10000 + 1 AS VARCHAR) || ')' ELSE '' END AS sheet, CAST(line % 10000 + 2 AS INT) AS row, product_key, name, cases, units, sources, notes FROM ({_CITY_FILES}) UNION ALL SELECT city_id || '.xlsx', 'Summary', 2, city_id, CAST(count(DISTINCT route) AS VARCHAR), CAST(count(*) AS DOUBLE), sum(cases), printf('%.3f', sum(units)), '' FROM ({_CITY_FILES}) GROUP BY city_id")
def city_workbooks(spark, d):
    path = scratch(spark)
    writers.write_city_workbooks(_city_totals(spark, d), catalog(spark, d, True).select(F.col("sku").alias("product_key"), "name"), path)
    cell = lambda c: F.coalesce(F.col("cells")[c], F.lit(""))
    held = workbooks.read_workbooks(spark, path).where("row > 1")
    return held.select("file", "sheet", "row", cell("A").alias("product_key"), cell("B").alias("name"), cell("C").cast("double").alias("cases"), cell("D").cast("double").alias("units"), cell("E").alias("sources"), cell("F").alias("notes"))


@query(f"SELECT city_id || '.html' AS file, route AS section, product_key, name, printf('%.3f', cases) AS cases, printf('%.3f', units) AS units FROM ({_CITY_FILES})")
def city_pages(spark, d):
    path = scratch(spark)
    writers.write_city_pages(_city_totals(spark, d), catalog(spark, d, True).select(F.col("sku").alias("product_key"), "name"), path, "job 7", "2026-01-02")
    row = workbooks.read_pages(spark, path).where("section <> 'Summary'")
    return row.select("file", "section", *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(("product_key", "name", "cases", "units"))])


@query(f"SELECT sheet, count(*) AS rows FROM (SELECT 'Products' AS sheet FROM ({_PROD}) UNION ALL SELECT 'By Product' FROM ({_PROD}) UNION ALL SELECT 'Raw Data' || CASE WHEN n > 10000 THEN ' (' || CAST((n - 1) // 10000 + 1 AS VARCHAR) || ')' ELSE '' END FROM (SELECT row_number() OVER () AS n FROM lineitem) UNION ALL SELECT 'Warnings' FROM (SELECT DISTINCT type, message FROM ({_WARN})) UNION ALL SELECT 'By Category' FROM (SELECT DISTINCT coalesce(c.category, 'Uncategorized') FROM ({_PROD}) p LEFT JOIN ({_KNOWN}) c ON p.sku = c.sku) UNION ALL SELECT 'By Category' FROM ({_PROD}) UNION ALL SELECT 'By Supplier' FROM (SELECT DISTINCT coalesce(CASE WHEN c.load_seq % 5 <> 0 THEN 'S' || (c.load_seq % 10) END, 'No Supplier') FROM ({_PROD}) p LEFT JOIN ({_KNOWN}) c ON p.sku = c.sku) UNION ALL SELECT 'By Supplier' FROM ({_PROD}) UNION ALL SELECT 'By Status' FROM (SELECT DISTINCT CASE WHEN confidence > 0.98 THEN 1 WHEN confidence > 0.90 THEN 2 ELSE 3 END FROM ({_PROD})) UNION ALL SELECT 'By Status' FROM ({_PROD}) UNION ALL SELECT 'Summary' FROM range(9)) GROUP BY sheet")
def batch_workbook(spark, d):
    path = scratch(spark)
    writers.write_workbook(_sheets(spark, d), path, "Batch")
    return workbooks.read_workbooks(spark, path).where("row > 1").groupBy("sheet").agg(F.count(F.lit(1)).alias("rows"))


@query(f"SELECT sku, {_D('quantity', 'total_quantity')}, {_D('units', 'total_units')}, {_D('cases', 'total_cases')}, count(*) AS row_count FROM ({_PARSED}) GROUP BY sku")
def stream_running_totals(spark, d):
    path = scratch(spark)
    rows = pages(spark, d).select(F.col("invoice").alias("job_id"), F.lit(1).alias("page"), "text")
    rows.write.json(f"{path}/in")
    run = stream.start(stream.running_totals(stream.arriving(spark, f"{path}/in"), catalog(spark, d, True)), f"{path}/out", f"{path}/state")
    run.awaitTermination()
    return stream.latest(spark, f"{path}/out")


# text and layouts


def _sheet_lines(spark, d):
    return table(spark, d, "part").withColumn("line", F.concat("p_name", F.lit("  "), "p_brand", F.lit(" "), "p_type", F.lit("   "), F.col("p_size").cast("string")))


_TWICE = f"SELECT p_partkey, CASE WHEN sku = '' THEN '' ELSE sku || ' ' || sku END AS sku, CASE WHEN productname = '' THEN '' ELSE productname || ' ' || productname END AS name, CASE WHEN barcode = '' THEN '' ELSE barcode || ' ' || barcode END AS barcode, CASE WHEN quantity = '' THEN '' ELSE quantity || ' ' || quantity END AS quantity FROM ({_WORDS})"
_SURE = lambda x: f"(SELECT CAST({_CONF} AS DOUBLE) FROM (SELECT CAST(len({x}) AS DOUBLE) AS n, CAST(len(regexp_extract_all({x}, '[^\\w\\s]')) AS DOUBLE) AS s, CAST(len(regexp_extract_all({x}, '[0-9]')) AS DOUBLE) AS g))"


@query(f"SELECT p_partkey, sku, name, {_SURE('t.name')} AS confidence FROM ({_TWICE}) t")
def layout_regions(spark, d):
    rows = _sheet_lines(spark, d).select("p_partkey", F.concat("line", F.lit("\n \n"), "line").alias("text"))
    found = regions.extract_regions(rows, regions.layout("hebrew_standard")).withColumn("n", regions.region_by_name(F.col("regions"), "productName"))
    return found.select("p_partkey", regions.region_by_name(F.col("regions"), "sku")["text"].alias("sku"), F.col("n.text").alias("name"), F.col("n.confidence").alias("confidence"))


@query(f"SELECT p_partkey, CAST((sku = '')::INT + (name = '')::INT + (quantity = '')::INT + ({_SURE('t.sku')} < 0.5)::INT + ({_SURE('t.name')} < 0.5)::INT + ({_SURE('t.barcode')} < 0.5)::INT + ({_SURE('t.quantity')} < 0.5)::INT AS INT) AS issues FROM ({_TWICE}) t")
def layout_issues(spark, d):
    rows = _sheet_lines(spark, d).select("p_partkey", F.concat("line", F.lit("\n"), "line").alias("text"))
    found = regions.extract_regions(rows, regions.layout_by_language("en"))
    return found.select("p_partkey", F.size(regions.region_issues(F.col("regions"))).alias("issues"))


_LAYOUT = f"SELECT p_partkey, regexp_replace(sku, '[^a-zA-Z0-9-]', '', 'g') AS sku, productname AS product_name, regexp_replace(barcode, '[^0-9]', '', 'g') AS barcode, CAST(CASE WHEN regexp_extract(quantity, '[0-9]+') = '' THEN '0' ELSE regexp_extract(quantity, '[0-9]+') END AS DOUBLE) AS quantity, CASE WHEN {_SURE('w.sku')} = 0 THEN 0.8::DOUBLE ELSE {_SURE('w.sku')} END AS confidence, CASE WHEN len(regexp_extract_all(productname, '[A-Za-z]')) > 0 THEN 'en' ELSE 'mixed' END AS language FROM ({_WORDS}) w WHERE regexp_replace(sku, '[^a-zA-Z0-9-]', '', 'g') <> ''"


@query(f"SELECT *, 'units' AS unit, 'Pending' AS status FROM ({_LAYOUT})")
def layout_rows(spark, d):
    return regions.parse_layout(_sheet_lines(spark, d).select("p_partkey", "line")).drop("line")


@query(f"SELECT p_partkey, 'מק\"ט: ' || sku || ' | שם: ' || product_name || ' | כמות: ' || CAST(quantity AS BIGINT) AS shown, CAST((product_name = '')::INT + (quantity <= 0)::INT + (confidence < 0.5)::INT AS INT) AS issues FROM ({_LAYOUT})")
def layout_row_display(spark, d):
    rows = regions.parse_layout(_sheet_lines(spark, d).select("p_partkey", "line"))
    return rows.select("p_partkey", regions.display_line().alias("shown"), F.size(regions.row_issues()).alias("issues"))


_SPEC_LINE = "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '7290' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') || ' ' || upper(p_name) || ', (' || p_size || ') ' || p_size WHEN 1 THEN 'AB' || (10000 + p_partkey) || ' ' || p_name || ' 1/' || p_size || ' 2.5' WHEN 2 THEN p_name || ' ' || p_size || ' 313' ELSE p_name END AS line FROM part"
_FREE = "regexp_full_match(x, '-?[0-9]+(\\.[0-9]+)?')"


@query(rf"""SELECT p_partkey, nullif(barcode, '') AS barcode, nullif(sku, '') AS sku, TRY_CAST(numbers[-1] AS DOUBLE) AS quantity, trim(regexp_replace(regexp_replace(lower(array_to_string(list_filter(words, lambda x: NOT {_FREE}), ' ')), '[^\p{{L}}\p{{N}}\s()/]', '', 'g'), '\s+', ' ', 'g')) AS product_hint,
 TRY_CAST(coalesce(nullif(regexp_extract(line, '\(([0-9]+)\)', 1), ''), nullif(regexp_extract(line, '1/([0-9]+)', 1), '')) AS INT) AS pack_size_hint, CASE WHEN len(numbers) > 1 THEN 'AMBIGUOUS_QUANTITY_COLUMN' END AS issue
 FROM (SELECT *, list_filter(words, lambda x: {_FREE}) AS numbers FROM (SELECT *, list_filter(string_split_regex(CASE WHEN barcode || sku <> '' THEN replace(line, barcode || sku, ' ') ELSE line END, '\s+'), lambda x: x <> '') AS words
 FROM (SELECT *, CASE WHEN barcode = '' THEN regexp_extract(line, '\b([A-Z]{{2}}[0-9]{{4,6}})\b', 1) ELSE '' END AS sku FROM (SELECT *, regexp_extract(line, '\b([0-9]{{13}}|[0-9]{{12}}|[0-9]{{8}})\b', 1) AS barcode FROM ({_SPEC_LINE})))))""")
def spec_fields_parsed(spark, d):
    part = table(spark, d, "part")
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    line = F.when(kind == 0, F.concat(F.lit("7290"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit(" "), F.upper("p_name"), F.lit(", ("), size, F.lit(") "), size))
    line = line.when(kind == 1, F.concat(F.lit("AB"), (F.col("p_partkey") + 10000).cast("string"), F.lit(" "), "p_name", F.lit(" 1/"), size, F.lit(" 2.5"))).when(kind == 2, F.concat("p_name", F.lit(" "), size, F.lit(" 313"))).otherwise(F.col("p_name"))
    return parse.spec_fields(part.select("p_partkey", line.alias("line"))).drop("line")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'מאוד טוב עולם ' || left(p_name, 3) || ' שלום' ELSE p_name END AS line, CASE WHEN p_partkey % 2 = 0 THEN ' שלום ' || left(p_name, 3) || '  עולם טוב מאוד' ELSE p_name END AS raw_text FROM (SELECT p_partkey, replace(p_name, ' ', '-') AS p_name FROM part)")
def reading_order(spark, d):
    name = F.replace("p_name", F.lit(" "), F.lit("-"))
    line = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" שלום "), F.substring(name, 1, 3), F.lit("  עולם טוב מאוד"))).otherwise(name)
    return parse.right_to_left(table(spark, d, "part").select("p_partkey", line.alias("line")))


_PICK_LINE = "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN replace(CAST(10000 + p_partkey AS VARCHAR), '0', 'O') ELSE CAST(10000 + p_partkey AS VARCHAR) END || ' ' || p_name || CASE p_partkey % 4 WHEN 0 THEN ' ' || p_size || ' cases' WHEN 1 THEN ' -' || p_size || '.5 unit' WHEN 2 THEN ' ' || p_size ELSE '' END AS line FROM part"


@query(f"SELECT p_partkey, CAST(10000 + p_partkey AS VARCHAR) AS sku, p_name AS name, CAST(CASE p_partkey % 4 WHEN 1 THEN -(p_size + 0.5) ELSE p_size END AS DOUBLE) AS quantity, CASE p_partkey % 4 WHEN 0 THEN 'case' WHEN 1 THEN 'unit' END AS unit FROM part JOIN ({_PICK_LINE}) USING (p_partkey) WHERE regexp_matches(line, '^\\s*(\\S+)\\s+(.+?)\\s+(-?\\d+(?:\\.\\d+)?)\\s*(cases?|units?)?\\s*$')")
def picking_lines_parsed(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    sku = (key + 10000).cast("string")
    tail = F.when(key % 4 == 0, F.concat(F.lit(" "), size, F.lit(" cases"))).when(key % 4 == 1, F.concat(F.lit(" -"), size, F.lit(".5 unit"))).when(key % 4 == 2, F.concat(F.lit(" "), size)).otherwise("")
    line = F.concat(F.when(key % 5 == 0, F.replace(sku, F.lit("0"), F.lit("O"))).otherwise(sku), F.lit(" "), "p_name", tail)
    return parse.picking_lines(table(spark, d, "part").select("p_partkey", line.alias("line"))).drop("line")


_SCRIPT = "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'שָׁלוֹם־עולם   ' || p_name || ' ' || p_size WHEN 1 THEN '  ' || p_brand || '-7.25 ' || p_size WHEN 2 THEN 'מים (' || p_size || ')' ELSE p_name END AS x FROM part"


@query(f"SELECT p_partkey, regexp_matches(x, '[א-ת]') AS hebrew, regexp_matches(x, '[א-ת]') AND regexp_matches(x, '[A-Za-z]') AS mixed, trim(regexp_replace(regexp_replace(x, '[\\x{{0591}}-\\x{{05C7}}]', '', 'g'), '\\s+', ' ', 'g')) AS plain, array_to_string(list_transform(regexp_extract_all(x, '[0-9]+'), lambda n: CAST(CAST(n AS BIGINT) AS VARCHAR)), ',') AS numbers, regexp_replace(x, '[^א-תa-zA-Z0-9-]', '', 'g') AS sku, regexp_replace(x, '[^0-9]', '', 'g') AS barcode, CASE WHEN regexp_extract(x, '[0-9]+') = '' THEN '0' ELSE regexp_extract(x, '[0-9]+') END AS quantity FROM ({_SCRIPT})")
def hebrew_fields(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    x = F.when(key % 4 == 0, F.concat(F.lit("שָׁלוֹם־עולם   "), "p_name", F.lit(" "), size)).when(key % 4 == 1, F.concat(F.lit("  "), "p_brand", F.lit("-7.25 "), size)).when(key % 4 == 2, F.concat(F.lit("מים ("), size, F.lit(")"))).otherwise(F.col("p_name"))
    rows = table(spark, d, "part").select("p_partkey", x.alias("x"))
    x = F.col("x")
    numbers = F.array_join(F.transform(T.numbers_in(x), lambda n: n.cast("string")), ",")
    return rows.select("p_partkey", T.has_hebrew(x).alias("hebrew"), T.is_mixed(x).alias("mixed"), T.normalize_hebrew(x).alias("plain"), numbers.alias("numbers"), T.clean_sku(x).alias("sku"), T.clean_barcode(x).alias("barcode"), T.clean_quantity(x).alias("quantity"))


@query("SELECT CASE WHEN p_partkey % 3 = 0 THEN 'he' ELSE 'en' END AS language, count(*) AS n FROM part GROUP BY 1")
def hebrew_languages(spark, d):
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("שלום עולם טוב מאוד "), F.substring("p_name", 1, 2))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select(T.language_mix(text).alias("language")).groupBy("language").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || '$' || format('{:,.2f}', abs(floor(c_acctbal * 100 + 0.5) / 100)) AS shown FROM customer")
def dollar_amounts(spark, d):
    return table(spark, d, "customer").select("c_custkey", N.dollars(F.col("c_acctbal")).alias("shown"))


@query("SELECT shown, count(*) AS n FROM (SELECT printf('%.1f%%', floor((1 - l_discount) * 1000 + 0.5) / 10) AS shown FROM lineitem) GROUP BY shown")
def confidence_percent(spark, d):
    return table(spark, d, "lineitem").select(N.percent_text(1 - F.col("l_discount")).alias("shown")).groupBy("shown").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, strftime(make_timestamp(ms * 1000), '%Y-%m-%d') || '-' || lower(to_base(ms, 36)) AS batch FROM (SELECT event_id, 1600000000000 + event_id * 86400007 AS ms FROM events)")
def batch_ids(spark, d):
    at = F.timestamp_millis(F.lit(1600000000000) + F.col("event_id") * 86400007)
    day = F.to_utc_timestamp(at, F.current_timezone())
    return table(spark, d, "events").select("event_id", F.concat(T.day_text(day), F.lit("-"), F.lower(F.element_at(F.split(T.batch_id(at), "-"), -1))).alias("batch"))


@query("SELECT event_id, CAST(least(greatest(value, 10), 100) AS DOUBLE) AS progress FROM events")
def progress_clamped(spark, d):
    return table(spark, d, "events").select("event_id", N.clamp(F.col("value"), 10.0, 100.0).alias("progress"))


@query("SELECT event_type, CASE WHEN count(*) > 0 THEN floor(CAST(count(*) FILTER (event_id % 3 = 0) AS DOUBLE) / count(*) * 100 * 10 + 0.5) / 10 ELSE 0 END AS percent FROM events GROUP BY event_type")
def share_processed(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("event_id") % 3 == 0).alias("part"), F.count(F.lit(1)).alias("all")).select("event_type", N.share_percent(F.col("part"), F.col("all")).alias("percent"))


# catalog and orders


@query(f"SELECT sku, name, category FROM ({_CAT}) WHERE sku = '10042'")
def product_by_sku(spark, d):
    return C.by_sku(catalog(spark, d), "10042").select("sku", "name", "category")


@query(f"SELECT sku, name FROM ({_CAT}) WHERE sku NOT IN ('10001', '10002', '10077')")
def catalog_without(spark, d):
    return C.without(catalog(spark, d), "10001", "10002", "10077").select("sku", "name")


@query(f"SELECT sku, name, brand, price, CASE WHEN load_seq % 2 = 0 THEN 'R' || sku END AS shelf FROM ({_CAT}) WHERE load_seq % 3 <> 0 OR load_seq % 2 = 0".replace("name, brand, price, CASE", "CASE WHEN load_seq % 3 <> 0 THEN name END AS name, CASE"))
def merge_new_fields(spark, d):
    left = catalog(spark, d).where("load_seq % 3 <> 0").select("sku", "name")
    return C.merged(left, catalog(spark, d).where("load_seq % 2 = 0").select("sku", F.concat(F.lit("R"), "sku").alias("shelf")))


@query(f"SELECT DISTINCT category FROM ({_CAT}) WHERE category <> ''")
def catalog_values(spark, d):
    return C.values_of(catalog(spark, d), "category")


@query(f"SELECT 'products' AS what, CAST(count(*) AS VARCHAR) AS value FROM ({_CAT}) UNION ALL SELECT 'category', category FROM (SELECT DISTINCT category FROM ({_CAT})) UNION ALL SELECT 'supplier', s FROM (SELECT DISTINCT 'S' || (load_seq % 10) AS s FROM ({_CAT}) WHERE load_seq % 5 <> 0)")
def catalog_stats(spark, d):
    known = catalog(spark, d).withColumn("supplier", F.when(F.col("load_seq") % 5 != 0, F.concat(F.lit("S"), (F.col("load_seq") % 10).cast("string"))))
    found = engine.stats(known)
    rows = found["statistics"].select(F.lit("products").alias("what"), F.col("products").cast("string").alias("value"))
    for what, name in (("category", "categories"), ("supplier", "suppliers")):
        rows = rows.unionByName(found[name].select(F.lit(what).alias("what"), F.col(what).alias("value")))
    return rows


@query(f"SELECT sku, name, CAST(row_number() OVER (ORDER BY name, sku) AS INT) AS place FROM ({_CAT})")
def order_by_name(spark, d):
    return ordering.placed(catalog(spark, d).select("sku", "name"), [*ordering.by_name(), F.col("sku").asc()]).withColumn("place", F.col("place").cast("int"))


@query("SELECT sku, CAST(row_number() OVER (ORDER BY TRY_CAST(sku AS BIGINT) NULLS LAST, sku) AS INT) AS place FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'K' || p_partkey ELSE CAST(p_partkey AS VARCHAR) END AS sku FROM part)")
def order_mixed_skus(spark, d):
    key = F.col("p_partkey").cast("string")
    return ordering.placed(table(spark, d, "part").select(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("K"), key)).otherwise(key).alias("sku")), ordering.by_sku()).withColumn("place", F.col("place").cast("int"))


@query(f"SELECT category, count(*) AS n, CAST(row_number() OVER (ORDER BY category) AS INT) AS place FROM ({_CAT}) GROUP BY category")
def groups_by_label(spark, d):
    groups = catalog(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return ordering.placed(groups, ordering.by_label("category")).withColumn("place", F.col("place").cast("int"))


@query("SELECT CAST(n_regionkey AS VARCHAR) AS city_id, CAST(n_nationkey AS VARCHAR) AS delivery_route, 25 - n_nationkey AS sort_order, CAST(row_number() OVER (ORDER BY n_regionkey, 25 - n_nationkey) AS INT) AS place FROM nation")
def routes_in_order(spark, d):
    nation = table(spark, d, "nation")
    routes = nation.select(F.col("n_nationkey").cast("string").alias("routeId"), (25 - F.col("n_nationkey")).cast("int").alias("sortOrder"))
    rows = nation.select(F.col("n_regionkey").cast("string").alias("city_id"), F.col("n_nationkey").cast("string").alias("delivery_route"))
    return ordering.placed(places.with_route_order(rows, routes), places.route_order()).withColumnRenamed("sortOrder", "sort_order").withColumn("place", F.col("place").cast("int"))


@query(f"SELECT warning, count(*) AS n FROM (SELECT CASE WHEN rule_allows IS NULL THEN 'missing_rule' WHEN product_allows IS NULL THEN 'missing_product' WHEN NOT coalesce(quantity >= 0, false) THEN 'invalid_quantity' END AS warning FROM ({_CALCED})) WHERE warning IS NOT NULL GROUP BY warning")
def batch_warning_rows(spark, d):
    return totals.batch_warnings(_calculated(spark, d), ["job_id", "page", "row"]).groupBy("warning").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT sku, {_D('quantity', 'quantity')}, {_D('CASE WHEN allows THEN quantity ELSE 0 END', 'units')}, {_D('CASE WHEN NOT allows THEN quantity ELSE 0 END', 'cases')}, CAST(CASE WHEN bool_or(known) THEN 1.0 ELSE 0.5 END AS DOUBLE) AS confidence, count(*) AS \"rowCount\" FROM (SELECT CAST(10000 + p_partkey AS VARCHAR) AS sku, CAST(p_size AS DECIMAL(18,3)) AS quantity, p_size % 2 = 0 AS allows, p_partkey % 10 <> 0 AS known FROM part WHERE p_partkey % 10 <> 0 UNION ALL SELECT CAST(10000 + p_partkey AS VARCHAR), CAST(p_size AS DECIMAL(18,3)), NULL, false FROM part WHERE p_partkey % 10 = 0) GROUP BY sku")
def batch_products(spark, d):
    line = F.concat((F.col("p_partkey") + 10000).cast("string"), F.lit(" "), "p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit(" cases"))
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("job_id"), F.lit(1).alias("page"), line.alias("text"))
    listed = [r.asDict() for r in rules.name_rules(spark).collect()]  # a short configuration
    return engine.batch(rows, catalog(spark, d, True), listed).products.select("sku", "quantity", "units", "cases", "confidence", "rowCount")


# rules from a configuration

#: A rule catalog: changed limits and severities, a rule switched off, one without its limits and one of an unknown kind.
CONFIGURED = [
    {"id": "R001", "ruleType": "UNIT_TYPE_ENFORCEMENT", "enabled": True, "severity": "warn"},
    {"id": "R002", "ruleType": "QUANTITY_RANGE", "enabled": True, "severity": "fail", "params": {"min": 0, "max": 40}},
    {"id": "R003", "ruleType": "PRODUCT_RESOLVED", "enabled": True, "severity": "fail"},
    {"id": "R004", "ruleType": "CONFIDENCE_THRESHOLD", "enabled": True, "severity": "warn", "params": {"threshold": 95}},
    {"id": "R005", "ruleType": "DUPLICATE_DETECTION", "enabled": False, "severity": "warn"},
    {"id": "R006", "ruleType": "ZERO_TOTAL", "enabled": True, "severity": "warn"},
    {"id": "R007", "ruleType": "UNUSUALLY_HIGH_QUANTITY", "enabled": True, "severity": "warn", "params": {"threshold": 100}},
    {"id": "R008", "ruleType": "CASE_ONLY_NAME_PATTERN", "enabled": True, "severity": "fail", "params": {"patterns": ["ar", "ue"]}},
    {"id": "R010", "ruleType": "CATALOG_OVERRIDES_HEURISTICS", "enabled": True, "severity": "fail"},
    {"id": "R011", "ruleType": "QUANTITY_RANGE", "enabled": True, "severity": "warn"},
    {"id": "R012", "ruleType": "SOMETHING_ELSE", "enabled": True, "severity": "fail"},
]


def _configured(spark, d):
    known = catalog(spark, d, True).select("sku", F.col("name").alias("_n"), (~F.col("allowUnits")).alias("case_only"))
    rows = picks(spark, d).drop("name").join(known, "sku", "left")
    rows = rows.withColumns({"name": F.coalesce("_n", F.lit("")), "product_key": F.when(F.col("_n").isNotNull(), F.col("sku")), "resolved_by": F.when(F.col("_n").isNotNull(), F.lit("sku")), "quantity": F.when(F.col("row") != 6, F.col("quantity")), "case_only": F.when(F.col("row") != 5, F.col("case_only"))})
    return rules.configured_checks(rows, CONFIGURED)


_CONFIGURED = f"""SELECT job_id, page, row_, [{{'rule': 'R001', 'status': CASE WHEN coalesce(unit = 'unit' AND (case_only OR regexp_matches(name, '1/[0-9]+')), false) THEN 'warn' ELSE 'pass' END, 'code': NULL}},
 {{'rule': 'R002', 'status': CASE WHEN quantity IS NULL OR quantity NOT BETWEEN 0 AND 40 THEN 'fail' ELSE 'pass' END, 'code': CASE WHEN quantity IS NULL THEN 'RULE_ERROR' END}},
 {{'rule': 'R003', 'status': CASE WHEN NOT known THEN 'fail' ELSE 'pass' END, 'code': NULL}},
 {{'rule': 'R004', 'status': CASE WHEN confidence * 100 < 95 THEN 'warn' ELSE 'pass' END, 'code': NULL}},
 {{'rule': 'R008', 'status': CASE WHEN CASE WHEN case_only IS NOT NULL THEN case_only ELSE contains(name, 'ar') OR contains(name, 'ue') END AND unit = 'unit' THEN 'fail' ELSE 'pass' END, 'code': NULL}},
 {{'rule': 'R011', 'status': 'fail', 'code': 'RULE_ERROR'}}] AS results
 FROM (SELECT p.job_id, p.page, p.row_, p.unit, CASE WHEN p.row_ <> 6 THEN p.quantity END AS quantity, p.confidence, c.sku IS NOT NULL AS known, coalesce(c.name, '') AS name, CASE WHEN p.row_ <> 5 THEN NOT c.allowUnits END AS case_only FROM ({_PICKS}) p LEFT JOIN ({_KNOWN}) c ON p.sku = c.sku)"""


@query(f"SELECT r.rule, r.status, coalesce(r.code, '') AS code, count(*) AS n FROM (SELECT unnest(results) AS r FROM ({_CONFIGURED})) GROUP BY r.rule, r.status, r.code")
def configured_rules(spark, d):
    return rules.keyed_results(_configured(spark, d)).groupBy("rule", "status", F.coalesce("code", F.lit("")).alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT job_id, page, row_ AS row, r.rule, r.status FROM (SELECT job_id, page, row_, unnest(results) AS r FROM ({_CONFIGURED})) WHERE r.code = 'RULE_ERROR' AND r.rule = 'R002'")
def keyed_rule_results(spark, d):
    return rules.keyed_results(_configured(spark, d)).where("code = 'RULE_ERROR' and rule = 'R002'").drop("code")


@query(f"SELECT product_key, cases, units, rule, 'warn' AS status FROM (SELECT sku AS product_key, {_CASES}, {_UNITS} FROM (SELECT job_id, sku, unit, CASE WHEN CAST(sku AS INT) % 9 = 0 THEN 0 ELSE quantity END AS quantity FROM ({_PICKS})) GROUP BY job_id, sku), LATERAL (SELECT unnest(list_filter([CASE WHEN cases = 0 AND units = 0 THEN 'R006' END, CASE WHEN cases > 100 OR units > 100 THEN 'R007' END], lambda x: x IS NOT NULL)) AS rule)")
def configured_total_rules(spark, d):
    rows = picks(spark, d).withColumns({"product_key": F.col("sku"), "quantity": F.when(F.col("sku").cast("int") % 9 == 0, 0).otherwise(F.col("quantity")).cast("decimal(18,3)")})
    return rules.total_checks(totals.job_totals(totals.page_totals(rows, sources=False)), CONFIGURED).drop("job_id", "row_count")


@query("SELECT p_partkey, CASE WHEN starts_with(lower(p_name), 'blue') THEN 'B' WHEN regexp_matches(p_name, '^[a-m].*t$') THEN 'X' WHEN contains(p_name, 'a') THEN 'C' END AS rule_id, CASE WHEN starts_with(lower(p_name), 'blue') THEN 4 WHEN regexp_matches(p_name, '^[a-m].*t$') THEN 7 WHEN contains(p_name, 'a') THEN 9 END AS rule_pack_size, CASE WHEN starts_with(lower(p_name), 'blue') THEN true WHEN regexp_matches(p_name, '^[a-m].*t$') THEN false WHEN contains(p_name, 'a') THEN true END AS rule_allows FROM part")
def name_rule_kinds(spark, d):
    listed = [{"id": "C", "priority": 9, "type": "contains", "value": "a", "packSize": 9, "allowUnits": True}, {"id": "B", "priority": 1, "type": "brand", "value": "Blue", "packSize": 4, "allowUnits": True}, {"id": "X", "priority": 5, "type": "regex", "value": "^[a-m].*t$", "packSize": 7, "allowUnits": False}]
    return rules.match_names(table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name")), listed).drop("name")


@query(f"SELECT p_partkey, CASE WHEN regexp_matches(name, '1/[0-9]+') THEN 'case' WHEN regexp_matches(name, '\\([0-9]+\\)') THEN 'unit' WHEN p_partkey % 5 = 0 THEN 'case' WHEN p_partkey % 5 = 1 THEN 'unit' ELSE 'case' END AS unit_type FROM ({_NAMED})")
def unit_type_heuristics_first(spark, d):
    key = F.col("p_partkey") % 5
    return _named(spark, d).select("p_partkey", rules.unit_type(F.col("name"), F.when(key == 0, True).when(key == 1, False), catalog_first=False).alias("unit_type"))


@query("SELECT rule, status, count(*) AS n FROM (SELECT unnest([{'rule': 'R008', 'status': CASE WHEN CASE WHEN case_only IS NOT NULL THEN case_only ELSE fraction END AND unit = 'unit' THEN 'fail' ELSE 'pass' END}, {'rule': 'R009', 'status': CASE WHEN bracket AND NOT fraction AND unit = 'case' THEN 'warn' ELSE 'pass' END}], recursive := true) FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'unit' ELSE 'case' END AS unit, CASE WHEN p_partkey % 5 = 0 THEN true WHEN p_partkey % 5 = 1 THEN false END AS case_only, contains(name, '1/8') OR contains(name, '1/12') OR contains(name, '1/20') OR contains(name, '1/24') AS fraction, contains(name, '(6)') OR contains(name, '(8)') OR contains(name, '(9)') OR contains(name, '(12)') OR contains(name, '(18)') OR contains(name, '(24)') AS bracket FROM (" + _NAMED + "))) GROUP BY rule, status")
def name_pattern_checks(spark, d):
    key = F.col("p_partkey")
    checks = rules.pattern_checks(F.col("name"), F.when(key % 2 == 0, "unit").otherwise("case"), F.when(key % 5 == 0, True).when(key % 5 == 1, False))
    return _named(spark, d).select(F.explode(checks).alias("r")).groupBy("r.rule", "r.status").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT job_id, page, sku, unit, CAST(quantity AS DOUBLE) AS quantity, (unit = 'unit')::INT AS matched, CASE WHEN quantity > 40 THEN 'many; ' ELSE '' END || 'Y: unsupported rule; Z: RULE_ERROR KeyError(''value'')' AS warnings FROM ({_PICKS})".replace("CAST(quantity AS DOUBLE) AS quantity, (unit", "CAST(CASE WHEN unit = 'unit' THEN 1 ELSE quantity END AS DOUBLE) AS quantity, (unit").replace("WHEN quantity > 40", "WHEN CASE WHEN unit = 'unit' THEN 1 ELSE quantity END > 40"))
def loaded_rules(spark, d):
    made = rules.RuleEngine.standard()
    base = {"enabled": True, "conditionType": "equals", "conditionParams": {"field": "unit", "value": "unit"}, "actionType": "set_quantity", "actionParams": {"value": 1}}
    made.load([
        {**base, "id": "M", "priority": 20, "conditionType": "range", "conditionParams": {"field": "quantity", "min": 40.001, "max": 1e9}, "actionType": "warn", "actionParams": {"message": "many"}},
        {**base, "id": "U", "priority": 10},
        {**base, "id": "X", "priority": 5, "enabled": False, "actionParams": {"value": 99}},
        {**base, "id": "Y", "priority": 30, "conditionType": "unheard_of"},
        {**base, "id": "Z", "priority": 40, "actionParams": {}},
    ])
    rows = made.run(picks(spark, d).select("job_id", "page", "sku", "unit", "quantity"))
    hit = F.size(F.filter("executed", lambda r: r["matched"] & (r["rule"] == "U")))
    return rows.select("job_id", "page", "sku", "unit", "quantity", hit.alias("matched"), F.array_join("warnings", "; ").alias("warnings"))


@query(f"SELECT code, message, count(*) AS n FROM (SELECT CASE WHEN sku = '10042' THEN 'PRODUCT_NOT_FOUND' WHEN city_id = 'UNASSIGNED' THEN 'CITY_UNRESOLVED' WHEN delivery_route = 'UNASSIGNED_ROUTE' THEN 'ROUTE_UNRESOLVED' END AS code, CASE WHEN sku = '10042' THEN 'no product' WHEN city_id = 'UNASSIGNED' THEN 'no city' WHEN delivery_route = 'UNASSIGNED_ROUTE' THEN 'no route' END AS message FROM ({_PLACED})) WHERE code IS NOT NULL GROUP BY code, message")
def coded_errors(spark, d):
    rows = _placed(spark, d).withColumn("product_key", F.when(F.col("sku") != "10042", F.col("sku"))).withColumn("error", services.row_error())
    return services.err(rows).groupBy("code", "message").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT count(*) AS n FROM ({_PLACED}) WHERE sku <> '10042' AND city_id <> 'UNASSIGNED' AND delivery_route <> 'UNASSIGNED_ROUTE'")
def rows_without_errors(spark, d):
    rows = _placed(spark, d).withColumn("product_key", F.when(F.col("sku") != "10042", F.col("sku"))).withColumn("error", services.row_error())
    return services.ok(rows).agg(F.count(F.lit(1)).alias("n"))


# corrections and similarity

_MISREAD = [{"misread": "smal1 widget", "correction": "small widget"}, {"misread": "101 b01t", "correction": "IOI bolt"}]
_SCANNED = "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ' smaIl widget ' WHEN 1 THEN 'smal1 widget' WHEN 2 THEN 'IOl bO1t' ELSE p_name || ' S' || p_size || 'B' END AS x FROM part"
_TOKENS = "array_to_string(list_transform(string_split(a, ' '), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN translate(t, 'OIlSB', '01158') ELSE t END), ' ')"
_GRADE = "CASE WHEN confidence > 0.98 THEN 'Excellent' WHEN confidence > 0.90 THEN 'Good' ELSE 'Needs Review' END AS status"


@query(f"SELECT p_partkey, text, corrections, confidence, {_GRADE} FROM (SELECT p_partkey, c AS text, corrections, 1 - corrections * 0.05::DOUBLE AS confidence FROM (SELECT *, (a <> b)::INT + (b <> c)::INT AS corrections FROM (SELECT *, CASE b WHEN 'smal1 widget' THEN 'small widget' WHEN '101 b01t' THEN 'IOI bolt' ELSE b END AS c FROM (SELECT *, {_TOKENS} AS b FROM (SELECT p_partkey, trim(x) AS a FROM ({_SCANNED}))))))")
def text_corrections(spark, d):
    key, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    x = F.when(key == 0, " smaIl widget ").when(key == 1, "smal1 widget").when(key == 2, "IOl bO1t").otherwise(F.concat("p_name", F.lit(" S"), size, F.lit("B")))
    found = corrections.corrected(table(spark, d, "part").select("p_partkey", x.alias("text")), _MISREAD)
    return found.select("p_partkey", "correction.text", F.size("correction.corrections").alias("corrections"), "correction.confidence", "correction.status")


@query(f"SELECT sku, text, corrections, confidence, {_GRADE} FROM (SELECT sku, text, corrections, 1 - corrections * 0.05::DOUBLE AS confidence FROM (SELECT sku, e AS text, (a <> b)::INT + (b <> c)::INT + (c <> e)::INT AS corrections FROM (SELECT *, CASE WHEN regexp_full_match(c, '[0-9]{{12,13}}') THEN code || CAST({_EAN} AS VARCHAR) ELSE c END AS e FROM (SELECT *, left(CASE WHEN regexp_full_match(c, '[0-9]{{12,13}}') THEN c ELSE '000000000000' END, 12) AS code FROM (SELECT *, regexp_replace(b, '[^0-9-]', '', 'g') AS c FROM (SELECT sku, a, CASE WHEN regexp_matches(a, '[0-9]') THEN translate(a, 'OIlSB', '01158') ELSE a END AS b FROM (SELECT sku, CASE load_seq % 3 WHEN 0 THEN replace(barcode, '0', 'O') WHEN 1 THEN 'x' || left(barcode, 12) ELSE sku END AS a FROM ({_CAT}))))))))")
def sku_corrections(spark, d):
    key = F.col("load_seq") % 3
    x = F.when(key == 0, F.replace("barcode", F.lit("0"), F.lit("O"))).when(key == 1, F.concat(F.lit("x"), F.substring("barcode", 1, 12))).otherwise(F.col("sku"))
    found = corrections.corrected_skus(catalog(spark, d).select("sku", x.alias("raw")), "raw")
    return found.select("sku", "correction.text", F.size("correction.corrections").alias("corrections"), "correction.confidence", "correction.status")


def scored(pairs: str) -> str:
    """SQL of (a, b, score) for the distinct pairs (a, b) of plain lower-case texts of ``pairs``, by a recursion over a's characters."""
    return f"""(WITH RECURSIVE pairs AS (SELECT DISTINCT a, b FROM ({pairs})), st AS (SELECT a, b, 0 AS i, b AS rest, '' AS mine FROM pairs
 UNION ALL SELECT a, b, i + 1, CASE WHEN p > 0 THEN left(rest, lo + p - 1) || chr(1) || substr(rest, lo + p + 1) ELSE rest END, CASE WHEN p > 0 THEN mine || c ELSE mine END
 FROM (SELECT *, strpos(substr(rest, lo + 1, greatest(hi - lo, 0)), c) AS p FROM (SELECT *, substr(a, i + 1, 1) AS c, greatest(0, i - r) AS lo, least(len(b), i + r + 1) AS hi FROM (SELECT *, greatest(len(a), len(b)) // 2 - 1 AS r FROM st) WHERE i < len(a)))),
 done AS (SELECT a, b, mine, CAST(len(mine) AS DOUBLE) AS m, array_to_string(list_transform(list_filter(range(1, len(b) + 1), lambda j: substr(rest, j, 1) = chr(1)), lambda j: substr(b, j, 1)), '') AS theirs FROM st WHERE i = len(a)),
 j AS (SELECT *, (m / len(a) + m / len(b) + (m - len(list_filter(range(1, len(mine) + 1), lambda k: substr(mine, k, 1) <> substr(theirs, k, 1))) / 2.0::DOUBLE) / m) / 3 AS jaro, CAST(CASE WHEN left(a, 1) <> left(b, 1) THEN 0 WHEN left(a, 2) <> left(b, 2) OR least(len(a), len(b)) < 2 THEN 1 WHEN left(a, 3) <> left(b, 3) OR least(len(a), len(b)) < 3 THEN 2 WHEN left(a, 4) <> left(b, 4) OR least(len(a), len(b)) < 4 THEN 3 ELSE 4 END AS DOUBLE) AS same FROM done)
 SELECT a, b, CASE WHEN m = 0 THEN 0.0::DOUBLE ELSE jaro + same * 0.1::DOUBLE * (1 - jaro) END AS jaro_winkler, CASE WHEN a = b THEN 1.0::DOUBLE ELSE 0.4::DOUBLE * (1 - CAST(levenshtein(a, b) AS DOUBLE) / greatest(len(a), len(b))) + 0.6::DOUBLE * CASE WHEN m = 0 THEN 0.0::DOUBLE ELSE jaro + same * 0.1::DOUBLE * (1 - jaro) END END AS score FROM j)"""


_MET = "SELECT left(p_name, 5) || 'x' || substr(p_name, 6) AS name FROM part"
_SCORED = f"SELECT n.name, c.candidate, c.cand_seq, s.score FROM (SELECT DISTINCT name FROM ({_MET})) n, (SELECT p_name AS candidate, min(p_partkey) AS cand_seq FROM part GROUP BY p_name) c JOIN {scored(f'SELECT lower(trim(n.name)) AS a, lower(trim(p_name)) AS b FROM (SELECT DISTINCT name FROM ({_MET})) n, (SELECT DISTINCT p_name FROM part)')} s ON s.a = lower(trim(n.name)) AND s.b = lower(trim(c.candidate))"
ORACLE["nearest_product"] = f"SELECT name, arg_max(candidate, row(score, -cand_seq)) AS candidate, arg_max(cand_seq, row(score, -cand_seq)) AS cand_seq, max(score) AS score FROM ({_SCORED}) WHERE score > 0.7 GROUP BY name"
ORACLE["find_matches"] = f"SELECT name, candidate, cand_seq, score FROM ({_SCORED}) WHERE score >= 0.7"
ORACLE["top_n_matches"] = f"SELECT name, candidate, cand_seq, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, cand_seq) AS rank FROM ({_SCORED})) WHERE rank <= 3"


@query(f"SELECT p.left_key, p.right_key, s.jaro_winkler, s.score FROM (SELECT x.p_partkey AS left_key, y.p_partkey AS right_key, lower(x.p_name) AS a, lower(y.p_name) AS b FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1) p JOIN {scored('SELECT lower(x.p_name) AS a, lower(y.p_name) AS b FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1')} s ON s.a = p.a AND s.b = p.b")
def similarity_pairs(spark, d):
    S.register(spark)
    part = table(spark, d, "part")
    a, b = part.select(F.col("p_partkey").alias("left_key"), F.col("p_name").alias("a")), part.select(F.col("p_partkey").alias("right_key"), F.col("p_name").alias("b"))
    return a.join(b, F.col("right_key") == F.col("left_key") + 1).select("left_key", "right_key", F.expr("jaro_winkler(lower(a), lower(b))").alias("jaro_winkler"), F.expr("similarity_score(a, b)").alias("score"))


@query(f"SELECT p.p_partkey, coalesce(m.candidate, p.x) AS text, CASE WHEN m.candidate <> p.x THEN 1 ELSE 0 END AS corrections FROM (SELECT p_partkey, left(p_name, 5) || 'x' || substr(p_name, 6) AS x FROM part) p LEFT JOIN (SELECT name, arg_max(candidate, row(score, -cand_seq)) AS candidate FROM ({_SCORED}) WHERE score > 0.85 GROUP BY name) m ON m.name = p.x")
def name_corrections(spark, d):
    asked, candidates = _names(spark, d)
    rows = table(spark, d, "part").select("p_partkey", F.concat(F.substring("p_name", 1, 5), F.lit("x"), F.expr("substring(p_name, 6)")).alias("name"))
    found = corrections.corrected_names(rows, candidates, [])
    return found.select("p_partkey", "correction.text", F.size("correction.corrections").alias("corrections"))


@query("SELECT p_partkey, replace(p_name, 'anvil', 'ANVIL') AS corrected, CAST(contains(p_name, 'anvil') AS INT) AS corrections FROM part")
def dictionary_corrections(spark, d):
    rows = fuzzy.dictionary_corrected(table(spark, d, "part").select("p_partkey", F.col("p_name").alias("text")), [{"misread": "anvil", "correction": "ANVIL", "context": "name"}])
    return rows.drop("text")


@query(f"SELECT p_partkey, corrections || CASE WHEN corrections = 1 THEN ' correction: ' ELSE ' corrections: ' END || array_to_string(list_filter([CASE WHEN a <> b THEN 'character' END, CASE WHEN b <> c THEN 'dictionary' END], lambda x: x IS NOT NULL), ', ') AS message FROM (SELECT *, (a <> b)::INT + (b <> c)::INT AS corrections FROM (SELECT *, CASE b WHEN 'smal1 widget' THEN 'small widget' WHEN '101 b01t' THEN 'IOI bolt' ELSE b END AS c FROM (SELECT *, {_TOKENS} AS b FROM (SELECT p_partkey, trim(x) AS a FROM ({_SCANNED}))))) WHERE corrections > 0")
def correction_messages(spark, d):
    key, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    x = F.when(key == 0, " smaIl widget ").when(key == 1, "smal1 widget").when(key == 2, "IOl bO1t").otherwise(F.concat("p_name", F.lit(" S"), size, F.lit("B")))
    found = corrections.corrected(table(spark, d, "part").select("p_partkey", x.alias("text")), _MISREAD)
    return found.where(F.size("correction.corrections") > 0).select("p_partkey", "correction.message")


# catalogs from lists, versions and seeds; settings; services


@query(f"SELECT category, sku, CAST(quantity AS DOUBLE) AS quantity, CAST(row_number() OVER (ORDER BY category, CAST(sku AS BIGINT)) AS INT) AS place FROM (SELECT p.sku, p.quantity, coalesce(c.category, 'Uncategorized') AS category FROM ({_PROD}) p LEFT JOIN ({_KNOWN}) c ON p.sku = c.sku)")
def flattened_groups_in_order(spark, d):
    rows = C.with_default(products(spark, d), catalog(spark, d, True), "category", "Uncategorized").select("category", "sku", "quantity")
    return rollups.flattened_in_order(rows, "category", ordering.by_sku()).withColumn("place", F.col("place").cast("int"))


_SEEDS = "(VALUES " + ", ".join(str((a, e, f)) for a, _, _, e, f, _ in seeds.PRODUCTS) + ") s(sku, brand, packSize)"


@query(f"SELECT brand, count(*) AS products, CAST(sum(packSize) AS BIGINT) AS packs FROM (SELECT sku, brand, packSize FROM ({_CAT}) UNION ALL SELECT sku, brand, packSize FROM {_SEEDS} WHERE sku NOT IN (SELECT sku FROM ({_CAT}))) GROUP BY brand")
def seeded_catalog(spark, d):
    seeds.reset_catalog(spark)
    seeds.set_catalog(C.upserted(seeds.get_catalog(spark).select("sku", "brand", "packSize"), catalog(spark, d).select("sku", "brand", "packSize")))
    found = seeds.get_catalog(spark).groupBy("brand").agg(F.count(F.lit(1)).alias("products"), F.sum("packSize").alias("packs"))
    return found


@query("SELECT n_name AS name, CAST(n_nationkey AS VARCHAR) AS cityId, n_regionkey % 2 = 0 AS active, '1.10.0' AS version FROM nation WHERE n_nationkey >= 3")
def versioned_catalog(spark, d):
    path = scratch(spark)
    nation = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("cityId"), F.col("n_name").alias("name"), (F.col("n_regionkey") % 2 == 0).alias("active"))
    for version, some in (("1.9.2", nation), ("1.10.0", nation.where("cast(cityId as int) >= 3"))):
        # a catalog file is one object, with its 25 cities in a list
        some.agg(F.collect_list(F.struct("cityId", "name", "active")).alias("cities")).select(F.lit(version).alias("version"), "cities").write.mode("append").json(path)
    rows = readers.highest_version(readers.versioned(spark, path, "cities", "cityId STRING, name STRING, active BOOLEAN"))
    return rows.select("name", "cityId", "active", "version")


@query("SELECT r.name AS region, count(*) AS nations FROM (SELECT DISTINCT CAST(r_regionkey AS VARCHAR) AS sku, r_name AS name FROM region) r JOIN nation ON CAST(n_regionkey AS VARCHAR) = r.sku GROUP BY r.name")
def catalog_from_list(spark, d):
    given = [(str(r.r_regionkey), None, r.r_name, 1, True, None, None, None) for r in table(spark, d, "region").collect()]  # the five regions, as a list that a caller has
    entries, _ = readers.loaded(C.last_wins(readers.catalog_rows(spark, given + given)))
    nations = table(spark, d, "nation").select(F.col("n_regionkey").cast("string").alias("sku"))
    return nations.join(entries.select("sku", F.col("name").alias("region")), "sku").groupBy("region").agg(F.count(F.lit(1)).alias("nations"))


@query("SELECT setting, level, count(*) AS n FROM (SELECT *, CASE event_id % 5 WHEN 0 THEN 'debug' WHEN 1 THEN 'info' WHEN 2 THEN 'warn' WHEN 3 THEN 'error' ELSE 'loud' END AS level FROM events), (VALUES ('warn'), ('debug'), ('nonsense')) v(setting) WHERE (setting = 'warn' AND level IN ('warn', 'error')) OR (setting = 'debug' AND level <> 'loud') OR (setting = 'nonsense' AND level IN ('info', 'warn', 'error')) GROUP BY setting, level")
def messages_shown(spark, d):
    kind = F.col("event_id") % 5
    level = F.when(kind == 0, "debug").when(kind == 1, "info").when(kind == 2, "warn").when(kind == 3, "error").otherwise("loud")
    rows = table(spark, d, "events").select(level.alias("level"))
    out = None
    for setting in ("warn", "debug", "nonsense"):
        some = rows.where(Config.load({"TALLY_LOG_LEVEL": setting}).shown(F.col("level"))).select(F.lit(setting).alias("setting"), "level")
        out = some if out is None else out.unionByName(some)
    return out.groupBy("setting", "level").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, strftime(make_timestamp(ms * 1000), '%Y-%m-%d') || '-' || upper(to_base(ms, 36)) AS batch FROM (SELECT event_id, 1600000000000 + event_id * 3600011 AS ms FROM events)")
def batch_ids_utc(spark, d):
    return table(spark, d, "events").select("event_id", T.batch_id_utc(F.lit(1600000000000) + F.col("event_id") * 3600011).alias("batch"))


@query(f"SELECT CAST(10000 + p_partkey AS VARCHAR) AS product_key, CAST(CASE WHEN p_size % 2 = 0 THEN 0 ELSE p_size END AS DOUBLE) AS cases, CAST(CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END AS DOUBLE) AS units, 1 AS row_count FROM part WHERE p_partkey % 10 <> 0")
def service_pipeline(spark, d):
    line = F.concat((F.col("p_partkey") + 10000).cast("string"), F.lit(" "), "p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit(" cases"))
    pages = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("job_id"), F.lit(1).alias("page"), line.alias("text"))
    return engine.standard_services().run(pages, catalog(spark, d, True))


_SHEET = "SELECT CAST(o_custkey AS VARCHAR) AS job_id, o_orderkey, CAST(10000 + o_orderkey % 50 AS VARCHAR) AS sku, o_orderkey % 90 AS quantity, o_orderkey % 6 = 0 AS twice FROM orders"


@query(f"SELECT 'total' AS what, sku, CAST(sum(quantity * CASE WHEN twice THEN 2 ELSE 1 END) AS DOUBLE) AS quantity, CAST(sum(CASE WHEN twice THEN 2 ELSE 1 END) AS BIGINT) AS row_count FROM ({_SHEET}) GROUP BY sku UNION ALL SELECT 'twice', sku, NULL, count(*) FROM ({_SHEET}) WHERE twice GROUP BY sku")
def stream_pages_sent_again(spark, d):
    path, key = scratch(spark), F.col("o_orderkey")
    sku, orders = (F.lit(10000) + key % 50).cast("string"), table(spark, d, "orders")
    line = lambda amount: F.concat(sku, F.lit(" "), F.lit("7290"), F.lpad(sku, 9, "0"), F.lit(" x "), amount.cast("string"))
    last = F.concat(line(key % 90), F.when(key % 6 == 0, F.concat(F.lit("\n"), line(key % 90))).otherwise(""))
    page = lambda rows, text, version: rows.select(F.col("o_custkey").cast("string").alias("job_id"), key.cast("int").alias("page"), text.alias("text"), F.lit(version).alias("version"))
    run = lambda: stream.append_signed(stream.arriving_versions(spark, f"{path}/in"), catalog(spark, d), f"{path}/out", f"{path}/state").awaitTermination()
    page(orders.where("o_orderkey % 3 <> 0"), line(key % 90 + 1), 1).unionByName(page(orders.where("o_orderkey % 5 = 0"), last, 2)).write.mode("append").json(f"{path}/in")
    run()
    # all again with the last version, some late with the first
    page(orders, last, 2).unionByName(page(orders.where("o_orderkey % 2 = 0"), line(key % 7), 1)).write.mode("append").json(f"{path}/in")
    run()
    rows = spark.read.parquet(f"{path}/out")
    sums = stream.signed_totals(rows, "sku").select(F.lit("total").alias("what"), "sku", F.col("total_quantity").cast("double").alias("quantity"), "row_count")
    twice = stream.signed_duplicates(rows).groupBy("sku").agg(F.count(F.lit(1)).alias("row_count"))
    return sums.unionByName(twice.select(F.lit("twice").alias("what"), "sku", F.lit(None).cast("double").alias("quantity"), "row_count"))
