"""Queries over the star-schema tables, each with the SQL that gives the same rows.

Parts stand for the catalog, lines for picking rows, suppliers, nations and regions for suppliers, routes and
cities; texts are put together from them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..operators import catalog as C
from ..operators import fuzzy, lineage, ordering, parse, places, regions, review, rollups, rules, totals
from ..operators.running import RunningTotals
from ..sources import writers
from ..sources.tables import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, folder: plain(f(spark, folder))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def plain(frame: DataFrame) -> DataFrame:
    """Decimals as doubles, for results that are compared across engines."""
    return frame.select(*[F.col(c).cast("double").alias(c) if kind.startswith("decimal") else F.col(c) for c, kind in frame.dtypes])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def catalog(spark: SparkSession, folder: str, known: bool = False) -> DataFrame:
    part = table(spark, folder, "part")
    part = part.where("p_partkey % 10 <> 0") if known else part
    key = F.col("p_partkey")
    return part.select((key + 10000).cast("string").alias("sku"), F.concat(F.lit("7290"), F.lpad(key.cast("string"), 9, "0")).alias("barcode"), F.col("p_name").alias("name"), F.col("p_size").alias("packSize"), (F.col("p_size") % 2 == 0).alias("allowUnits"), F.col("p_type").alias("category"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"), key.alias("load_seq"))


def picks(spark: SparkSession, folder: str) -> DataFrame:
    line = table(spark, folder, "lineitem")
    return line.select(F.col("l_orderkey").cast("string").alias("job_id"), F.col("l_orderkey").cast("string").alias("invoice"), F.col("l_linenumber").alias("page"), (F.col("l_partkey") % 7).cast("int").alias("row"), "l_suppkey", (F.col("l_partkey") + 10000).cast("string").alias("sku"), F.lit("").alias("barcode"), F.lit("").alias("name"), F.col("l_quantity").cast("decimal(18,3)").alias("quantity"), (1 - F.col("l_discount")).alias("confidence"), F.when(F.col("l_returnflag") == "R", "unit").otherwise("case").alias("unit"))


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """Three lines a page: a full one, one without numbers, and one that lacks a barcode, has no quantity, a zero or a negative one."""
    line, part = table(spark, folder, "lineitem"), table(spark, folder, "part")
    both = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    sku, barcode = (F.col("p_partkey") + 10000).cast("string"), F.concat(F.lit("7290"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
    amount = F.col("l_quantity").cast("int").cast("string")
    kind = F.col("l_orderkey") % 4
    odd = F.when(kind == 0, F.concat(sku, F.lit(" x "), amount)).when(kind == 1, F.concat(sku, F.lit(" "), barcode, F.lit(" none"))).when(kind == 2, F.concat(sku, F.lit(" "), barcode, F.lit(" -"), amount)).otherwise(F.lit("  "))
    text = F.concat(sku, F.lit(" "), barcode, F.lit(" "), "p_name", F.lit(" "), amount, F.lit("\nsheet "), F.col("l_linenumber").cast("string"), F.lit("\n"), odd)
    return both.select(F.col("l_orderkey").cast("string").alias("invoice"), text.alias("text"))


def enriched(spark: SparkSession, folder: str) -> DataFrame:
    return C.enrich(picks(spark, folder), catalog(spark, folder, known=True))


def products(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.product_rows(enriched(spark, folder).withColumn("warnings", F.array().cast("array<string>")))


_CAT = "SELECT CAST(10000 + p_partkey AS VARCHAR) AS sku, '7290' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS barcode, p_name AS name, p_size AS packSize, p_size % 2 = 0 AS allowUnits, p_type AS category, p_brand AS brand, p_retailprice AS price, p_partkey AS load_seq FROM part"
_KNOWN = _CAT + " WHERE p_partkey % 10 <> 0"
_PICKS = "SELECT CAST(l_orderkey AS VARCHAR) AS job_id, CAST(l_orderkey AS VARCHAR) AS invoice, l_linenumber AS page, CAST(l_partkey % 7 AS INT) AS row_, l_suppkey, CAST(l_partkey + 10000 AS VARCHAR) AS sku, CAST(l_quantity AS DECIMAL(18,3)) AS quantity, 1 - l_discount AS confidence, CASE WHEN l_returnflag = 'R' THEN 'unit' ELSE 'case' END AS unit FROM lineitem"
_ENR = f"SELECT p.*, c.sku IS NOT NULL AS known, coalesce(c.name, '') AS name, coalesce(c.barcode, '') AS barcode, CASE WHEN c.allowUnits THEN p.quantity ELSE 0 END AS units, CASE WHEN c.sku IS NOT NULL AND NOT c.allowUnits THEN p.quantity ELSE 0 END AS cases FROM ({_PICKS}) p LEFT JOIN ({_KNOWN}) c ON p.sku = c.sku"
_PROD = f"SELECT sku, min(barcode) AS barcode, min(name) AS name, sum(quantity) AS quantity, sum(cases) AS cases, sum(units) AS units, CAST(sum(CAST(confidence AS DECIMAL(18,6))) AS DOUBLE) / count(*) AS confidence, count(*) AS rowCount FROM ({_ENR}) GROUP BY sku"
_PAGES = "SELECT CAST(l_orderkey AS VARCHAR) AS invoice, CAST(10000 + p_partkey AS VARCHAR) || ' 7290' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') || ' ' || p_name || ' ' || CAST(CAST(l_quantity AS INT) AS VARCHAR) || chr(10) || 'sheet ' || CAST(l_linenumber AS VARCHAR) || chr(10) || CASE l_orderkey % 4 WHEN 0 THEN CAST(10000 + p_partkey AS VARCHAR) || ' x ' || CAST(CAST(l_quantity AS INT) AS VARCHAR) WHEN 1 THEN CAST(10000 + p_partkey AS VARCHAR) || ' 7290' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') || ' none' WHEN 2 THEN CAST(10000 + p_partkey AS VARCHAR) || ' 7290' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') || ' -' || CAST(CAST(l_quantity AS INT) AS VARCHAR) ELSE '  ' END AS text FROM lineitem JOIN part ON l_partkey = p_partkey"
_LINES = f"SELECT invoice, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS row_ FROM ({_PAGES})"
_FIELDS = rf"SELECT invoice, CAST(row_ AS INT) AS row_, line, regexp_extract(line, '\b([0-9]{{5}})\b', 1) AS sku, regexp_extract(line, '\b([0-9]{{13}})\b', 1) AS barcode, coalesce(TRY_CAST(regexp_extract(line, '(-?[0-9]+(?:\.[0-9]+)?)$', 1) AS DECIMAL(18,3)), 0) AS quantity FROM ({_LINES})"
_D = lambda x, name: f"CAST(CAST(sum({x}) AS DECIMAL(38,3)) AS DOUBLE) AS {name}"
_R2 = lambda x: f"floor(({x}) * 100 + 0.5) / 100"

_PARSED = f"SELECT f.invoice, f.row_, f.sku, f.quantity, coalesce(c.name, f.line) AS name, CASE WHEN c.allowUnits THEN f.quantity ELSE 0 END AS units, CASE WHEN c.sku IS NOT NULL AND NOT c.allowUnits THEN f.quantity ELSE 0 END AS cases, c.sku IS NOT NULL AS known FROM ({_FIELDS}) f LEFT JOIN ({_KNOWN}) c ON f.sku = c.sku WHERE f.sku <> '' AND f.barcode <> ''"


@query(f"SELECT sku, min(name) AS name, {_D('quantity', 'total_quantity')}, {_D('units', 'total_units')}, {_D('cases', 'total_cases')}, count(DISTINCT invoice) AS invoice_count FROM ({_PARSED}) GROUP BY sku")
def summarize_by_sku(spark, d):
    return rollups.summarize(parse.parse_table(pages(spark, d), catalog(spark, d, True)))


@query(f"SELECT invoice, row_ AS row, sku, CAST(quantity AS DOUBLE) AS quantity, name, CAST(units AS DOUBLE) AS units, CAST(cases AS DOUBLE) AS cases FROM ({_PARSED})")
def parse_table_lines(spark, d):
    return parse.parse_table(pages(spark, d), catalog(spark, d, True)).select("invoice", "row", "sku", "quantity", "name", "units", "cases")


@query(f"SELECT sku, count(*) AS n, {_D('quantity', 'quantity')} FROM ({_PARSED}) WHERE quantity > 0 AND NOT known GROUP BY sku")
def parse_with_tracking_unknown(spark, d):
    _, missing = parse.parse_with_tracking(pages(spark, d), catalog(spark, d, True))
    return missing.groupBy("sku").agg(F.count(F.lit(1)).alias("n"), rollups.total("quantity").alias("quantity"))


@query(rf"""SELECT error, count(*) AS n FROM (SELECT 'Line ' || row_ || ': ' || CASE WHEN sku = '' THEN 'No valid SKU found (5 digits)' WHEN barcode = '' THEN 'No valid barcode found (13 digits)'
 WHEN quantity = 0 THEN 'Quantity is 0' WHEN quantity < 0 THEN 'Negative quantity (' || CAST(CAST(quantity AS INT) AS VARCHAR) || ')' END AS error FROM ({_FIELDS}) WHERE trim(line) <> '') WHERE error IS NOT NULL GROUP BY error""")
def parse_validation_errors(spark, d):
    _, errors = parse.parse_with_validation(pages(spark, d), catalog(spark, d, True))
    return errors.groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT CAST(i - 1 AS INT) AS \"table\", count(*) AS n, {_D('quantity', 'quantity')} FROM (SELECT i, sku, barcode, quantity FROM (SELECT generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM ({_PAGES})), LATERAL (SELECT regexp_extract(line, '\\b([0-9]{{5}})\\b', 1) AS sku, regexp_extract(line, '\\b([0-9]{{13}})\\b', 1) AS barcode, coalesce(TRY_CAST(regexp_extract(line, '(-?[0-9]+(?:\\.[0-9]+)?)$', 1) AS DECIMAL(18,3)), 0) AS quantity)) WHERE sku <> '' AND barcode <> '' GROUP BY i")
def parse_multi_tables(spark, d):
    # the same lines, each a table of its own
    tables = pages(spark, d).withColumn("text", F.replace("text", F.lit("\n"), F.lit("---")))
    return parse.parse_multiple_tables(tables, catalog(spark, d, True)).groupBy("table").agg(F.count(F.lit(1)).alias("n"), rollups.total("quantity").alias("quantity"))


@query(f"SELECT sku, count(*) AS n, {_D('quantity', 'quantity')} FROM ({_PARSED}) WHERE row_ > 1 GROUP BY sku")
def parse_after_header(spark, d):
    rows = parse.parse_structured(pages(spark, d), catalog(spark, d, True), "sheet [0-9]+")
    return rows.groupBy("sku").agg(F.count(F.lit(1)).alias("n"), rollups.total("quantity").alias("quantity"))


_WORDS = """WITH w AS (SELECT p_partkey, line, list_filter(string_split_regex(line, '\\s+'), lambda x: x <> '') AS words FROM (SELECT p_partkey, p_name || '  ' || p_brand || ' ' || p_type || '   ' || p_size AS line FROM part)),
p AS (SELECT p_partkey, line, words, list_transform(range(1, len(words) + 1), lambda i: coalesce(list_sum(list_transform(words[1:i - 1], lambda x: len(x) + 1)), 0)) AS at_ FROM w)
SELECT p_partkey, """ + ", ".join(f"array_to_string(list_transform(list_filter(range(1, len(words) + 1), lambda i: CAST(at_[i] AS DOUBLE) / len(line) < {hi}/1200.0 AND CAST(at_[i] + len(words[i]) AS DOUBLE) / len(line) > {lo}/1200.0), lambda i: words[i]), ' ') AS {n}" for n, lo, hi in (("sku", 60, 120), ("productname", 250, 700), ("barcode", 720, 900), ("quantity", 980, 1040))) + " FROM p"


@query(_WORDS)
def region_extract_words(spark, d):
    part = table(spark, d, "part").withColumn("line", F.concat("p_name", F.lit("  "), "p_brand", F.lit(" "), "p_type", F.lit("   "), F.col("p_size").cast("string")))
    return part.select("p_partkey", *[c.alias(n.lower()) for n, c in regions.region_texts(F.col("line")).items()])


_CONF = "CASE WHEN n = 0 THEN 0.0 ELSE (CASE WHEN n < 3 THEN 0.5 ELSE 1.0 END)::DOUBLE * (CASE WHEN s / n > 0.3 THEN 0.7 ELSE 1.0 END)::DOUBLE * (CASE WHEN g / n > 0.8 AND n > 5 THEN 0.9 ELSE 1.0 END)::DOUBLE END"


@query(f"SELECT event_id, CAST({_CONF} AS DOUBLE) AS confidence FROM (SELECT event_id, CAST(len(props) AS DOUBLE) AS n, CAST(len(regexp_extract_all(props, '[^\\w\\s]')) AS DOUBLE) AS s, CAST(len(regexp_extract_all(props, '[0-9]')) AS DOUBLE) AS g FROM events)")
def region_confidence(spark, d):
    return table(spark, d, "events").select("event_id", T.text_confidence(F.col("props")).alias("confidence"))


@query("SELECT lang, language, count(*) AS n FROM (SELECT lang, CASE WHEN h > e * 1.5 THEN 'he' WHEN e > h * 1.5 THEN 'en' ELSE 'mixed' END AS language FROM (SELECT lang, len(regexp_extract_all(text, '[א-ת]')) AS h, len(regexp_extract_all(text, '[A-Za-z]')) AS e FROM documents)) GROUP BY lang, language")
def hebrew_language_mix(spark, d):
    return table(spark, d, "documents").select("lang", T.language_mix(F.col("text")).alias("language")).groupBy("lang", "language").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT sku, count(*) AS n, {_D('units', 'units')}, {_D('cases', 'cases')}, min(name) AS name FROM ({_ENR}) GROUP BY sku")
def enrich_units_cases(spark, d):
    return enriched(spark, d).groupBy("sku").agg(F.count(F.lit(1)).alias("n"), rollups.total("units").alias("units"), rollups.total("cases").alias("cases"), F.min("name").alias("name"))


_GROUP = f"count(*) AS \"count\", {_D('quantity', 'total_quantity')}, {_D('cases', 'total_cases')}, {_D('units', 'total_units')}"
_BYCAT = f"SELECT coalesce(c.category, 'Uncategorized') AS category, {_GROUP} FROM ({_PROD}) p LEFT JOIN ({_KNOWN}) c ON p.sku = c.sku GROUP BY 1"


@query(_BYCAT)
def aggregate_by_category(spark, d):
    return rollups.grouped(C.with_default(products(spark, d), catalog(spark, d, True), "category", "Uncategorized"), "category")


@query(f"SELECT coalesce(s_name, 'No Supplier') AS supplier, {_GROUP} FROM ({_ENR}) p LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 5 <> 0) s ON l_suppkey = s_suppkey GROUP BY 1")
def aggregate_by_supplier(spark, d):
    supplier = table(spark, d, "supplier").where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("_s"))
    rows = enriched(spark, d).join(supplier, "l_suppkey", "left").withColumn("supplier", T.or_text(F.col("_s"), "No Supplier"))
    return rollups.grouped(rows, "supplier")


_STATUS = "CASE WHEN confidence > 0.98 THEN 'Excellent' WHEN confidence > 0.90 THEN 'Good' ELSE 'Needs Review' END"


@query(f"SELECT {_STATUS} AS status, {_GROUP}, CASE {_STATUS} WHEN 'Excellent' THEN 1 WHEN 'Good' THEN 2 ELSE 3 END AS status_order FROM ({_ENR}) GROUP BY 1")
def aggregate_by_status(spark, d):
    return rollups.by_status(enriched(spark, d))


@query(f"SELECT count(*) AS groups, CAST(sum(\"count\") AS BIGINT) AS total_items, sum(total_quantity) AS total_quantity, sum(total_cases) AS total_cases, sum(total_units) AS total_units FROM ({_BYCAT})")
def aggregation_summary(spark, d):
    return rollups.group_summary(rollups.grouped(C.with_default(products(spark, d), catalog(spark, d, True), "category", "Uncategorized"), "category"))


@query(f"SELECT sku, CAST(quantity AS DOUBLE) AS quantity, CAST(cases AS DOUBLE) AS cases, CAST(units AS DOUBLE) AS units FROM ({_PROD})")
def flatten_groups(spark, d):
    rows = C.with_default(products(spark, d), catalog(spark, d, True), "category", "Uncategorized")
    return rollups.group_items(rows, "category").select("sku", "quantity", "cases", "units")


_CALC = f"SELECT p.sku, p.quantity, c.allowUnits AS product_allows, CASE WHEN p.row_ = 0 THEN NULL ELSE p.row_ > 2 END AS rule_allows FROM ({_PICKS}) p LEFT JOIN ({_KNOWN}) c ON p.sku = c.sku"
_CALCED = f"SELECT *, rule_allows IS NOT NULL AND product_allows IS NOT NULL AND quantity >= 0 AS success FROM ({_CALC})"


def _calculated(spark, d):
    rows = picks(spark, d).join(catalog(spark, d, True).select("sku", F.col("allowUnits").alias("product_allows")), "sku", "left")
    return totals.calculated(rows.withColumn("rule_allows", F.when(F.col("row") == 0, None).otherwise(F.col("row") > 2)))


@query(f"SELECT sku, success, count(*) AS n, {_D('CASE WHEN success AND rule_allows AND product_allows THEN quantity ELSE 0 END', 'units')}, {_D('CASE WHEN success AND NOT (rule_allows AND product_allows) THEN quantity ELSE 0 END', 'cases')} FROM ({_CALCED}) GROUP BY sku, success")
def calc_units_cases(spark, d):
    return _calculated(spark, d).groupBy("sku", "success").agg(F.count(F.lit(1)).alias("n"), rollups.total("units").alias("units"), rollups.total("cases").alias("cases"))


@query(f"SELECT {_D('CASE WHEN success AND NOT (rule_allows AND product_allows) THEN quantity ELSE 0 END', 'cases')}, {_D('CASE WHEN success AND rule_allows AND product_allows THEN quantity ELSE 0 END', 'units')}, count(*) FILTER (NOT success) AS warning_count, count(*) FILTER (NOT success) = 0 AS success FROM ({_CALCED})")
def calc_batch_totals(spark, d):
    return totals.batch_totals(_calculated(spark, d))


_AMOUNT = "CAST(sum(CAST(CAST(p_retailprice AS DECIMAL(18,2)) * CAST(l_quantity AS DECIMAL(9,3)) AS DECIMAL(28,5))) AS DOUBLE)"


@query(f"SELECT {_R2(_AMOUNT)} AS total_price, CAST(sum(CAST(l_quantity AS DECIMAL(18,3))) AS DOUBLE) AS total_quantity, {_R2(_AMOUNT + ' / count(*)')} AS average_price, count(*) AS item_count, min(p_retailprice) AS min_price, max(p_retailprice) AS max_price FROM lineitem JOIN part ON l_partkey = p_partkey")
def price_totals(spark, d):
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    return rollups.price_totals(line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_retailprice").alias("price"), F.col("l_quantity").alias("quantity")))


_WHOLE = "CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE)"


@query(f"SELECT category, min(price) AS min_price, max(price) AS max_price, {_R2(_WHOLE + ' / count(*)')} AS mean_price, median(price) AS median_price, {_R2(_WHOLE)} AS sum_price, count(*) AS price_count FROM ({_CAT}) GROUP BY category")
def price_statistics(spark, d):
    return rollups.price_statistics(catalog(spark, d), "category")


@query(f"SELECT o_orderkey, {_R2('o_totalprice * 1.17')} AS taxed, {_R2('o_totalprice - o_totalprice * (o_custkey % 30) / 100')} AS discounted, {_R2('(' + _R2('o_totalprice - o_totalprice * (o_custkey % 30) / 100') + ') * 1.17')} AS final FROM orders")
def tax_discount_final(spark, d):
    price, off = F.col("o_totalprice"), F.col("o_custkey") % 30
    return table(spark, d, "orders").select("o_orderkey", N.round_half_up(price * F.lit(1.17)).alias("taxed"), N.discounted(price, off).alias("discounted"), N.round_half_up(N.discounted(price, off) * F.lit(1.17)).alias("final"))


@query(f"SELECT category, count(*) AS products FROM ({_CAT}) WHERE category <> '' GROUP BY category")
def catalog_statistics(spark, d):
    return C.counts_by(catalog(spark, d), "category")


@query(f"SELECT count(*) AS products, count(DISTINCT category) AS categories, count(DISTINCT brand) AS brands, count(*) FILTER (allowUnits) AS unit_products, count(*) FILTER (NOT allowUnits) AS case_products, list_sort(list(DISTINCT packSize)) AS pack_sizes FROM ({_CAT})")
def catalog_unit_case_stats(spark, d):
    return C.statistics(catalog(spark, d))


@query(f"SELECT sku, name FROM ({_CAT}) WHERE contains(lower(name), lower('An'))")
def search_by_name(spark, d):
    return C.search_by_name(catalog(spark, d), "An").select("sku", "name")


@query(f"SELECT barcode, arg_min(sku, load_seq) AS sku FROM (SELECT left(barcode, 11) AS barcode, sku, load_seq FROM ({_CAT})) GROUP BY barcode")
def search_by_barcode(spark, d):
    return C.first_by_barcode(catalog(spark, d).withColumn("barcode", F.substring("barcode", 1, 11))).select("barcode", "sku")


@query(f"SELECT sku, packSize FROM ({_CAT}) WHERE packSize = 12")
def products_by_pack_size(spark, d):
    return C.search_equal(catalog(spark, d), "packSize", 12).select("sku", "packSize")


_L, _RT = f"SELECT sku, name, brand, CASE WHEN load_seq % 3 = 0 THEN NULL ELSE price END AS price FROM ({_CAT}) WHERE load_seq % 4 <> 0", f"SELECT sku, CASE WHEN load_seq % 5 = 0 THEN NULL ELSE upper(name) END AS name, CAST(NULL AS VARCHAR) AS brand, price + 1 AS price FROM ({_CAT}) WHERE load_seq % 3 <> 1"


@query(f"SELECT coalesce(r.sku, l.sku) AS sku, coalesce(r.name, l.name) AS name, coalesce(r.brand, l.brand) AS brand, coalesce(r.price, l.price) AS price FROM ({_L}) l FULL JOIN ({_RT}) r ON l.sku = r.sku")
def merge_catalogs(spark, d):
    seq = F.col("load_seq")
    left = catalog(spark, d).where(seq % 4 != 0).select("sku", "name", "brand", F.when(seq % 3 != 0, F.col("price")).alias("price"))
    right = catalog(spark, d).where(seq % 3 != 1).select("sku", F.when(seq % 5 != 0, F.upper("name")).alias("name"), F.lit(None).cast("string").alias("brand"), (F.col("price") + 1).alias("price"))
    return C.merged(left, right)


@query(f"SELECT c.sku, c.name, coalesce(u.price, c.price) AS price FROM ({_CAT}) c LEFT JOIN (SELECT sku, price * 2 AS price FROM ({_CAT}) WHERE load_seq % 7 = 0) u ON c.sku = u.sku")
def bulk_upsert(spark, d):
    base = catalog(spark, d).select("sku", "name", "price")
    return C.upserted(base, catalog(spark, d).where("load_seq % 7 = 0").select("sku", (F.col("price") * 2).alias("price")))


@query(f"SELECT n_errors, count(*) AS n FROM (SELECT (CASE WHEN load_seq % 11 = 0 THEN 1 ELSE 0 END) + (CASE WHEN load_seq % 13 = 0 THEN 1 ELSE 0 END) + (CASE WHEN load_seq % 17 = 0 THEN 1 ELSE 0 END) + (CASE WHEN load_seq % 19 = 0 THEN 1 ELSE 0 END) AS n_errors FROM ({_CAT})) GROUP BY n_errors")
def catalog_validate(spark, d):
    seq = F.col("load_seq")
    broken = catalog(spark, d).withColumns({"sku": F.when(seq % 11 != 0, F.col("sku")), "name": F.when(seq % 13 == 0, "").otherwise(F.col("name")), "packSize": F.when(seq % 17 == 0, 0).otherwise(F.greatest("packSize", F.lit(1))), "barcode": F.when(seq % 19 == 0, "x1").otherwise(F.col("barcode"))})
    return C.validated(broken).groupBy(F.size("errors").alias("n_errors")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT brand, arg_max(sku, load_seq) AS sku, max(load_seq) AS load_seq FROM ({_CAT}) GROUP BY brand")
def dedupe_last_wins(spark, d):
    return C.last_wins(catalog(spark, d).withColumn("seq", F.col("load_seq")), "brand", "seq").select("brand", "sku", "load_seq")


_WARN = "SELECT event_id AS seq, event_type AS type, CASE WHEN event_id % 3 = 0 THEN 'error' ELSE 'warning' END AS severity, 'user ' || (user_id % 20) AS message FROM events"


def _warnings(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("type"), F.when(F.col("event_id") % 3 == 0, "error").otherwise("warning").alias("severity"), F.concat(F.lit("user "), (F.col("user_id") % 20).cast("string")).alias("message"))


@query(f"SELECT type, message, count(*) AS \"count\", arg_min(severity, seq) AS severity FROM ({_WARN}) GROUP BY type, message")
def warnings_grouped(spark, d):
    return rollups.warning_groups(_warnings(spark, d))


@query(f"SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (type = 'unknown_sku') AS unknown_sku, count(*) FILTER (type = 'ocr_warning') AS ocr_warning FROM ({_WARN})")
def severity_counts(spark, d):
    return rollups.warning_counts(_warnings(spark, d))


_SPEC = f"SELECT load_seq, 'K' || sku AS product_key, CASE WHEN load_seq % 3 <> 0 THEN barcode END AS barcode, sku, lower(name) AS name, lower('alias ' || sku) AS alias FROM ({_CAT}) WHERE load_seq % 10 <> 0"
_ASKED = f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_orderkey % 4 = 0 THEN c.barcode END AS barcode, CASE WHEN l_orderkey % 4 = 1 THEN c.sku END AS sku, CASE WHEN l_orderkey % 4 = 2 THEN lower(c.name) WHEN l_orderkey % 4 = 3 THEN lower('alias ' || c.sku) ELSE lower(c.name) END AS hint FROM lineitem JOIN ({_CAT}) c ON c.load_seq = l_partkey"


@query(f"""WITH s AS ({_SPEC}), a AS ({_ASKED}), n AS (SELECT trim(regexp_replace(regexp_replace(name, '[^\\p{{L}}\\p{{N}}\\s()/]', '', 'g'), '\\s+', ' ', 'g')) AS name, arg_min(product_key, load_seq) AS product_key FROM s GROUP BY 1)
SELECT resolved_by, product_key, count(*) AS n FROM (SELECT CASE WHEN b.product_key IS NOT NULL THEN 'barcode' WHEN k.product_key IS NOT NULL THEN 'sku' WHEN n.product_key IS NOT NULL THEN 'name' WHEN x.product_key IS NOT NULL THEN 'alias' END AS resolved_by, coalesce(b.product_key, k.product_key, n.product_key, x.product_key) AS product_key
FROM a LEFT JOIN s b ON a.barcode = b.barcode LEFT JOIN s k ON a.barcode IS NULL AND a.sku = k.sku
LEFT JOIN n ON a.barcode IS NULL AND a.sku IS NULL AND trim(regexp_replace(regexp_replace(a.hint, '[^\\p{{L}}\\p{{N}}\\s()/]', '', 'g'), '\\s+', ' ', 'g')) = n.name LEFT JOIN s x ON a.barcode IS NULL AND a.sku IS NULL AND a.hint = x.alias) GROUP BY resolved_by, product_key""")
def resolve_product_chain(spark, d):
    seq = F.col("load_seq")
    spec = catalog(spark, d).where(seq % 10 != 0).select("load_seq", F.concat(F.lit("K"), "sku").alias("product_key"), F.when(seq % 3 != 0, F.col("barcode")).alias("barcode"), "sku", "name", F.array(F.concat(F.lit("Alias "), "sku")).alias("aliases"))
    kind = F.col("l_orderkey") % 4
    known = catalog(spark, d)
    asked = table(spark, d, "lineitem").join(known, F.col("l_partkey") == F.col("load_seq")).select("l_orderkey", "l_linenumber", F.when(kind == 0, F.col("barcode")).alias("barcode"), F.when(kind == 1, F.col("sku")).alias("sku"), F.when(kind == 3, F.concat(F.lit("alias "), "sku")).otherwise(F.col("name")).alias("product_hint"))
    return C.resolved(asked, spec).groupBy("resolved_by", "product_key").agg(F.count(F.lit(1)).alias("n"))


_NAMED = "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || ' (' || p_size || ')' WHEN 1 THEN p_name || ' 1/' || p_size ELSE p_name END AS name FROM part"
_RULES = "(VALUES " + ", ".join([f"('R{i:03d}', 100, '({n})', {n}, true)" for i, n in enumerate(rules.BRACKETS, 1)] + [f"('R{i:03d}', 90, '1/{n}', {n}, false)" for i, n in enumerate(rules.FRACTIONS, 8)]) + ") r(id, priority, value, pack, allows)"


def _named(spark, d):
    size, key = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    return table(spark, d, "part").select("p_partkey", F.when(key == 0, F.concat("p_name", F.lit(" ("), size, F.lit(")"))).when(key == 1, F.concat("p_name", F.lit(" 1/"), size)).otherwise(F.col("p_name")).alias("name"))


@query(f"SELECT p_partkey, m.id AS rule_id, m.pack AS rule_pack_size, m.allows AS rule_allows FROM ({_NAMED}) p LEFT JOIN (SELECT p_partkey AS k, arg_min(id, priority * 1000 + CAST(substr(id, 2) AS INT)) AS id, arg_min(pack, priority * 1000 + CAST(substr(id, 2) AS INT)) AS pack, arg_min(allows, priority * 1000 + CAST(substr(id, 2) AS INT)) AS allows FROM ({_NAMED}), {_RULES} WHERE contains(name, value) GROUP BY p_partkey) m ON m.k = p_partkey")
def name_rule_match(spark, d):
    listed = [r.asDict() for r in rules.name_rules(spark).collect()]  # a short configuration
    return rules.match_names(_named(spark, d), listed).drop("name")


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'case' WHEN p_partkey % 5 = 1 THEN 'unit' WHEN regexp_matches(name, '1/[0-9]+') THEN 'case' WHEN regexp_matches(name, '\\([0-9]+\\)') THEN 'unit' ELSE 'case' END AS unit_type FROM ({_NAMED})")
def unit_type_classify(spark, d):
    key = F.col("p_partkey") % 5
    return _named(spark, d).select("p_partkey", rules.unit_type(F.col("name"), F.when(key == 0, True).when(key == 1, False)).alias("unit_type"))


def _checked(spark, d):
    known = catalog(spark, d, True).select("sku", F.col("name").alias("_n"), F.col("allowUnits").alias("allow_unit_picking"))
    rows = picks(spark, d).drop("name").join(known, "sku", "left")
    rows = rows.withColumns({"name": F.coalesce("_n", F.lit("")), "case_only": ~F.col("allow_unit_picking"), "product_key": F.when(F.col("_n").isNotNull(), F.col("sku")), "resolved_by": F.when(F.col("_n").isNotNull(), F.lit("sku")), "quantity": F.col("quantity") * 250, "confidence": F.col("confidence") - 0.25})
    return rules.row_checks(rows)


_CHECKED = f"""SELECT *, CASE WHEN unit = 'unit' AND (coalesce(case_only, false) OR regexp_matches(name, '1/[0-9]+')) THEN 'fail' ELSE 'pass' END AS r1, CASE WHEN quantity < 0 OR quantity > 9999 THEN 'fail' ELSE 'pass' END AS r2,
 CASE WHEN NOT known THEN 'fail' ELSE 'pass' END AS r3, CASE WHEN confidence * 100 < 70 THEN 'warn' ELSE 'pass' END AS r4, CASE WHEN known AND count(*) OVER (PARTITION BY job_id, page, CASE WHEN known THEN sku END, unit) > 1 THEN 'warn' ELSE 'pass' END AS r5
 FROM (SELECT p.job_id, p.page, p.sku, p.unit, p.quantity * 250 AS quantity, p.confidence - 0.25 AS confidence, c.sku IS NOT NULL AS known, coalesce(c.name, '') AS name, NOT c.allowUnits AS case_only FROM ({_PICKS}) p LEFT JOIN ({_KNOWN}) c ON p.sku = c.sku)"""
_GATED = f"SELECT *, CASE WHEN 'fail' IN (r1, r2, r3) THEN 'queue' WHEN 'warn' IN (r4, r5) THEN 'review' ELSE 'proceed' END AS gate FROM ({_CHECKED})"


@query("SELECT rule, status, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT 'R00{i}' AS rule, r{i} AS status FROM ({_CHECKED})" for i in range(1, 6)) + ") GROUP BY rule, status")
def rule_status_matrix(spark, d):
    return _checked(spark, d).select(F.explode("results").alias("r")).groupBy("r.rule", "r.status").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT gate, count(*) AS n FROM ({_GATED}) GROUP BY gate")
def row_gating(spark, d):
    return _checked(spark, d).groupBy("gate").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT job_id, page, sku, unit, count(*) AS n FROM ({_PICKS}) GROUP BY job_id, page, sku, unit HAVING count(*) > 1")
def duplicate_rows_on_page(spark, d):
    rows = _checked(spark, d).select("job_id", "page", "sku", "unit", F.exists("results", lambda r: (r["rule"] == "R005") & (r["status"] == "warn")).alias("twice"), "product_key")
    unknown = picks(spark, d).join(catalog(spark, d, True), "sku", "left_anti")
    known = rows.where("twice").groupBy("job_id", "page", "sku", "unit").agg(F.count(F.lit(1)).alias("n"))
    return known.unionByName(unknown.groupBy("job_id", "page", "sku", "unit").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))


@query(f"SELECT r2 AS status, count(*) AS n, {_D('quantity', 'quantity')} FROM ({_CHECKED}) GROUP BY r2")
def quantity_range_gate(spark, d):
    rows = _checked(spark, d).select(F.col("results")[1]["status"].alias("status"), "quantity")
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"), rollups.total("quantity").alias("quantity"))


@query(f"SELECT job_id, page, sku, CASE WHEN quantity > 30 THEN 'case' ELSE unit END AS unit, CAST(CASE WHEN (CASE WHEN quantity > 30 THEN 'case' ELSE unit END) = 'unit' THEN 1 ELSE quantity END AS DOUBLE) AS quantity, CASE WHEN (CASE WHEN quantity > 30 THEN 'case' ELSE unit END) = 'unit' THEN 1 ELSE 0 END + CASE WHEN quantity > 30 THEN 1 ELSE 0 END AS matched FROM ({_PICKS})")
def rule_fold_threaded(spark, d):
    engine = rules.RuleEngine.standard()
    engine.add(rules.Rule("B", "equals", {"field": "unit", "value": "unit"}, "set_quantity", {"value": 1}, priority=20))
    engine.add(rules.Rule("A", "range", {"field": "quantity", "min": 30.001, "max": 1e9}, "set_unit", {"value": "case"}, priority=10))
    rows = engine.run(picks(spark, d).select("job_id", "page", "sku", "unit", "quantity"))
    return rows.select("job_id", "page", "sku", "unit", "quantity", F.size(F.filter("executed", lambda r: r["matched"])).alias("matched"))


_CASES, _UNITS = _D("CASE WHEN unit = 'case' THEN quantity ELSE 0 END", "cases"), _D("CASE WHEN unit = 'unit' THEN quantity ELSE 0 END", "units")
_TOT = f"{_CASES}, {_UNITS}, count(*) AS row_count"
_CODES = "list_aggregate(list_transform(list_sort(list({'page': page, 'row': row_, 'unit': unit, 'quantity': quantity})), lambda s: 'p' || s.page || 'r' || s.row), 'string_agg', ', ') AS codes"


def _keyed(spark, d):
    return picks(spark, d).withColumn("product_key", F.col("sku"))


@query(f"SELECT job_id, page, sku AS product_key, {_TOT}, {_CODES} FROM ({_PICKS}) GROUP BY job_id, page, sku")
def page_totals_with_sources(spark, d):
    return totals.page_totals(_keyed(spark, d)).withColumn("codes", T.source_codes(F.col("sources"))).drop("sources")


@query(f"SELECT job_id, sku AS product_key, {_TOT}, count(*) AS source_count FROM ({_PICKS}) GROUP BY job_id, sku")
def job_totals_with_sources(spark, d):
    jobs = totals.job_totals(totals.page_totals(_keyed(spark, d), sources=False))
    counts = lineage.source_refs(_keyed(spark, d)).groupBy("job_id", "product_key").agg(F.count(F.lit(1)).alias("source_count"))
    return jobs.join(counts, ["job_id", "product_key"])


@query(f"SELECT job_id, sku AS product_key, {_CODES} FROM ({_PICKS}) GROUP BY job_id, sku")
def source_codes(spark, d):
    return lineage.gathered(lineage.source_refs(_keyed(spark, d))).select("job_id", "product_key", T.source_codes(F.col("sources")).alias("codes"))


@query(f"SELECT p.job_id, p.page, p.row_ AS row, p.sku AS product_key, p.unit, CAST(p.quantity AS DOUBLE) AS quantity, o.o_orderstatus FROM ({_PICKS}) p LEFT JOIN orders o ON p.job_id = CAST(o_orderkey AS VARCHAR)")
def trace_sources(spark, d):
    path = new_path(spark, "refs")
    lineage.write_refs(lineage.source_refs(_keyed(spark, d)), path)
    orders = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("job_id"), "o_orderstatus")
    return totals.traced_jobs(lineage.read_refs(spark, path), orders)


@query(f"SELECT job_id, sku AS product_key, page, row_ AS row, unit, CAST(quantity AS DOUBLE) AS quantity FROM (SELECT *, sum(CASE WHEN unit = 'case' THEN quantity END) OVER (PARTITION BY job_id, sku) AS cases, sum(CASE WHEN unit = 'unit' THEN quantity END) OVER (PARTITION BY job_id, sku) AS units FROM ({_PICKS})) WHERE cases > 45 OR units > 45")
def sources_of_high_totals(spark, d):
    path, rows = new_path(spark, "refs"), _keyed(spark, d)
    lineage.write_refs(lineage.source_refs(rows), path)
    high = totals.high_totals(totals.job_totals(totals.page_totals(rows, sources=False)), 45)
    return lineage.refs_of_totals(spark, path, high)


def _placed(spark, d):
    nation, region, supplier = (table(spark, d, n) for n in ("nation", "region", "supplier"))
    cities = region.select(F.col("r_regionkey").cast("string").alias("cityId"), F.col("r_name").alias("name"), (F.col("r_regionkey") != 4).alias("active"))
    routes = nation.select(F.col("n_nationkey").cast("string").alias("routeId"), F.col("n_regionkey").cast("string").alias("cityId"), (F.col("n_nationkey") % 7 != 0).alias("active"))
    rows = picks(spark, d).join(supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey", "left")
    rows = rows.withColumns({"city": F.lit(None).cast("string"), "route_id": F.col("s_nationkey").cast("string"), "job_city": F.when(F.col("page") % 2 == 0, F.lit("asia")), "job_route": F.lit(None).cast("string"), "product_key": F.col("sku"), "cases": F.when(F.col("unit") == "case", F.col("quantity")), "units": F.when(F.col("unit") == "unit", F.col("quantity"))})
    return places.assigned(rows, cities, routes)


_PLACED = f"""SELECT p.*, coalesce(CAST(n.n_regionkey AS VARCHAR), CASE WHEN p.page % 2 = 0 THEN (SELECT CAST(r_regionkey AS VARCHAR) FROM region WHERE lower(r_name) = 'asia' AND r_regionkey <> 4) END, 'UNASSIGNED') AS city_id, coalesce(CAST(n.n_nationkey AS VARCHAR), 'UNASSIGNED_ROUTE') AS delivery_route
FROM ({_PICKS}) p LEFT JOIN supplier s ON p.l_suppkey = s_suppkey LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 7 <> 0 AND n_regionkey <> 4) n ON n.n_nationkey = s.s_nationkey"""


@query(f"SELECT city_id, delivery_route, sku AS product_key, {_CASES}, {_UNITS}, CAST(grouping(delivery_route) + grouping(sku) AS INT) AS level FROM ({_PLACED}) GROUP BY GROUPING SETS ((city_id, delivery_route, sku), (city_id, delivery_route), (city_id))")
def city_route_rollup(spark, d):
    return places.city_route_totals(_placed(spark, d))


@query(f"SELECT issue, count(*) AS n FROM (SELECT 'UNRESOLVED_CITY' AS issue FROM ({_PLACED}) WHERE city_id = 'UNASSIGNED' UNION ALL SELECT 'UNRESOLVED_ROUTE' FROM ({_PLACED}) WHERE delivery_route = 'UNASSIGNED_ROUTE') GROUP BY issue")
def unresolved_places(spark, d):
    return places.unassigned(_placed(spark, d)).select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


_REVIEW = "SELECT *, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'pending' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'corrected' ELSE 'rejected' END END AS status FROM orders"


def _reviewed(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderkey") % 2 == 0, "corrected").otherwise("rejected")
    return table(spark, d, "orders").withColumn("status", status)


@query(f"SELECT count(*) FILTER (status IN ('approved', 'corrected')) AS exported, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'rejected') AS rejected FROM ({_REVIEW})")
def review_gate_export(spark, d):
    return review.export_report(_reviewed(spark, d))


@query(f"SELECT p.job_id, p.page, p.sku, CAST(CASE WHEN r.status = 'corrected' AND o_orderkey % 3 = 0 THEN 5 ELSE p.quantity END AS DOUBLE) AS quantity FROM ({_PICKS}) p JOIN ({_REVIEW}) r ON p.job_id = CAST(r.o_orderkey AS VARCHAR) WHERE r.status IN ('approved', 'corrected')")
def correction_override(spark, d):
    decisions = _reviewed(spark, d).select(F.col("o_orderkey").cast("string").alias("item_id"), "status", F.struct(F.when(F.col("o_orderkey") % 3 == 0, F.lit(5)).cast("decimal(18,3)").alias("quantity")).alias("correction"))
    rows = picks(spark, d).withColumn("item_id", F.col("job_id"))
    return review.decided(rows.join(decisions.select("item_id"), "item_id", "left_semi"), decisions, ["quantity"]).select("job_id", "page", "sku", "quantity")


@query(f"SELECT job_id, sku AS product_key, {_TOT} FROM (SELECT p.job_id, p.sku, p.unit, CASE WHEN r.status = 'corrected' AND o_orderkey % 3 = 0 THEN 5 ELSE p.quantity END AS quantity FROM ({_PICKS}) p JOIN ({_REVIEW}) r ON p.job_id = CAST(r.o_orderkey AS VARCHAR) WHERE r.status IN ('approved', 'corrected')) GROUP BY job_id, sku")
def totals_after_decisions(spark, d):
    key = F.col("o_orderkey")
    decision = lambda seq, status, quantity: _reviewed(spark, d).select(key.cast("string").alias("item_id"), F.lit(seq).cast("long").alias("seq"), status.alias("status"), F.struct(quantity.cast("decimal(18,3)").alias("quantity"), F.lit(None).cast("string").alias("unit")).alias("correction"))
    running = RunningTotals(spark, new_path(spark, "running"))
    running.start(_keyed(spark, d).withColumns({"item_id": F.col("job_id"), "waiting": F.col("page") % 2 == 0}))
    running.decide(decision(1, F.lit("approved"), F.lit(7)), 1)
    running.decide(decision(3, F.col("status"), F.when(key % 3 == 0, F.lit(5))), 2)
    running.compact(1)
    running.decide(decision(2, F.lit("corrected"), F.lit(9)), 3)  # comes late: a later decision holds
    return running.jobs()


@query(f"SELECT product_key, cases, units, kind FROM (SELECT sku AS product_key, {_TOT} FROM (SELECT sku, unit, CASE WHEN CAST(sku AS INT) % 9 = 0 THEN 0 ELSE quantity END AS quantity FROM ({_PICKS})) GROUP BY sku), LATERAL (SELECT CASE WHEN cases = 0 AND units = 0 THEN 'zero' WHEN cases > 600 OR units > 600 THEN 'high' END AS kind) WHERE kind IS NOT NULL")
def zero_and_high_totals(spark, d):
    rows = _keyed(spark, d).withColumns({"job_id": F.lit("all"), "page": F.lit(1), "quantity": F.when(F.col("sku").cast("int") % 9 == 0, 0).otherwise(F.col("quantity")).cast("decimal(18,3)")})
    jobs = totals.job_totals(totals.page_totals(rows, sources=False))
    return totals.zero_totals(jobs).withColumn("kind", F.lit("zero")).unionByName(totals.high_totals(jobs, 600).withColumn("kind", F.lit("high"))).select("product_key", "cases", "units", "kind")


@query(f"SELECT CAST(count(*) FILTER (known) AS DOUBLE) / count(*) AS ocr_accuracy, CAST(sum(CAST(confidence AS DECIMAL(18,6))) AS DOUBLE) / count(*) AS average_confidence, count(*) AS total_rows, count(*) FILTER (known) AS successful_rows, count(*) FILTER (NOT known) AS rows_with_warnings, count(DISTINCT sku) AS total_products, {_D('cases', 'total_cases')}, {_D('units', 'total_units')}, {_D('quantity', 'total_quantity')} FROM ({_ENR})")
def batch_statistics(spark, d):
    return rollups.batch_statistics(enriched(spark, d).withColumn("warned", F.col("name") == ""))


@query(f"SELECT sku, CAST(quantity AS DOUBLE) AS quantity, CAST(row_number() OVER (ORDER BY CAST(sku AS BIGINT)) AS INT) AS place FROM ({_PROD}) ORDER BY place LIMIT 50")
def order_by_sku_numeric(spark, d):
    first = ordering.top(products(spark, d), 50, ordering.by_sku()).select("sku", "quantity")
    from pyspark.sql import Window

    return first.withColumn("place", F.row_number().over(Window.orderBy(ordering.sku_number(), "sku")))  # over 50 rows


@query(f"SELECT sku, CAST(quantity AS DOUBLE) AS quantity, CAST(row_number() OVER (ORDER BY CAST(sku AS BIGINT)) AS INT) AS place FROM ({_PROD})")
def order_all_by_sku(spark, d):
    return ordering.placed(products(spark, d), ordering.by_sku()).select("sku", "quantity", F.col("place").cast("int").alias("place"))


@query(f"SELECT category, sku, CAST(quantity AS DOUBLE) AS quantity, CAST(rank AS INT) AS rank FROM (SELECT c.category, p.sku, p.quantity, row_number() OVER (PARTITION BY c.category ORDER BY p.quantity DESC, p.sku) AS rank FROM ({_PROD}) p JOIN ({_CAT}) c ON p.sku = c.sku) WHERE rank <= 3")
def top_products_by_quantity(spark, d):
    rows = products(spark, d).select("sku", "quantity").join(catalog(spark, d).select("sku", "category"), "sku")
    return ordering.top_of_each(rows, ["category"], 3, ordering.by_amount("quantity", "sku"))


@query(f"SELECT sku || ',' || barcode || ',' || CASE WHEN contains(name, ',') THEN '\"' || name || '\"' ELSE name END || ',' || packSize || ',' || allowUnits || ',' || category || ',' || ',' AS line FROM ({_CAT})")
def export_csv_lines(spark, d):
    rows = catalog(spark, d).withColumns({"supplier": F.lit(None).cast("string"), "price": F.lit(None).cast("double")})
    return rows.select(writers.catalog_csv_line().alias("line"))


@query(f"SELECT category, sku, {_D('quantity', 'quantity')}, {_D('cases', 'cases')}, {_D('units', 'units')}, CAST(grouping(sku) AS INT) AS is_total FROM (SELECT p.*, c.category FROM ({_PROD}) p JOIN ({_CAT}) c ON p.sku = c.sku) GROUP BY GROUPING SETS ((category, sku), (category))")
def report_with_totals(spark, d):
    rows = products(spark, d).join(catalog(spark, d).select("sku", "category"), "sku")
    return rollups.with_totals(rows, "category", "sku")


@query("SELECT a.p_partkey AS left_key, b.p_partkey AS right_key, CAST(levenshtein(a.p_name, b.p_name) AS INT) AS distance FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def levenshtein_pairs(spark, d):
    part = table(spark, d, "part")
    a, b = part.select(F.col("p_partkey").alias("left_key"), F.col("p_name").alias("a")), part.select(F.col("p_partkey").alias("right_key"), F.col("p_name").alias("b"))
    return a.join(b, F.col("right_key") == F.col("left_key") + 1).select("left_key", "right_key", F.levenshtein("a", "b").alias("distance"))


_EAN = "(10 - (" + " + ".join(f"CAST(substr(code, {i}, 1) AS INT) * {3 if i % 2 == 0 else 1}" for i in range(1, 13)) + ") % 10) % 10"


@query(f"SELECT sku, code || CAST({_EAN} AS VARCHAR) AS corrected, barcode = code || CAST({_EAN} AS VARCHAR) AS valid FROM (SELECT sku, barcode, left(barcode, 12) AS code FROM ({_CAT}))")
def correct_ean13(spark, d):
    return catalog(spark, d).select("sku", T.correct_ean13(F.when(F.col("load_seq") % 2 == 0, F.col("barcode")).otherwise(F.substring("barcode", 1, 12))).alias("corrected"), T.ean13_valid(F.col("barcode")).alias("valid"))


def _names(spark, d):
    part = table(spark, d, "part")
    asked = part.select(F.concat(F.substring("p_name", 1, 5), F.lit("x"), F.expr("substring(p_name, 6)")).alias("name"))
    return asked, part.select(F.col("p_name").alias("candidate"), F.col("p_partkey").alias("cand_seq"))


@query()
def nearest_product(spark, d):
    return fuzzy.nearest(*_names(spark, d))


@query()
def find_matches(spark, d):
    return fuzzy.find_matches(*_names(spark, d))


@query()
def top_n_matches(spark, d):
    return fuzzy.top_matches(*_names(spark, d))
