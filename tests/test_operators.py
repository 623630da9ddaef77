import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark import schemas
from tallyspark.operators import catalog as C
from tallyspark.operators import fuzzy, ordering, parse, places, regions, review, rollups, rules, totals
from tallyspark.plans import engine, queries
from tallyspark.sources import readers, writers

CATALOG = [
    ("88135", "7290018813505", "pringles", 12, True, "snacks", "north", 5.0),
    ("88136", "7290018813512", "cola", 6, False, "drinks", "", 7.5),
]


@pytest.fixture
def catalog(spark):
    return spark.createDataFrame(CATALOG, schemas.CATALOG)


@pytest.fixture
def pages(spark):
    text = "\n".join(["88135 7290018813505 pringles 10", "88136 7290018813512 cola 2.5", "99999 7290018813599 what -4", "88135 no barcode 3", "88135 7290018813505 zero 0", "", "nothing", "88135 7290018813505 cr 4\r", "אב88135 7290018813505 glued 7"])
    return spark.createDataFrame([("j", 1, text)], schemas.PAGE)


def rows_of(frame, *columns):
    return [tuple(r) for r in frame.select(*columns).orderBy(*columns).collect()]


def test_parse_table_keeps_zero_and_enriches(pages, catalog):
    rows = parse.parse_table(pages, catalog)
    found = {(r.row, r.sku): (r.name, int(r.units), float(r.cases)) for r in rows.collect()}
    assert found[1, "88135"] == ("pringles", 10, 0)
    assert found[2, "88136"] == ("cola", 0, 2.5)
    assert found[3, "99999"][1:] == (0, 0)
    assert found[8, "88135"][1] == 0 and found[9, "88135"][1] == 7
    assert len(found) == 6


def test_parse_with_tracking_and_validation(pages, catalog):
    rows, missing = parse.parse_with_tracking(pages, catalog, allow_negative=True)
    assert rows.count() == 4 and [r.sku for r in missing.collect()] == ["99999"]
    rows, errors = parse.parse_with_validation(pages, catalog)
    assert rows.count() == 3
    assert {r.error for r in errors.collect()} == {"Line 3: Negative quantity (-4)", "Line 4: No valid barcode found (13 digits)", "Line 5: Quantity is 0", "Line 7: No valid SKU found (5 digits)", "Line 8: Quantity is 0"}


def test_tables_and_header(spark, catalog):
    page = spark.createDataFrame([("j", 1, "88135 7290018813505 a 1---88136 7290018813512 b 2")], schemas.PAGE)
    assert rows_of(parse.parse_multiple_tables(page, catalog), "table", "sku") == [(0, "88135"), (1, "88136")]
    assert parse.after_header(page, "-+").first().text == "88136 7290018813512 b 2"
    assert parse.after_header(page, "none").first().text == page.first().text


def test_spec_fields_and_picking_lines(spark):
    lines = spark.createDataFrame([("7290018813505 Milk (12) 313",), ("AB12345 Beer 1/24 4 5",), ("plain",)], "line string")
    got = {r.line: r for r in parse.spec_fields(lines).collect()}
    assert got["7290018813505 Milk (12) 313"].quantity == 313 and got["7290018813505 Milk (12) 313"].pack_size_hint == 12
    assert got["AB12345 Beer 1/24 4 5"].sku == "AB12345" and got["AB12345 Beer 1/24 4 5"].issue == "AMBIGUOUS_QUANTITY_COLUMN"
    assert got["plain"].quantity is None
    picked = parse.picking_lines(spark.createDataFrame([("881O8 big cola 12 cases",), ("x",)], "line string")).first()
    assert (picked.sku, picked.name, int(picked.quantity), picked.unit) == ("88108", "big cola", 12, "case")


def test_regions(spark):
    line = spark.createDataFrame([("88135   pringles original 50",)], "line string")
    # places are 0-5, 6-14, 15-23 and 24-26 of 28
    got = line.select(regions.words_between(F.col("line"), 0, 240).alias("a"), regions.words_between(F.col("line"), 900, 1100).alias("b")).first()
    assert (got.a, got.b) == ("88135", "original 50") or got.b == "original"
    with pytest.raises(KeyError):
        regions.layout("other")
    page = spark.createDataFrame([("j", 1, "\n \n")], schemas.PAGE)
    assert regions.extract_regions(page).select(regions.region_issues(F.col("regions")).alias("i")).first().i[:3] == ["Missing sku", "Missing productName", "Missing quantity"]
    assert regions.parse_layout(line).count() in (0, 1)


def test_summaries_keep_sums_under_permutation(spark, pages, catalog):
    rows = parse.parse_table(pages, catalog).withColumn("invoice", F.lit("a"))
    first = rows_of(rollups.summarize(rows, ["page", "row"]), "sku", "total_quantity", "total_units", "total_cases", "invoice_count")
    again = rows_of(rollups.summarize(rows.repartition(3).orderBy(F.desc("row")), ["page", "row"]), "sku", "total_quantity", "total_units", "total_cases", "invoice_count")
    assert first == again


def test_empty_aggregates_are_zero(spark):
    none = spark.createDataFrame([], "price double, quantity double")
    assert tuple(rollups.price_totals(none).first()) == (0.0, 0.0, 0.0, 0, 0.0, 0.0)
    assert rollups.price_statistics(none).first().price_count == 0


def test_price_median(spark):
    prices = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "price double")
    assert rollups.price_statistics(prices).first().median_price == 2.5


def test_status_edges(spark):
    levels = spark.createDataFrame([(0.98,), (0.9800001,), (0.90,)], "c double").select(rollups.status(F.col("c")).alias("s"))
    assert [r.s for r in levels.collect()] == ["Good", "Excellent", "Needs Review"]


def test_warnings_first_severity(spark):
    w = spark.createDataFrame([(2, "t", "error", "m"), (1, "t", "warning", "m")], schemas.WARNING)
    assert tuple(rollups.warning_groups(w).select("count", "severity").first()) == (2, "warning")


def test_catalog_operators(spark, catalog):
    assert C.search_by_name(catalog, "PRING").count() == 1 and C.search_by_name(catalog, "%").count() == 0
    twice = readers.catalog_rows(spark, [("1", "5", "a", 1, True, None, None, None), ("1", "5", "b", 1, True, None, None, None)])
    assert C.last_wins(twice).first().name == "b" and C.search_by_barcode(twice, "5").first().name == "a"
    bad = spark.createDataFrame([(None, "x", "", None, True, None, None, None), ("1", None, "n", 0, True, None, None, None)], schemas.CATALOG)
    assert [len(r.errors) for r in C.validated(bad).collect()] == [4, 1]
    assert bad.select(C.can_be_added().alias("ok")).collect()[1].ok is False
    change = spark.createDataFrame([("88135", 9.0), ("1", 1.0)], "sku string, price double")
    merged = {r.sku: (r.name, r.price) for r in C.merged(catalog, change).collect()}
    assert merged == {"88135": ("pringles", 9.0), "88136": ("cola", 7.5), "1": (None, 1.0)}
    assert C.without(catalog, "88135").count() == 1


def test_resolution_does_not_fall_through(spark):
    products = spark.createDataFrame([(1, "A", "111", "s1", "Milk", ["dairy"]), (2, "B", None, "s2", "Beer", [])], "load_seq long, product_key string, barcode string, sku string, name string, aliases array<string>")
    rows = spark.createDataFrame([(1, "111", None, "x"), (2, "999", None, "milk"), (3, None, "s2", None), (4, "", "", " BEER! "), (5, None, None, "Dairy"), (6, None, "zz", "milk")], "id int, barcode string, sku string, product_hint string")
    got = {r.id: (r.product_key, r.resolved_by) for r in C.resolved(rows, products).collect()}
    assert got == {1: ("A", "barcode"), 2: (None, None), 3: ("B", "sku"), 4: ("B", "name"), 5: ("A", "alias"), 6: (None, None)}


def test_name_rules_prefer_fractions(spark):
    listed = [r.asDict() for r in rules.name_rules(spark).collect()]
    names = spark.createDataFrame([("a (12) 1/8",), ("b (24)",), ("c",), ("d 1/80",)], "name string")
    got = {r.name: (r.rule_pack_size, r.rule_allows) for r in rules.match_names(names, listed).collect()}
    assert got == {"a (12) 1/8": (8, False), "b (24)": (24, True), "c": (None, None), "d 1/80": (8, False)}


def parsed(spark):
    rows = [("j", 1, 1, "A", "unit", 5, 0.9, "Milk", True, False, "sku"), ("j", 1, 2, "A", "unit", 5, 0.5, "Milk", True, False, "sku"), ("j", 1, 3, "B", "unit", 10000, 0.9, "Beer 1/24", False, True, "sku"), ("j", 1, 4, None, "case", 0, 0.7, "?", None, None, None), ("j", 2, 1, "A", "case", 9999, 0.7, "Milk", True, False, "sku")]
    return spark.createDataFrame(rows, "job_id string, page int, row int, product_key string, unit string, quantity int, confidence double, name string, allow_unit_picking boolean, case_only boolean, resolved_by string").withColumn("quantity", F.col("quantity").cast("decimal(18,3)"))


def test_row_checks(spark):
    got = {(r.page, r.row): ({x.rule: x.status for x in r.results}, r.gate) for r in rules.row_checks(parsed(spark)).collect()}
    assert got[1, 1][0]["R005"] == "warn" and got[1, 1][1] == "review"
    assert got[1, 2][0]["R004"] == "warn"
    assert got[1, 3][0]["R001"] == got[1, 3][0]["R002"] == "fail" and got[1, 3][1] == "queue"
    assert got[1, 4][0]["R003"] == "fail" and got[1, 4][0]["R004"] == "pass"
    assert got[2, 1][1] == "proceed"


def test_rule_engine_threads_rows_and_reports(spark):
    engine_ = rules.RuleEngine.standard()
    engine_.add(rules.Rule("late", "equals", {"field": "unit", "value": "case"}, "warn", {"message": "seen"}, priority=5))
    engine_.add(rules.Rule("early", "missing", {"field": "unit"}, "set_unit", {"value": "case"}, priority=1))
    engine_.add(rules.Rule("odd", "nope", {}, "warn", {"message": "x"}, priority=9))
    engine_.add(rules.Rule("off", "missing", {"field": "unit"}, "set_unit", {"value": "z"}, enabled=False))
    row = engine_.run(spark.createDataFrame([(None, 1)], "unit string, quantity int")).first()
    assert row.unit == "case" and row.warnings == ["seen", "odd: unsupported rule"]
    assert [(x.rule, x.executed, x.matched) for x in row.executed] == [("early", True, True), ("late", True, True), ("odd", False, False)]
    assert engine_.remove("odd") and not engine_.remove("odd")


def test_totals_keep_kinds_apart_and_sources_whole(spark):
    rows = parsed(spark)
    pages_ = totals.page_totals(rows)
    jobs = totals.job_totals(pages_)
    a = jobs.where("product_key = 'A'").first()
    assert (int(a.cases), int(a.units), len(a.sources)) == (9999, 10, 3)
    assert jobs.where("product_key is null").count() == 0
    assert totals.source_rows(jobs).count() == 4
    assert totals.zero_totals(jobs).count() == 0 and totals.high_totals(jobs, None).count() == 0 and totals.high_totals(jobs, 500).count() == 2


def test_calculated_needs_rule_product_and_quantity(spark):
    rows = spark.createDataFrame([(5, True, True), (5, True, False), (5, None, True), (-1, True, True)], "quantity int, rule_allows boolean, product_allows boolean")
    got = [(int(r.units), int(r.cases), r.success, r.warnings) for r in totals.calculated(rows).collect()]
    assert got == [(5, 0, True, []), (0, 5, True, []), (0, 0, False, ["missing_rule"]), (0, 0, False, ["invalid_quantity"])]
    assert totals.batch_totals(totals.calculated(rows)).first().success is False


def test_places(spark):
    cities = spark.createDataFrame([("TLV", "Tel Aviv", "", True), ("OLD", "Old", "", False)], schemas.CITY)
    routes = spark.createDataFrame([("r1", "TLV", "", "", 2, True), ("r2", "OLD", "", "", 1, True)], schemas.ROUTE)
    rows = spark.createDataFrame([("tel aviv", None, None, None), (None, "r1", None, None), (None, None, "TLV", "r1"), ("OLD", "r2", None, None)], "city string, route_id string, job_city string, job_route string")
    got = sorted((r.city_id, r.delivery_route) for r in places.assigned(rows, cities, routes).collect())
    assert got == [("TLV", "UNASSIGNED_ROUTE"), ("TLV", "r1"), ("TLV", "r1"), ("UNASSIGNED", "UNASSIGNED_ROUTE")]


def test_review_decisions(spark):
    rows = spark.createDataFrame([("1", Decimal(5)), ("2", Decimal(5)), ("3", Decimal(5)), ("4", Decimal(5))], "item_id string, quantity decimal(18,3)")
    decisions = spark.createDataFrame([("1", "corrected", (Decimal(7),)), ("2", "rejected", None), ("3", "pending", None)], "item_id string, status string, correction struct<quantity: decimal(18,3)>")
    assert {r.item_id: int(r.quantity) for r in review.decided(rows, decisions, ["quantity"]).collect()} == {"1": 7, "4": 5}


def test_sku_order(spark):
    skus = spark.createDataFrame([("b",), ("100",), ("20",), ("a",), ("0",)], "sku string")
    assert [r.sku for r in skus.orderBy(*ordering.by_sku()).collect()] == ["20", "100", "0", "a", "b"]


def test_every_sku_has_its_place(spark):
    skus = [str(i) for i in range(1, 2001)] + ["0", "a", "b", "Z9", "00012x"]
    rows = spark.createDataFrame([(s,) for s in reversed(skus)], "sku string").repartition(7)
    got = [(r.place, r.sku) for r in ordering.placed(rows, ordering.by_sku()).collect()]
    want = [r.sku for r in rows.coalesce(1).sortWithinPartitions(*ordering.by_sku()).collect()]
    assert sorted(got) == list(enumerate(want, 1)) and len(got) == len(skus)


def test_fuzzy(spark):
    names = spark.createDataFrame([("orange juce",), ("zzz",)], "name string")
    candidates = spark.createDataFrame([("orange juice", 1), ("orange juice", 2), ("apple", 3)], "candidate string, cand_seq int")
    best = fuzzy.nearest(names, candidates).collect()
    assert [(r.name, r.candidate, r.cand_seq) for r in best] == [("orange juce", "orange juice", 1)]
    assert fuzzy.top_matches(names, candidates, 1, 0.7).count() == 1
    assert fuzzy.top_matches(names, candidates, 3).count() == 4
    assert {r.corrected for r in fuzzy.corrected_names(names, candidates).collect()} == {"orange juice", "zzz"}
    entries = [{"misread": "ליטד", "correction": "ליטר", "context": "hebrew_unit"}, {"misread": "0", "correction": "O", "context": "hebrew_letter_in_numeric_field"}]
    fixed = fuzzy.dictionary_corrected(spark.createDataFrame([("1 ליטד א0ב 10",)], "text string"), entries).first()
    assert (fixed.corrected, fixed.corrections) == ("1 ליטר אOב 10", 2)


def brute_force(asked, parts):
    from tallyspark.functions.similarity import jaro_winkler_pair

    def distance(a, b):
        d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        return d[len(a), len(b)]

    score = lambda a, b: 1.0 if a == b else 0.4 * (1 - distance(a, b) / max(len(a), len(b))) + 0.6 * jaro_winkler_pair(a, b)
    return {a: sorted((-score(a, c), seq, c) for seq, c in parts) for a in asked}


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("parts")
    words = ["red", "green", "almond", "steel", "lace", "antique", "misty", "navy"]
    rows = [(i, f"{words[i % 8]} {words[i * 3 % 7]} {words[i * 5 % 8]}" + "s" * (i % 3)) for i in range(1, 61)] + [(61, "zq"), (62, "a much longer name than all of the others")]
    rows = list({name: (key, name) for key, name in reversed(rows)}.values())
    spark.createDataFrame(rows, "p_partkey long, p_name string").write.parquet(str(folder / "part.parquet"))
    return str(folder), rows


def test_registered_thresholds_are_the_reference_ones(spark, parts):
    folder, rows = parts
    got = {}
    for r in queries.QUERIES["top_n_matches"](spark, folder).collect():
        got.setdefault(r.name, []).append((r.rank, r.candidate, r.score))
    want = brute_force(got, rows)
    assert got and {a: [(i, c, pytest.approx(-s)) for i, (s, _, c) in enumerate(want[a][:3], 1)] for a in got} == {a: sorted(g) for a, g in got.items()}
    found = {(r.name, r.candidate) for r in queries.QUERIES["find_matches"](spark, folder).collect()}
    assert found == {(a, c) for a in got for s, _, c in want[a] if -s >= 0.7}


def test_every_part_name_is_asked(spark, parts):
    folder, rows = parts
    asked = [n[:5] + "x" + n[5:] for _, n in rows]
    want = brute_force(asked, rows)
    got = {r.name: (r.candidate, r.cand_seq, pytest.approx(r.score)) for r in queries.QUERIES["nearest_product"](spark, folder).collect()}
    assert got == {a: (c, seq, -s) for a in asked for s, seq, c in want[a][:1] if -s > 0.7} and len(got) > 30
    assert {r.name for r in queries.QUERIES["top_n_matches"](spark, folder).collect()} == set(asked)


def test_batch_and_workbook(spark, catalog, tmp_path):
    page = spark.createDataFrame([("j", 1, "88135 pringles 4 units\n88136 cola 3 cases\n77777 what 1")], schemas.PAGE)
    listed = [r.asDict() for r in rules.name_rules(spark).collect()]
    result = engine.batch(page, catalog, listed)
    got = {r.sku: (int(r.units), int(r.cases)) for r in result.products.collect()}
    assert got == {"88135": (4, 0), "88136": (0, 3), "77777": (0, 0)}
    assert [r.type for r in result.warnings.collect()] == ["unknown_sku"]
    writers.write_workbook(engine.sheets(result, catalog), str(tmp_path / "books"), "Batch")
    with zipfile.ZipFile(tmp_path / "books" / "Batch.xlsx") as file:
        assert len([n for n in file.namelist() if n.startswith("xl/worksheets")]) == 8
        assert "88135" in file.read("xl/worksheets/sheet2.xml").decode()
    writers.write_page("t", result.products.select("sku"), str(tmp_path / "pages"), "t")
    assert "<th>sku</th>" in (tmp_path / "pages" / "t.html").read_text()


def test_csv_lines_quote_only_commas(spark):
    rows = spark.createDataFrame([("1", None, "a,b", 2, True, None, None, None)], schemas.CATALOG)
    assert rows.select(writers.catalog_csv_line().alias("l")).first().l == '1,,"a,b",2,true,,,'


def test_catalog_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text("sku,barcode,name,packSize,allowUnits,category,supplier,price\n00135, 1 ,x,2,true,,,1.5\n")
    row = readers.catalog_csv(spark, str(tmp_path / "c.csv")).first()
    assert (row.sku, row.barcode, row.packSize) == ("00135", "1", 2)
    (tmp_path / "v.json").write_text('{"version": "1.10.0", "cities": [{"cityId": "T", "name": "n", "active": true}]}')
    assert readers.versioned(spark, str(tmp_path / "v.json"), "cities", schemas.CITY).first().cityId == "T"
    both = spark.createDataFrame([("1.9.0",), ("1.10.0",)], "version string")
    assert [r.version for r in readers.highest_version(both).collect()] == ["1.10.0"]


def test_results_store(spark, tmp_path):
    frame = spark.createDataFrame([(1,)], "x int")
    writers.save_result(frame, str(tmp_path / "r"), "a")
    assert writers.get_result(spark, str(tmp_path / "r"), "a").first().x == 1
    assert [r.result_id for r in writers.list_results(spark, str(tmp_path / "r")).collect()] == ["a"]


def test_stream_matches_batch(spark, catalog, tmp_path):
    from tallyspark.streaming import pages as stream

    page = spark.createDataFrame([("j", 1, "88135 7290018813505 a 3"), ("j", 2, "88135 7290018813505 a 4")], schemas.PAGE)
    page.write.json(str(tmp_path / "in"))
    query = stream.start(stream.running_totals(stream.arriving(spark, str(tmp_path / "in")), catalog), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(60)
    assert [(r.sku, int(r.total_units), r.row_count) for r in stream.latest(spark, str(tmp_path / "out")).collect()] == [("88135", 7, 2)]


def test_rows_that_ask_for_one_name_are_not_sorted(spark):
    products = spark.range(50).selectExpr("id as load_seq", "concat('K', id) as product_key", "cast(null as string) as barcode", "cast(id as string) as sku", "'red bolt' as name", "array(concat('alias ', id)) as aliases")
    rows = spark.range(3000).selectExpr("id", "'' as barcode", "if(id % 3 = 0, cast(id % 60 as string), '') as sku", "if(id % 3 = 1, 'Red  Bolt', if(id % 6 = 2, null, 'Alias 7')) as product_hint")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = C.resolved(rows, products)
        counted = {(r.resolved_by, r.product_key): r["count"] for r in found.where("resolved_by is null or resolved_by <> 'sku'").groupBy("resolved_by", "product_key").count().collect()}
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert counted == {("name", "K0"): 1000, ("alias", "K7"): 500, (None, None): 650}
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
