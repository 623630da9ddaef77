"""The foundation contracts of the specification, by their names, held against operators."""

from decimal import Decimal

from tallyspark.operators import rules, totals
from tallyspark.plans import field_queries

ROWS = "job_id string, page int, row int, product_key string, unit string, quantity decimal(18,3)"


def test_keeps_case_and_unit_totals_as_separate_numeric_fields_in_fixtures(spark):
    rows = spark.createDataFrame([("job-1", 1, 8, "A", "case", Decimal(2)), ("job-1", 1, 9, "A", "unit", Decimal(14))], ROWS)
    found = totals.page_totals(rows).first()
    assert (found.cases, found.units) == (2, 14)


def test_stores_page_and_row_references_together_for_traceability_fixtures(spark):
    rows = spark.createDataFrame([("job-1", 1, 8, "A", "case", Decimal(2))], ROWS)
    found = totals.job_totals(totals.page_totals(rows)).first()
    assert [(s.page, s.row) for s in found.sources] == [(1, 8)]


def test_keeps_unusually_high_quantity_threshold_disabled_by_default(spark):
    rows = spark.createDataFrame([("job-1", "A", Decimal(10**9), Decimal(0))], "job_id string, product_key string, cases decimal(38,3), units decimal(38,3)")
    listed = [{"id": "R007", "ruleType": "UNUSUALLY_HIGH_QUANTITY", "enabled": True, "severity": "warn", "params": {"threshold": None}}]
    assert totals.high_totals(rows, None).count() == 0 and rules.total_checks(rows, listed).count() == 0
    assert rules.total_checks(rows, []).columns == [*rows.columns, "rule", "status"]


def test_rules_come_from_the_catalog(spark):
    made, warnings = rules.compiled(field_queries.CONFIGURED)
    assert [m[0] for m in made] == ["R001", "R002", "R003", "R004", "R008", "R011"]
    assert warnings == ["R012: unsupported rule type SOMETHING_ELSE"]
