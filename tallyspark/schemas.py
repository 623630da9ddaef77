"""Schemas of the entities, as DDL."""

QUANTITY = "DECIMAL(18,3)"
SOURCE = f"STRUCT<page: INT, row: INT, unit: STRING, quantity: {QUANTITY}>"
SOURCES = f"ARRAY<{SOURCE}>"

CATALOG = "sku STRING, barcode STRING, name STRING, packSize INT, allowUnits BOOLEAN, category STRING, supplier STRING, price DOUBLE"
SEED_PRODUCT = "sku STRING, barcode STRING, name STRING, brand STRING, packSize INT, allowUnits BOOLEAN"
SPEC_PRODUCT = "productKey STRING, barcode STRING, sku STRING, verificationStatus STRING, name STRING, nameEn STRING, aliases ARRAY<STRING>, allowUnitPicking BOOLEAN, caseOnly BOOLEAN, unitSize INT, caseSize INT, active BOOLEAN"
PICK_ROW = f"job_id STRING, page INT, row INT, invoice STRING, sku STRING, barcode STRING, name STRING, quantity {QUANTITY}"
PARSED_ROW = f"job_id STRING, page INT, row INT, raw_text STRING, product_hint STRING, barcode STRING, sku STRING, quantity {QUANTITY}, unit STRING, pack_size_hint INT, confidence DOUBLE"
NAME_RULE = "id STRING, priority INT, type STRING, value STRING, packSize INT, allowUnits BOOLEAN"
RULE = "id STRING, ruleType STRING, enabled BOOLEAN, severity STRING, params STRUCT<min: INT, max: INT, threshold: INT, patterns: ARRAY<STRING>>, description STRING"
DICTIONARY = "id STRING, misread STRING, correction STRING, context STRING, notes STRING"
CITY = "cityId STRING, name STRING, nameEn STRING, active BOOLEAN"
ROUTE = "routeId STRING, cityId STRING, name STRING, nameEn STRING, sortOrder INT, active BOOLEAN"
WARNING = "seq BIGINT, type STRING, severity STRING, message STRING"
REVIEW = f"job_id STRING, item_id STRING, stage STRING, severity STRING, status STRING, failed_rules ARRAY<STRING>, correction STRUCT<quantity: {QUANTITY}, unit: STRING, product_key: STRING>"
PAGE = "job_id STRING, page INT, text STRING"
