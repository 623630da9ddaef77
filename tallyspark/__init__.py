"""Order-line analytics on Spark: parsing, catalog, rules, totals and reports as DataFrame operators."""
