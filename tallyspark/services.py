"""What the stages of a pipeline take and give, as protocols, and the coded errors that rows can carry."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Codes of errors.
CODES = ("CONFIG_INVALID", "OCR_IMAGE_ERROR", "PDF_RENDER_ERROR", "PARSE_FAILED", "PRODUCT_NOT_FOUND", "CITY_UNRESOLVED", "ROUTE_UNRESOLVED", "VALIDATION_FAILED", "TRACEABILITY_MISSING", "INTERNAL_ERROR")


class Parser(Protocol):
    def parse(self, pages: DataFrame) -> DataFrame: ...


class Resolver(Protocol):
    def resolve(self, rows: DataFrame, products: DataFrame) -> DataFrame: ...


class Calculator(Protocol):
    def calculate(self, rows: DataFrame) -> DataFrame: ...


class Validator(Protocol):
    def validate(self, rows: DataFrame) -> DataFrame: ...


class ReviewQueue(Protocol):
    def decide(self, rows: DataFrame, decisions: DataFrame) -> DataFrame: ...


class Aggregator(Protocol):
    def aggregate(self, pages: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class Services:
    """The stages that a batch goes through, each exchangeable: what has a stage's method can take its place."""

    parser: Parser
    resolver: Resolver
    validator: Validator
    calculator: Calculator
    aggregator: Aggregator

    def run(self, pages: DataFrame, products: DataFrame, decisions: DataFrame | None = None, queue: ReviewQueue | None = None) -> DataFrame:
        """The totals of pages: parsed, resolved and validated rows, those that a reviewer lets go if there is a queue, calculated and aggregated."""
        rows = self.validator.validate(self.resolver.resolve(self.parser.parse(pages), products))
        if queue is not None and decisions is not None:
            rows = queue.decide(rows, decisions)
        return self.aggregator.aggregate(self.calculator.calculate(rows))


def coded(*checks: tuple[Column, str, Column | str]) -> Column:
    """The error of a row, (code, message): the first of the (condition, code, message) whose condition holds, null if none does."""
    out = F.lit(None).cast("struct<code:string,message:string>")
    for holds, code, message in reversed(checks):
        if code not in CODES:
            raise ValueError(f"no error code {code}")
        shown = message if isinstance(message, Column) else F.lit(message)
        out = F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(code).alias("code"), shown.alias("message"))).otherwise(out)
    return out


def row_error() -> Column:
    """The error of a resolved and placed row: not parsed, no product, no city, no route, or no page to trace it to."""
    return coded(
        (F.col("quantity").isNull(), "PARSE_FAILED", "no quantity"),
        (F.col("product_key").isNull(), "PRODUCT_NOT_FOUND", "no product"),
        (F.col("city_id") == "UNASSIGNED", "CITY_UNRESOLVED", "no city"),
        (F.col("delivery_route") == "UNASSIGNED_ROUTE", "ROUTE_UNRESOLVED", "no route"),
        (F.col("page").isNull(), "TRACEABILITY_MISSING", "no page"),
    )


def ok(rows: DataFrame, error: str = "error") -> DataFrame:
    """Rows without an error."""
    return rows.where(F.col(error).isNull()).drop(error)


def err(rows: DataFrame, error: str = "error") -> DataFrame:
    """Rows with an error, its code and message beside them."""
    return rows.where(F.col(error).isNotNull()).select(*[c for c in rows.columns if c != error], f"{error}.code", f"{error}.message")
