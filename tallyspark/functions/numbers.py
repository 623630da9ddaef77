"""Number functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int = 2) -> Column:
    """floor(x * 10^digits + 0.5) / 10^digits: halves go up, on the binary value, for negative numbers too."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def with_tax(price: Column, rate: Column | float = 0.0) -> Column:
    return round_half_up(price * (1 + (rate if isinstance(rate, Column) else F.lit(rate))))


def discounted(price: Column, percent: Column) -> Column:
    return round_half_up(price - price * percent / 100)


def final_price(price: Column, percent: Column, rate: Column) -> Column:
    """The discount is rounded before tax."""
    return with_tax(discounted(price, percent), rate)


def dollars(x: Column) -> Column:
    """$1,234.50, the sign before the dollar."""
    return F.concat(F.when(x < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.abs(round_half_up(x)), 2))


def percent_text(x: Column) -> Column:
    """One decimal and a percent sign; a tie in binary goes up."""
    return F.concat(F.format_string("%.1f", F.floor(x * 1000 + 0.5) / 10), F.lit("%"))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def share_percent(part: Column, total: Column) -> Column:
    """part / total in percent to one decimal, 0 for no total."""
    return F.when(total > 0, round_half_up(part / total * 100, 1)).otherwise(0.0)
