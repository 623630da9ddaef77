"""Text functions as column expressions. All keep nulls null unless they say otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what order sheets count as white space, as a regular expression class.
WS = r"[\s\u000B   -     　﻿]"
#: ASCII word edges; Java's \b counts Hebrew letters as word characters, which would glue numbers to them.
EDGE_LEFT, EDGE_RIGHT = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"
#: Hebrew letters, and the points and marks (maqaf among them) that normalising takes out.
HEBREW, MARKS = r"[א-ת]", r"[֑-ׇ]"


def trim(x: Column) -> Column:
    """Without white space of any kind on either side."""
    return F.regexp_replace(x, rf"\A{WS}+|{WS}+\z", "")


def is_blank(x: Column) -> Column:
    """Whether there is nothing but white space."""
    return ~x.rlike("[^" + WS[1:])


def or_text(x: Column, default) -> Column:
    """``default`` where x is null or empty."""
    return F.coalesce(F.nullif(x, F.lit("")), default if isinstance(default, Column) else F.lit(default))


def or_number(x: Column, default=0) -> Column:
    """``default`` where x is null, 0 or not a number."""
    plain = F.when(F.isnan(x.cast("double")), None).otherwise(x)
    return F.coalesce(F.nullif(plain, F.lit(0)), default if isinstance(default, Column) else F.lit(default))


def whole_number(x: Column, digits: int) -> Column:
    """The first number of exactly ``digits`` digits that stands apart from ASCII word characters; '' if none."""
    return F.regexp_extract(x, f"{EDGE_LEFT}([0-9]{{{digits}}}){EDGE_RIGHT}", 1)


def trailing_quantity(line: Column) -> Column:
    """The number that a line ends with, as DECIMAL(18,3); 0 if none. A carriage return at the end hides it."""
    return F.coalesce(F.regexp_extract(line, r"(-?[0-9]+(?:\.[0-9]+)?)\z", 1).try_cast("decimal(18,3)"), F.lit(0).cast("decimal(18,3)"))


def has_hebrew(x: Column) -> Column:
    return x.rlike(HEBREW)


def is_mixed(x: Column) -> Column:
    return x.rlike(HEBREW) & x.rlike("[A-Za-z]")


def normalize_hebrew(x: Column) -> Column:
    """Without points and marks, white space collapsed, trimmed."""
    return trim(F.regexp_replace(F.regexp_replace(x, MARKS, ""), f"{WS}+", " "))


def numbers_in(x: Column) -> Column:
    """All runs of ASCII digits as BIGINT; one beyond BIGINT is null."""
    return F.transform(F.regexp_extract_all(x, F.lit("([0-9]+)"), F.lit(1)), lambda n: n.try_cast("bigint"))


def clean_sku(x: Column) -> Column:
    """Hebrew and Latin letters, digits and hyphens."""
    return F.regexp_replace(x, r"[^א-תa-zA-Z0-9\-]", "")


def clean_barcode(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def clean_quantity(x: Column) -> Column:
    """The first run of digits, '0' if none; sign and decimals are lost."""
    return or_text(F.regexp_extract(x, "([0-9]+)", 1), "0")


def language_mix(x: Column) -> Column:
    """'he' or 'en' where one script has more than 1.5 times the other's letters, else 'mixed'."""
    he, en = F.regexp_count(x, F.lit(HEBREW)), F.regexp_count(x, F.lit("[A-Za-z]"))
    return F.when(he > en * 1.5, "he").when(en > he * 1.5, "en").otherwise("mixed")


def reading_order(line: Column) -> Column:
    """The tokens of a mostly Hebrew line in reverse order; other lines as they are."""
    tokens = F.filter(F.split(trim(line), f"{WS}+"), lambda t: t != "")
    return F.when(language_mix(line) == "he", F.array_join(F.reverse(tokens), " ")).otherwise(line)


def normalize_field(x: Column) -> Column:
    """Field form of a product name: no Latin diacritics, lower case, no punctuation but ( ) /, single spaces."""
    plain = F.translate(F.lower(x), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return trim(F.regexp_replace(F.regexp_replace(plain, r"[^\p{L}\p{N}\s()/]", ""), f"{WS}+", " "))


def text_confidence(x: Column) -> Column:
    """0 for no text; else 1, halved under 3 characters, times 0.7 over 30 % special ones, times 0.9 if longer than 5 and over 80 % digits."""
    n = F.length(x)
    special = F.regexp_count(x, F.lit(rf"[^\w\s֐-׿]")) / n
    digit = F.regexp_count(x, F.lit("[0-9]")) / n
    score = F.when(n < 3, 0.5).otherwise(1.0) * F.when(special > 0.3, 0.7).otherwise(1.0) * F.when((digit > 0.8) & (n > 5), 0.9).otherwise(1.0)
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def ean13_digit(first12: Column) -> Column:
    """The check digit of 12 digits."""
    total = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.lit(0), lambda a, i: a + F.substring(first12, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 3).otherwise(1))
    return ((10 - total % 10) % 10).cast("string")


def ean13_valid(code: Column) -> Column:
    return F.coalesce(F.when(code.rlike(r"\A[0-9]{13}\z"), ean13_digit(F.substring(code, 1, 12)) == F.substring(code, 13, 1)), F.lit(False))


def correct_ean13(code: Column) -> Column:
    """12 digits get a check digit, 13 digits a right one; anything else stays."""
    head = F.substring(code, 1, 12)
    return F.when(code.rlike(r"\A[0-9]{12,13}\z"), F.concat(head, ean13_digit(head))).otherwise(code)


def fix_digits(x: Column) -> Column:
    """In a token with a digit, letters that scanners take for digits become them: O 0, I and l 1, S 5, B 8."""
    return F.when(x.rlike("[0-9]"), F.translate(x, "OIlSB", "01158")).otherwise(x)


def correct_sku(x: Column) -> Column:
    """Digits fixed, then digits and hyphens only; 12 or 13 digits are completed as EAN-13."""
    bare = F.regexp_replace(fix_digits(x), r"[^0-9\-]", "")
    return correct_ean13(bare)


def correction_confidence(count: Column) -> Column:
    """1 less 0.05 for each correction, 0 at least."""
    return F.greatest(F.lit(0.0), 1 - count * 0.05)


def source_codes(sources: Column) -> Column:
    """'p{page}r{row}' of each source, comma-joined."""
    return F.array_join(F.transform(sources, lambda s: F.concat(F.lit("p"), s["page"].cast("string"), F.lit("r"), s["row"].cast("string"))), ", ")


def batch_id(at: Column) -> Column:
    """YYYY-MM-DD-<milliseconds in base 36>, of an explicit time; the day is the session's time zone's."""
    return batch_id_of(day_text(at), F.unix_millis(at))


def day_text(at: Column) -> Column:
    """YYYY-MM-DD of a date or time, years after 9999 with all their digits and no sign."""
    return F.regexp_replace(F.date_format(at, "yyyy-MM-dd"), r"\A\+", "")


def batch_id_of(day: Column, millis: Column) -> Column:
    """A batch's id from its day and its milliseconds since 1970, in capitals."""
    return F.concat(day, F.lit("-"), F.conv(millis.cast("string"), 10, 36))


def batch_id_utc(millis: Column) -> Column:
    """The id of a batch of that time, with its day in UTC, whatever the session's time zone."""
    return batch_id_of(F.regexp_replace(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(millis / 86_400_000).cast("int")).cast("string"), r"\A\+", ""), millis)


def export_name(batch: Column) -> Column:
    return F.concat(F.lit("Batch_"), F.regexp_replace(batch, "[^a-zA-Z0-9-]", "_"), F.lit(".xlsx"))
