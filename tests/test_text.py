from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.functions import numbers as N
from tallyspark.functions import similarity as similar
from tallyspark.functions import text as T
from tallyspark.functions.similarity import jaro_winkler_pair, length_bound, similarity


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("f", "x", "y"),
    [
        (T.trim, "  a b﻿\t", "a b"),
        (T.normalize_hebrew, " א־ב  ג ", "אב ג"),
        (T.clean_sku, "א a-1!", "אa-1"),
        (T.clean_barcode, "7a9", "79"),
        (T.clean_quantity, "-3.5", "3"),
        (T.clean_quantity, "x", "0"),
        (T.language_mix, "אבג", "he"),
        (T.language_mix, "אבגab", "mixed"),
        (T.language_mix, "אבגדab", "he"),
        (T.language_mix, "123", "mixed"),
        (T.normalize_field, " Café, (24) 1/12! ", "cafe (24) 1/12"),
        (T.correct_ean13, "400638133393", "4006381333931"),
        (T.correct_ean13, "4006381333930", "4006381333931"),
        (T.correct_ean13, "12", "12"),
        (T.correct_sku, "881O8", "88108"),
        (T.reading_order, "אב גד 5", "5 גד אב"),
        (T.reading_order, "ab cd", "ab cd"),
        (T.export_name, "2026 01/a", "Batch_2026_01_a.xlsx"),
        (lambda c: T.whole_number(c, 5), "אב12345 x", "12345"),
        (lambda c: T.whole_number(c, 5), "123456 a12345", ""),
    ],
)
def test_text(spark, f, x, y):
    assert one(spark, x, f) == y


def test_numbers_and_ean(spark):
    assert one(spark, "a12b7", T.numbers_in) == [12, 7]
    assert one(spark, "4006381333931", T.ean13_valid) is True
    assert one(spark, None, T.ean13_valid) is False


@pytest.mark.parametrize(("line", "q"), [("a 12", 12), ("a -3.5", "-3.5"), ("a 12\r", 0), ("a", 0), ("x 7290018813505", 7290018813505)])
def test_trailing_quantity(spark, line, q):
    assert one(spark, line, T.trailing_quantity) == Decimal(str(q))


@pytest.mark.parametrize(("x", "y"), [("", 0.0), ("ab", 0.5), ("a!!!", 0.7), ("123456", 0.9), ("abc", 1.0), (None, 0.0)])
def test_confidence(spark, x, y):
    assert one(spark, x, T.text_confidence) == pytest.approx(y)


@pytest.mark.parametrize(("x", "y"), [(-2.5, -2.0), (2.5, 3.0), (1.005, 1.0)])
def test_rounding_halves_up(spark, x, y):
    assert one(spark, x, lambda c: N.round_half_up(c, 0 if x != 1.005 else 2), "double") == y


def test_money(spark):
    assert one(spark, -1234.5, N.dollars, "double") == "-$1,234.50"
    assert one(spark, 0.987, N.percent_text, "double") == "98.7%"
    row = spark.createDataFrame([(100.0, 10.0, 0.17)], "p double, d double, r double").select(N.final_price(F.col("p"), F.col("d"), F.col("r")).alias("y")).first()
    assert row.y == 105.3


def test_jaro_winkler():
    assert jaro_winkler_pair("", "") == 1
    assert jaro_winkler_pair("a", "a") == 0
    assert jaro_winkler_pair("abcdefgh", "bcadefgh") == pytest.approx(0.9375)
    assert jaro_winkler_pair("abcdef", "abxyzw") == pytest.approx(0.6444, abs=1e-4)


@settings(deadline=None)
@given(st.text("abcé", max_size=12), st.text("abcé", max_size=12))
def test_scores_stay_under_the_length_bound(a, b):
    longest = max(len(a), len(b))
    if not longest:
        return
    ratio = min(len(a), len(b)) / longest
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            rows[i][j] = max(i, j) if not i or not j else min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    score = 0.4 * (1 - rows[-1][-1] / longest) + 0.6 * jaro_winkler_pair(a, b)
    assert ratio >= length_bound(score) - 1e-9


def test_similarity_ignores_case_and_space(spark):
    assert spark.createDataFrame([(" AB ", "ab")], "a string, b string").select(similarity(F.col("a"), F.col("b")).alias("s")).first().s == 1.0


def plain_jaro_winkler(a, b):
    """One pair, a character at a time."""
    if not a and not b:
        return 1.0
    reach, free, mine = max(len(a), len(b)) // 2 - 1, [True] * len(b), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if free[j] and b[j] == c), None)
        if j is not None:
            free[j] = False
            mine.append(c)
    if not mine:
        return 0.0
    theirs = [c for c, f in zip(b, free, strict=True) if not f]
    m = len(mine)
    jaro = (m / len(a) + m / len(b) + (m - sum(x != y for x, y in zip(mine, theirs, strict=True)) / 2) / m) / 3
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return jaro + same * 0.1 * (1 - jaro)


def plain_distance(a, b):
    before = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row = [i]
        for j, d in enumerate(b, 1):
            row.append(min(row[j - 1] + 1, before[j] + 1, before[j - 1] + (c != d)))
        before = row
    return before[-1]


words = st.lists(st.text("abcשa ", max_size=14), min_size=1, max_size=6)


@settings(max_examples=300, deadline=None)
@given(words, words)
def test_pairs_at_once_score_like_one_by_one(left, right):
    n = min(len(left), len(right))
    left, right = left[:n], right[:n]
    assert similar.jaro_winkler_pairs(left, right).tolist() == pytest.approx([plain_jaro_winkler(a, b) for a, b in zip(left, right, strict=True)])
    assert similar.distances(left, right).tolist() == [plain_distance(a, b) for a, b in zip(left, right, strict=True)]


def test_functions_for_sql(spark):
    similar.register(spark)
    row = spark.sql("SELECT jaro_winkler('a', 'a') AS one, similarity_score(' Abc ', 'abc') AS same, similarity_score('abcd', 'abce') AS near, similarity_score(null, 'x') AS none").first()
    assert (row.one, row.same, row.none) == (0.0, 1.0, None) and row.near == pytest.approx(0.4 * 0.75 + 0.6 * plain_jaro_winkler("abcd", "abce"))
