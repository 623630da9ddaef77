import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size int, id string, n double, h int, score string, ids array<int>, lang_pred int, shard string, slot int, _maybe boolean, slots int"
LONG = "The quick brown fox, it's 12 o'clock. " * 9000

ROWS = [
    (1, "Hello world it's 12 o'clock\nsecond line", "en", "a"),
    (2, None, "en", "b"),
    (3, "", None, "a"),
    (4, "   ", "fr", None),
    (5, LONG, "en", "a"),
    (None, "a text without an id", "en", "b"),
    (6, "the same row twice over", "en", "c"),
    (6, "the same row twice over", "en", "c"),
    (7, "日本語 שלום é ½ <|endoftext|> 😀x", None, "Z"),
    (-8, "!!! ### 123 456", "de", "é"),
]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "k", 1, "i", 0.5, 3, "s", [1], 4, "x", 5, True, 6) for r in ROWS], SCHEMA)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)
