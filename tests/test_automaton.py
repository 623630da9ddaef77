"""Many words at once against one at a time."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.functions import automaton
from tallyspark.operators import corrections, fuzzy, rules

letters = st.text("abאב1 ", max_size=12)


@settings(max_examples=300, deadline=None)
@given(st.lists(letters, max_size=12), st.lists(letters, max_size=8), st.sampled_from([4, 60, 1 << 20]), st.integers(0, 12))
def test_first_words(texts, words, cells, least):
    made = automaton.automata(words, cells)
    want = [next((i for i, w in enumerate(words) if w in t), len(words)) for t in texts]
    assert automaton.first_words(texts, made, len(words)).tolist() == want
    for t in texts:
        assert automaton.next_word(t, made, least) == next((i for i, w in enumerate(words) if i >= least and w in t), None)


def listed(draw, n):
    word = lambda: "".join(draw.choices("abcdefghij (1/)", k=draw.randint(2, 6)))
    kinds = lambda i: "regex" if i % 97 == 5 else "brand" if i % 5 == 0 else "contains"
    return [{"id": f"R{i:05d}", "priority": draw.randrange(50), "type": kinds(i), "value": f"{draw.choice('abc')}+[d-f]$" if kinds(i) == "regex" else word(), "packSize": i, "allowUnits": i % 2 == 0} for i in range(n)]


def by_hand(name, rules_):
    import re

    for r in sorted(rules_, key=lambda r: (r["priority"], r["id"])):
        hit = {"contains": lambda v: v in name, "brand": lambda v: name.lower().startswith(v.lower()), "regex": lambda v: re.search(v, name)}[r["type"]](r["value"])
        if hit:
            return r["id"], r["packSize"], r["allowUnits"]
    return None, None, None


@pytest.mark.parametrize("n", [0, 30, 400, 10_000])
def test_name_rules_equal_one_at_a_time(spark, n):
    draw = random.Random(n)
    made = listed(draw, n)
    names = ["".join(draw.choices("abcdefghij (1/)XYZ", k=draw.randint(0, 14))) for _ in range(200)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*names, None])], "i int, name string")
    got = {r.i: (r.rule_id, r.rule_pack_size, r.rule_allows) for r in rules.match_names(rows, made).collect()}
    assert got == {i: by_hand(x, made) for i, x in enumerate(names)} | {200: (None, None, None)}


def test_short_and_long_lists_agree(spark, monkeypatch):
    made = listed(random.Random(3), 35)
    rows = spark.createDataFrame([("abc (1)",), ("1/j",), ("",), (None,), ("ABC",), ("cd efg",)], "name string")
    by_case = sorted(map(str, rules.match_names(rows, made).collect()))
    monkeypatch.setattr(automaton, "PLAIN", 0)
    assert sorted(map(str, rules.match_names(rows, made).select("name", "rule_id", "rule_pack_size", "rule_allows").collect())) == by_case


def test_plans_dont_grow_with_the_rules(spark):
    rows = spark.createDataFrame([("abc",)], "name string")
    word = lambda i: {"id": f"R{i:05d}", "priority": 1, "type": "contains", "value": f"w{i}", "packSize": i, "allowUnits": True}
    size = lambda n: len(rules.match_names(rows, [word(i) for i in range(n)])._jdf.queryExecution().optimizedPlan().treeString())
    assert size(5000) < 1.2 * size(100)


def test_patterns_of_a_configured_rule(spark):
    words = tuple(f"w{i}x" for i in range(100))
    rows = spark.createDataFrame([("a w7x",), ("a w7",), (None,)], "name string").select(rules.contains_any(F.col("name"), words).alias("long"), rules.contains_any(F.col("name"), words[:20]).alias("short"))
    assert [tuple(r) for r in rows.collect()] == [(True, True), (False, False), (None, None)]


CONTEXTS = ["name", "hebrew_word", "hebrew_letter_in_numeric_field"]


@pytest.mark.parametrize("seed", range(3))
def test_long_dictionaries_equal_short_ones(spark, monkeypatch, seed):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("אבג0O1a", k=draw.randint(1, 3)))
    entries = [{"misread": word(), "correction": word(), "context": draw.choice(CONTEXTS)} for _ in range(fuzzy.ENTRIES)]
    rows = spark.createDataFrame([(i, None if i == 0 else "".join(draw.choices("אבג0O1a z", k=i % 25))) for i in range(120)], "i int, text string")
    one = {r.i: (r.corrected, r.corrections) for r in fuzzy.dictionary_corrected(rows, entries).collect()}
    monkeypatch.setattr(fuzzy, "ENTRIES", 0)
    two = {r.i: (r.corrected, r.corrections) for r in fuzzy.dictionary_corrected(rows, entries).collect()}
    assert one == two and sum(n or 0 for _, n in one.values()) > 20


def test_whole_texts_of_a_long_dictionary(spark):
    entries = [{"misread": f"sma1{i}", "correction": f"small {i}"} for i in range(500)] + [{"misread": "sma17", "correction": "never"}]
    rows = spark.createDataFrame([("smal7",), ("other",), (None,)], "text string")
    got = {r.text: (r.correction.text, len(r.correction.corrections)) for r in corrections.corrected(rows, entries).collect()}
    assert got == {"smal7": ("small 7", 2), "other": ("other", 0), None: (None, 0)}
