"""The index of names against full comparison."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.functions.similarity import distances, similarity_pairs
from tallyspark.operators import fuzzy, names_index


def misread(draw, text, times):
    for _ in range(times):
        i = draw.randrange(len(text) + 1)
        text = draw.choice([text[:i] + draw.choice("abcd e") + text[i:], text[:i] + text[i + 1 :], text[:i] + draw.choice("abxy") + text[i + 1 :], text[: max(i - 1, 0)] + text[max(i - 1, 0) : i + 1][::-1] + text[i + 1 :]])
    return text


@settings(max_examples=400, deadline=None)
@given(st.text("abc d", max_size=90), st.integers(0, 2**32 - 1), st.integers(0, 9), st.sampled_from([0.8, 0.85, 0.9, 0.93, 0.97, 1.0]))
def test_texts_that_score_share_a_key(text, seed, times, least):
    draw = random.Random(seed)
    other = misread(draw, text, times)
    often = {a + b: draw.randrange(100) for a in "abc d" for b in "abc d"}
    if similarity_pairs([text], [other])[0] >= least:
        longest = max(len(text), len(other))
        assert distances([text], [other])[0] <= names_index.most_edits(longest, least)
        assert names_index.keys(text, least, often) & names_index.keys(other, least, often)


@settings(max_examples=400, deadline=None)
@given(st.text("ab c", min_size=1, max_size=14), st.text("ab c", min_size=1, max_size=14))
def test_score_bounds_the_edits(a, b):
    score, edits, longest = similarity_pairs([a], [b])[0], distances([a], [b])[0], max(len(a), len(b))
    assert 2 * edits >= longest or score <= 1 - names_index.EDIT * edits / longest + 1e-9
    assert 2 * edits < longest or score < names_index.LEAST


@pytest.mark.parametrize(("longest", "edits"), [(5, 1), (10, 2), (23, 5), (24, 5), (64, 13), (65, 14), (69, 15)])
def test_both_sides_of_the_bound(longest, edits):
    assert names_index.most_edits(longest, 0.9) == edits
    assert names_index.shared_least(longest, 0.9) == longest - 1 - 2 * edits
    # the longest partner differs by as many letters as there may be edits; one letter more is out of reach
    most = names_index.partners(longest, 0.9)[-1]
    assert most - longest <= names_index.most_edits(most, 0.9) and most + 1 - longest > names_index.most_edits(most + 1, 0.9)


def product_names(draw, n):
    syllables = [c + v for c in "bcdfglmnprstvz" for v in "aeiou"]
    words = ["".join(draw.choices(syllables, k=draw.randint(2, 4))) for _ in range(600)]
    return sorted({" ".join(draw.choices(words, k=3)) for _ in range(n)})


def test_pairs_met_grow_slower_than_all_pairs(spark):
    draw, met = random.Random(4), []
    for n in (400, 1600):
        names = product_names(random.Random(n), n)
        asked = [misread(draw, x, 1) for x in names]
        left, right = spark.createDataFrame([(x, x) for x in asked], "n string, x string"), spark.createDataFrame([(x, i, x) for i, x in enumerate(names)], "c string, cand_seq long, y string")
        met.append(names_index.met(left, right, 0.9).count())
        assert names_index.matches(left, right, 0.9).select("n").distinct().count() > 0.9 * len(set(asked))
    assert met[0] < 400 * 400 / 16 and met[1] < 1600 * 1600 / 16


def brute(names, candidates, least, n):
    first = {}
    for c, seq in candidates:
        if c is not None:
            first[c] = min(first.get(c, seq), seq)
    out = set()
    for x in {x for x in names if x is not None}:
        scores = similarity_pairs([x.strip().lower()] * len(first), [c.strip().lower() for c in first])
        ranked = sorted((-s, seq, c) for s, (c, seq) in zip(scores.tolist(), first.items(), strict=True) if s >= least)
        out |= {(x, c, seq, round(-s, 12), k + 1) for k, (s, seq, c) in enumerate(ranked[:n])}
    return out


def rows(frame):
    return {(r.name, r.candidate, r.cand_seq, round(r.score, 12), r["rank"]) for r in frame.collect()}


@pytest.mark.parametrize(("least", "n", "pairs"), [(0.0, 3, 0), (0.7, 2, 0), (0.85, 2, 0), (0.95, 1, 0), (0.5, 2, fuzzy.PAIRS)])
def test_best_of_each_name_equals_full_comparison(spark, monkeypatch, least, n, pairs):
    monkeypatch.setattr(fuzzy, "PAIRS", pairs)
    draw = random.Random(7)
    known = product_names(draw, 60) + ["a", "b", "", "ab", "Ab ", "x" * 70 + " y", "x" * 66 + " yy"]
    asked = [misread(draw, x, draw.randint(0, 4)) for x in known for _ in range(2)] + [None, "", "zzz", "x" * 70]
    candidates = [(c, i) for i, c in enumerate(known)] + [(known[0], 900), (None, 3)]
    names = spark.createDataFrame([(x,) for x in asked], "name string")
    got = fuzzy.top_matches(names, spark.createDataFrame(candidates, "candidate string, cand_seq long"), n, least)
    assert rows(got) == brute(asked, candidates, least, n)


def test_find_matches_on_both_sides_of_the_index(spark):
    draw = random.Random(9)
    known = product_names(draw, 50)
    asked = [misread(draw, x, draw.randint(0, 5)) for x in known]
    names, candidates = spark.createDataFrame([(x,) for x in asked], "name string"), spark.createDataFrame(list(zip(known, range(50), strict=False)), "candidate string, cand_seq long")
    for least in (names_index.LEAST - 0.01, names_index.LEAST, 0.9):
        got = {(r.name, r.candidate) for r in fuzzy.find_matches(names, candidates, least).collect()}
        assert got == {(x, c) for x, c, *_ in brute(asked, list(zip(known, range(50), strict=False)), least, 1000)}


def test_no_names_or_candidates(spark):
    none, some = spark.createDataFrame([], "name string"), spark.createDataFrame([("x", 1)], "candidate string, cand_seq long")
    assert fuzzy.nearest(none, some).count() == 0
    assert fuzzy.nearest(spark.createDataFrame([("x",)], "name string"), some.where(F.lit(False))).count() == 0
