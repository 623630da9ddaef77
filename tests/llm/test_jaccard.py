import random

import numpy as np
import pytest

from tallyspark.llm import jaccard_join as J


def brute(rows, words=5, percent=75):
    """(id, set size, component) by comparing all pairs."""
    sets = []
    for i, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", low) if x]
        sets.append((i, {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()))
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                i, j = find(i), find(j)
                root[max(i, j)] = min(i, j)
    return sorted((i, len(s), find(i)) for i, s in sets)


def corpus(seed=5):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdef", k=draw.randint(1, 6)))
    base = [word() for _ in range(80)]
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(70):  # near copies around the threshold, more than one n-gram's few holders
        copy = list(base)
        for _ in range(draw.randint(0, 4)):
            copy[draw.randrange(len(copy))] = word()
        rows.append(" ".join(copy))
    for i in range(70):  # a shared passage in different texts
        rows.append(" ".join([word() for _ in range(draw.randint(10, 60))] + passage + [word() for _ in range(draw.randint(10, 60))]))
    for i in range(60):
        text = [word() for _ in range(draw.randint(1, 40))]
        rows += [" ".join(text), " ".join(text[: -draw.randint(1, 3)] + [word()])]
    rows += ["A b C d e", "a B c D E", "one two", "ONE two", "x", "", "   ", None]
    draw.shuffle(rows)
    return list(enumerate(rows))


def test_components_by_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, J.jaccard_join(docs).collect())) == brute(rows)
    again = J.jaccard_join(docs.limit(0))
    assert again.count() == 0 and again.columns == ["doc_id", "n_shingles", "component_id"]


def thue_morse(n):
    """Two words of 2 ** n letters whose polynomial hashes modulo a power of two agree."""
    one = "a"
    for _ in range(n):
        one += one.translate(str.maketrans("ab", "ba"))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomial_hashes_confuse_stay_apart(spark):
    docs = spark.createDataFrame([(i, w) for i, w in enumerate([*thue_morse(10), *thue_morse(11), *thue_morse(3)])], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in J.jaccard_join(docs).collect()) == [(i, i) for i in range(6)]


@pytest.mark.parametrize(("few", "common"), [(1, 7), (1000, J.COMMON_MOST)])
def test_either_way_of_finding_pairs_gives_the_same(spark, few, common):
    rows = corpus(8)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, J.jaccard_join(docs, few=few, common=common).collect())) == brute(rows)


def test_many_near_copies_and_an_ngram_in_every_document(spark):
    draw = random.Random(3)
    word = lambda: "".join(draw.choices("abcdefghij", k=6))
    base = [word() for _ in range(40)]
    rows = [" ".join([*base, word()]) for _ in range(5000)]
    rows += [" ".join(["in", "every", "one", "of", "them", *[word() for _ in range(draw.randint(1, 6))]]) for _ in range(1500)]
    rows[:5000] = [f"in every one of them {x}" for x in rows[:5000]]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in J.jaccard_join(docs).collect()}
    assert all(got[i] == 0 for i in range(5000))
    want = brute([(i, x) for i, x in enumerate(rows) if i >= 5000])
    assert [(i, got[i]) for i in range(5000, 6500)] == [(i, c) for i, _, c in want]


def test_long_texts_in_windows_have_the_same_set():
    draw = random.Random(2)
    text = "".join(draw.choice(["Ab", "c", "\n", " ", "  ", "dé", "\t"]) for _ in range(3000)).encode()
    data = np.frombuffer(text, np.uint8)
    whole, _ = J.Shingles(5)(data, np.array([0, len(data)]))
    for window in (7, 50, 1000):
        assert (J.Shingles(5, window)(data, np.array([0, len(data)]))[0] == whole).all()
    for few in (b"one two", b"x" * 500, b" " * 90):
        some = np.frombuffer(few, np.uint8)
        assert J.Shingles(5, 4)(some, np.array([0, len(some)]))[0].tolist() == J.Shingles(5)(some, np.array([0, len(some)]))[0].tolist()


def test_helper_names_dont_touch_the_callers_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x", 1, 2), (2, "a b c d e f", "y", 3, 4)], "doc_id long, text string, suspect string, row int, word int")
    kept = J.one_of_each(docs)
    assert [tuple(r) for r in kept.collect()] == [(1, "a b c d e f", "x", 1, 2)] and kept.columns == docs.columns


def test_edge_cases(odd):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in J.jaccard_join(odd).collect())
    assert [x for x in got if x[1] == 6] == [(False, 6, 1, 6)] * 2
    assert got[-1] == (True, 0, 1, None)
    assert [x[2:] for x in got if x[1] in (2, 3, 4)] == [(0, 2), (0, 3), (0, 4)]
    assert len(got) == 10


def test_a_null_key_takes_the_component_of_its_text(spark):
    docs = spark.createDataFrame([(None, "some words to share"), (4, "some words to share"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.component_id or -1) for r in J.jaccard_join(docs).collect()) == [(False, 4), (True, -1), (True, 4)]


def test_one_of_each(spark, odd, none):
    rows = corpus(6)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, _maybe string")
    want = {c for _, _, c in brute(rows)}
    kept = J.one_of_each(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want) and kept.columns == docs.columns
    assert {r._maybe for r in kept.collect()} == {"x"}
    assert sum(r.doc_id == 6 for r in J.one_of_each(odd).collect()) == 1
    assert J.one_of_each(none).count() == 0


def test_overlaps_sparse_and_dense_agree():
    draw = np.random.default_rng(1)
    left, right = ([np.unique(draw.integers(0, 4000, n).astype(np.uint64)) for n in draw.integers(1, 3000, 90)] for _ in range(2))
    want = np.array([[len(np.intersect1d(a, b)) for b in right[:20]] for a in left[:20]])
    assert (J._overlaps(left, right)[:20, :20] == want).all()
    assert (J._overlaps(left[:5], right[:5]) == want[:5, :5]).all()


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(10, 40)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (3, 100)]
    got = {r.id: r.component for r in J.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 10 for i in range(11, 41)) and all(got[200 + i] == 3 for i in range(50)) and got[100] == 3
    assert J.components(spark.createDataFrame([], "a long, b long")).count() == 0


def template(n, size=60):
    """Texts of one template: ten shared words, a word of their group, one of their own; groups link, different groups don't."""
    return [(i, " ".join([*(f"shared{k}" for k in range(10)), f"group{i // size}", f"own{i}"])) for i in range(n)]


def test_a_template_grows_in_proportion(spark, monkeypatch):
    plain, asked = J._compared, []

    def compared(left, right, *rest):
        asked[-1] += left.join(right.groupBy("gid").count(), "gid").agg({"count": "sum"}).first()[0] or 0
        return plain(left, right, *rest)

    monkeypatch.setattr(J, "_compared", compared)
    for n in (600, 1200, 2400):
        asked.append(0)
        rows = template(n)
        got = {r.doc_id: r.component_id for r in J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {i: i // 60 * 60 for i in range(n)}
    assert asked[2] < 4.6 * asked[0]


def test_templates_of_many_sizes_by_brute_force(spark):
    draw = random.Random(11)
    rows = [" ".join([*(f"shared{k}" for k in range(draw.randint(8, 14))), *(f"group{i // 20}" for _ in range(draw.randint(0, 2))), *(f"own{draw.randrange(40)}" for _ in range(draw.randint(0, 4)))]) for i in range(240)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for few in (3, 20):
        assert sorted(map(tuple, J.jaccard_join(docs, few=few).collect())) == brute(list(enumerate(rows)))


def test_only_ngrams_that_many_hold_meet_their_leaders_rows(spark):
    n = 60_000  # as many n-grams of two holders as fill a fair part of the filter
    single = spark.range(n).selectExpr("xxhash64(id, 'one') as h", "id", "20L as n", "0 as pos")
    twice = spark.range(n).selectExpr("xxhash64(id div 2, 'two') as h", "id", "20L as n", "1 as pos")
    hot = spark.range(100).selectExpr("7L as h", "id", "20 + id as n", "2 + cast(id % 3 as int) as pos")
    met, stars = J.shared_ngrams(single.unionByName(twice).unionByName(hot), 75, 48, [])
    assert sorted((r.h, r.id, r.n, r.rest) for r in stars.collect()) == [(7, i, 20 + i, 20 + i - (2 + i % 3) - 1) for i in range(100)]
    assert {r.leader % 3 for r in stars.collect()} == {0} and met.where("na = 20 and nb = 20 and c = 1 and b = a + 1").count() == met.count() == n // 2
    joined = spark.read.parquet(*stars.inputFiles()).count()
    assert 100 <= joined < 200
