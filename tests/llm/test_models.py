"""Classifiers: held-out accuracy, and their arithmetic against brute force."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import language_id, quality_crf, queries

FOLDER = "/root/testdata/sf0.01"


def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = queries.op10_language_id(spark, FOLDER).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count(F.lit(1))).first()
    assert n > 150 and right > 0.98


def test_language_edge_cases(spark, odd, none):
    model = language_id.fit(odd, F.lit(True))
    assert model.languages == ("de", "en", "fr")
    got = language_id.predict(odd, model)
    rows = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in got.collect()}
    for key in ((2, None), (3, ""), (4, "   "), (-8, "!!! ### 123 456")):
        assert rows[key] == ("und", 0.0)
    assert rows[6, "the same row twice over"][0] == "en" and got.count() == 10
    assert all(0 <= s <= 1 for _, s in rows.values())
    nothing = language_id.fit(none, F.lit(True))
    assert {r.lang_pred for r in language_id.predict(odd, nothing).collect()} == {"und"}
    assert language_id.predict(none, model).count() == 0


def test_language_scores_by_brute_force(spark):
    docs = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate([("abc abd", "x"), ("xyz xyw", "y"), ("abx", "x"), ("wyz", "y")])], "doc_id long, text string, lang string")
    model = language_id.fit(docs, F.lit(True))
    grams = language_id.Grams()
    for r in language_id.predict(docs, model).collect():
        data = np.frombuffer(r.text.encode(), np.uint8)
        _, found = grams(data, np.array([0, len(data)]))
        log_p = np.array([sum(one[g].sum() for g in found) for one in model.log_p]) + model.prior
        p = np.exp(log_p - log_p.max())
        assert r.score == pytest.approx((p / p.sum()).max()) and r.lang_pred == model.languages[int(log_p.argmax())]


def test_quality_accuracy_on_held_out_documents(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = queries.op4_quality_crf(spark, FOLDER).join(labels, "doc_id").where("held_out and quality is not null").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert len({r.predicted for r in rows}) == 2


def test_forward_backward_by_enumeration():
    draw = np.random.default_rng(3)
    first = np.array([0, 4, 5, 8])
    score, moves, start = draw.normal(size=8), draw.normal(size=(2, 2)), draw.normal(size=2)
    good, pairs, starts = quality_crf.forward_backward(score, first, moves, start)
    want, both, begin = np.zeros(8), np.zeros((2, 2)), np.zeros(2)
    for a, b in zip(first[:-1], first[1:], strict=True):
        total = 0.0
        sums, mine, heads = np.zeros(b - a), np.zeros((2, 2)), np.zeros(2)
        for path in itertools.product((0, 1), repeat=b - a):
            w = np.exp(start[path[0]] + sum((score[a + i] / 2) * (1 if s else -1) for i, s in enumerate(path)) + sum(moves[x, y] for x, y in itertools.pairwise(path)))
            total += w
            sums += w * np.array(path)
            heads[path[0]] += w
            for x, y in itertools.pairwise(path):
                mine[x, y] += w
        want[a:b] = sums / total
        both += mine / total
        begin += heads / total
    assert np.allclose(good, want) and np.allclose(pairs, both) and np.allclose(starts, begin)


def test_quality_edge_cases(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, None), (1, 1, 0), (6, 0, 1), (5, None, 0), (None, 1, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_crf.fit(odd, labels)
    got = quality_crf.score(odd, model)
    assert got.count() == 10 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.collect())
    assert {r.score for r in quality_crf.score(odd, quality_crf.fit(none, labels)).collect()} == {0.5}
    assert quality_crf.score(none, model).count() == 0


def test_line_features_do_not_depend_on_neighbouring_texts():
    hash_of = quality_crf.SpanHash()
    some = [b"one two\nthree", b"", b"x\n\nx\n", "ä b".encode()]
    data, offsets = np.frombuffer(b"".join(some), np.uint8), np.append(0, np.cumsum([len(x) for x in some]))
    together, _, first = quality_crf.line_features(data, offsets, hash_of)
    for i, x in enumerate(some):
        alone, _, _ = quality_crf.line_features(np.frombuffer(x, np.uint8), np.array([0, len(x)]), hash_of)
        assert np.allclose(together[first[i] : first[i + 1]], alone)


def plain_lines(text):
    """(own features, bytes) of each line of a text, one line and one word at a time."""
    lines, out = text.encode().split(b"\n"), []
    kind = lambda b: 6 if b >= 128 else 0 if 97 <= b <= 122 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if b in b" \t\r\n\x0b\x0c" else 4 if b in b".,;:'\"()-?" else 5
    for line in lines:
        n, kinds = len(line), [kind(b) for b in line]
        share = lambda k: kinds.count(k) / max(n, 1)
        words = line.split()
        letters = share(0) + share(1) + share(6)
        before = 10
        again = 0
        for b in line:
            again += b == before and kind(b) in (4, 5)
            before = b
        count = [words.count(w) for w in words]
        many = max(len(words), 1)
        out.append([
            np.log1p(n) / 6, letters, share(1) / max(letters, 1e-9), share(2), share(3), share(4), share(5), share(6), again / max(n, 1), min(n / many, 40) / 10,
            len(set(words)) / many, max(count, default=0) / many, sum(kind(w[-1]) == 5 for w in words) / many, np.log(lines.count(line)) if n else 0,
            float(n > 0 and kinds[-1] == 4), np.log1p(len(words)) / 5, np.log1p(len(lines)) / 5,
        ])
    return out, [len(x) for x in lines]


def plain_score(text, model):
    """Weighted mean of the marginals, by all paths."""
    own, sizes = plain_lines(text)
    none = [0.0] * len(own[0])
    line = []
    for i, x in enumerate(own):
        row = np.array([*x, *(own[i - 1] if i else none), *(own[i + 1] if i + 1 < len(own) else none)])
        line.append(float(np.clip((row - model.mean) / model.scale, -6, 6) @ model.weights + model.bias))
    total, good = 0.0, np.zeros(len(line))
    for path in itertools.product((0, 1), repeat=len(line)):
        w = np.exp(model.start[path[0]] + sum((s / 2) * (1 if y else -1) for s, y in zip(line, path, strict=True)) + sum(model.moves[a, b] for a, b in itertools.pairwise(path)))
        total, good = total + w, good + w * np.array(path)
    weight = np.array(sizes) + 1
    return float((good / total * weight).sum() / weight.sum())


def test_quality_scores_by_plain_python(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = quality_crf.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    extra = ["", "\n", "One line.", "A b a b!!\n\nA b a b!!\nÄöü 12 ??", "x  y\tz...\n--- ==\n"]
    some = [t for t in rows.values() if t.count("\n") < 10][:120] + extra
    asked = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    for r in quality_crf.score(asked, model).collect():
        assert r.score == pytest.approx(plain_score(some[r.doc_id], model), abs=1e-6)


def test_lines_differ_within_a_document():
    draw = np.random.default_rng(9)
    good = lambda: " ".join("".join(draw.choice(list("abcdefgh"), 5)) for _ in range(8)) + "."
    bad = lambda: " ".join(draw.choice(["$$$", "###", "!!!", "@@"], 8))
    # bad documents hold good lines too, and good ones a bad line
    texts = [(0, [bad() if i % 4 else good() for i in range(16)]) for _ in range(40)] + [(1, [good() if i % 8 != 3 else bad() for i in range(16)]) for _ in range(40)]
    data = np.frombuffer("".join("\n".join(x) for _, x in texts).encode(), np.uint8)
    offsets = np.append(0, np.cumsum([len("\n".join(x).encode()) for _, x in texts]))
    x, size, first = quality_crf.line_features(data, offsets, quality_crf.SpanHash())
    model = quality_crf.train(x.astype(np.float32), first, np.array([y for y, _ in texts]))
    p, _, _ = quality_crf.forward_backward(model.lines(x), first, model.moves, model.start)
    kinds = np.array([line[0].isalpha() for _, lines in texts for line in lines])
    label = np.repeat([y for y, _ in texts], 16)
    assert p[kinds & (label == 0)].mean() > p[~kinds & (label == 0)].mean() + 0.1 and p[kinds & (label == 1)].mean() > p[~kinds & (label == 1)].mean() + 0.1
    score = np.add.reduceat(p * (size + 1), first[:-1]) / np.add.reduceat(size + 1, first[:-1])
    assert score[40:].min() > score[:40].max()


def test_fitted_lines_meet_the_documents_label():
    draw = np.random.default_rng(5)
    first, label = np.array([0, 3, 8, 9, 15]), np.array([1, 0, 1, 0])
    score, weight, moves, start = draw.normal(size=15), draw.uniform(1, 9, 15), draw.normal(size=(2, 2)), draw.normal(size=2)
    good, _, _ = quality_crf.fitting(score, first, weight, label, moves, start)
    mean = np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])
    assert (mean[label == 1] > 0.9 - 1e-3).all() and (mean[label == 0] < 0.1 + 1e-3).all()


def test_long_texts_score_alike_in_windows():
    draw = np.random.default_rng(2)
    words = ["one", "Two!", "3", "", "four.", "ü"]
    text = "\n".join(" ".join(draw.choice(words, int(draw.integers(0, 6)))) for _ in range(400)).encode()
    hash_of = quality_crf.SpanHash()
    data = np.frombuffer(text, np.uint8)
    x, size, first = quality_crf.line_features(data, np.array([0, len(data)]), hash_of)
    model = quality_crf.ChainModel(x.mean(0), x.std(0) + 1e-6, draw.normal(size=x.shape[1]), 0.3, np.zeros((2, 2)), np.zeros(2))
    for window in (40, 333, 10_000):
        line, sizes = model.long_text(data, hash_of, window)
        assert np.allclose(line, model.lines(x)) and (sizes == size).all()


@pytest.mark.parametrize("rest", [0, 5, 70_000])
def test_very_long_lines_are_cut_alike(rest):
    hash_of = quality_crf.SpanHash()
    text = b"short\n" + b"ab " * 50_000 + b"x" * rest + b"\nend"
    data = np.frombuffer(text, np.uint8)
    x, size, _ = quality_crf.line_features(data, np.array([0, len(data)]), hash_of)
    model = quality_crf.ChainModel(x.mean(0), x.std(0) + 1e-6, np.ones(x.shape[1]), 0.0, np.zeros((2, 2)), np.zeros(2))
    line, sizes = model.long_text(data, hash_of, 70_000)
    assert size.max() <= quality_crf.LINE_BYTES and (sizes == size).all() and np.allclose(line, model.lines(x))


def test_languages_of_long_texts_in_windows(spark):
    grams = language_id.Grams()
    data = np.frombuffer(("Größe, ß日本 x1 " * 300).encode(), np.uint8)
    ends, whole = grams(data, np.array([0, len(data)]))
    for window in (5, 64, 1000):
        parts = [*grams.windows(data, window)]
        assert all((np.concatenate([p[k] for p in parts]) == whole[k]).all() for k in range(3))
    docs = spark.createDataFrame([(1, "abc abd " * 200_000, "x"), (2, "xyz xyw", "y"), (3, "abx", "x")], "doc_id long, text string, lang string")
    model = language_id.fit(docs, F.lit(True))
    assert [r.lang_pred for r in language_id.predict(docs, model).orderBy("doc_id").collect()] == ["x", "y", "x"]


def test_helper_names_dont_touch_the_callers_columns(spark):
    docs = spark.createDataFrame([(1, "abc", "x", "kept", "too")], "doc_id long, text string, lang string, text_to_tell string, lettered string")
    r = language_id.predict(docs, language_id.fit(docs, F.lit(True))).first()
    assert (r.text_to_tell, r.lettered, r.lang_pred) == ("kept", "too", "x")


def test_languages_without_keys_and_of_one_key_are_learned(spark):
    german = [(None, f"der hund und die katze {i}", "de") for i in range(4000)]
    french = [(7, f"le chien et le chat {i}", "fr") for i in range(4000)]
    english = [(i, f"the dog and the cat {i}", "en") for i in range(4000)]
    docs = spark.createDataFrame(german + french + english, "doc_id long, text string, lang string")
    for sample in (50, 3000):
        model = language_id.fit(docs, F.lit(True), sample=sample)
        ask = spark.createDataFrame([(1, "der hund und die katze"), (2, "the dog and the cat"), (3, "le chien et le chat")], "doc_id long, text string")
        assert {r.doc_id: r.lang_pred for r in language_id.predict(ask, model).collect()} == {1: "de", 2: "en", 3: "fr"}


def test_quality_sample_bounds_rows_of_one_key(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_crf, "train", lambda features, first, label: seen.append((len(features), len(first) - 1)))
    key = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5)
    docs = spark.createDataFrame([(key, f"line {i}\nand {i}\nmore") for i in range(500)], "doc_id long, text string")
    quality_crf.fit(docs, spark.createDataFrame([(key, 1)], "doc_id long, quality int"), sample=10, lines=2)
    assert seen == [(20, 10)]
