import random
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import filter_audit

from .conftest import ROWS

LABELS = [(1, 1, 0), (5, 1, 1), (5, 0, 0), (6, 0, 1), (11, 1, None), (None, 1, 1), (99, 1, 1), (8, None, 1)]


def documents():
    draw = random.Random(5)
    long = " ".join(f"w{i}" for i in range(150))
    more = [(i, draw.choice([long, long.upper(), long + " $", "a " * 120, "a b c " * 60, "Ab" * 3, "", None, "x\x1cy\x0bz" * 40]), draw.choice(["en", "de", None, ""]), "s") for i in range(8, 90)]
    return [*ROWS, *more, (11, long, "en", "s"), (11, long, "en", "s"), (None, long, "fr", "s"), (200, "\u00a0".join("x" * 3 for _ in range(120)) + "É" * 30, "fr", "s")]


def brute(docs, labels):
    fails, good, toxic = [], {i for i, q, _ in labels if i is not None and q == 1}, {i for i, _, t in labels if i is not None and t == 1}
    for i, text, lang, *_ in docs:
        text = text or ""
        words = text.encode().split()
        same = [j for j, t, *_ in docs if (t or "") == text and j is not None]
        f = {n for n, yes in zip("ABCDE", (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), any(c in "#$%&*|" for c in text), i is not None and any(j < i for j in same)), strict=True) if yes}
        fails.append((i, lang or "", f))
    out = {}
    for part in {p for _, p, _ in fails}:
        mine = [(i, f) for i, p, f in fails if p == part]
        for order in permutations("ABCDE"):
            left = mine
            for k, x in enumerate(order):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                out[part, "".join(order), k + 1] = [len(left), len(gone), sum(x in f for _, f in mine) - len(gone), sum(f == {x} for _, f in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for x in "ABCDE":
            whole = sum(out[part, "".join(o), o.index(x) + 1][1] for o in permutations("ABCDE"))
            for o in permutations("ABCDE"):
                out[part, "".join(o), o.index(x) + 1].append(whole)
    return sorted((*k, *v) for k, v in out.items())


def audited(spark, docs, partitions=1):
    frame = spark.createDataFrame([(*r[:4], 0, 1, "m", 3) for r in docs], "doc_id long, text string, lang string, source string, mask int, cut int, mark string, run int").repartition(partitions)
    labels = spark.createDataFrame([(*r, "p") for r in LABELS], "doc_id long, quality int, toxic int, part string")
    found = filter_audit.audit(frame, labels)
    return sorted(map(tuple, found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()))


@pytest.mark.parametrize("partitions", [1, 7])
def test_equals_brute_force(spark, partitions):
    assert audited(spark, documents(), partitions) == brute(documents(), LABELS)


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [r[:3] for r in documents()])
    con.execute("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    con.executemany("INSERT INTO labels VALUES (?, ?, ?)", LABELS)
    assert audited(spark, documents()) == sorted(con.sql(filter_audit.ORACLE).fetchall())


@pytest.mark.parametrize("mark", ["0", "length(text) % 3"])
def test_texts_that_share_a_fingerprint_or_span_partitions(spark, monkeypatch, mark):
    monkeypatch.setattr(filter_audit, "fingerprint", lambda text: F.expr(f"cast({mark} as long)"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        copies = [(i, "one and the same", "en", "s") for i in range(300, 500)]
        assert audited(spark, [*documents(), *copies], 5) == brute([*documents(), *copies], LABELS)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_long_texts_are_measured_in_windows(monkeypatch):
    texts = [" ".join(f"w{i % 700}" for i in range(900)) + " end", "é $ ABC " * 300, "x" * 5000, "", "a b " * 999, " ".join(f"w{i}" for i in range(2000))]
    whole = [filter_audit.failures(memoryview(t.encode())) for t in texts]
    monkeypatch.setattr(filter_audit, "WINDOW", 64)
    assert [filter_audit.failures(memoryview(t.encode())) for t in texts] == whole
    assert [filter_audit.word_counts(memoryview(t.encode()))[0] for t in texts] == [len(t.split()) for t in texts]


def test_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(none, labels).count() == 0
    one = filter_audit.audit(spark.createDataFrame([(1, "x", None)], "doc_id long, text string, lang string"), labels)
    assert one.count() == 600 and one.agg(F.sum("removed")).first()[0] == 120
