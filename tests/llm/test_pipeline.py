"""The pipeline's stages against plain Python over their own inputs."""

import re
from pathlib import Path

import public_tokenizers
import pytest

import corpus_pipeline
from tallyspark.llm._pieces import encoder
from tallyspark.llm._shared import shared_folder

from .test_jaccard import brute


@pytest.fixture
def folder(spark, tmp_path):
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    rows = [(i, " ".join(words[(i * 7 + k * (1 + i % 5)) % 8] + str((i * k) % 9) for k in range(30 + i % 11)), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, rows[i][1] + " tail", "en", "s1") for i in range(10)]
    rows += [(200, "### 123", "en", "s0"), (201, None, "en", "s0"), (202, "", None, None), (203, 'here token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ok', "en", None), (None, "no id but words", "en", "s2"), (204, rows[0][1], "en", "s2"), (204, rows[0][1], "en", "s2")]
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, key string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], folder).write.parquet(str(tmp_path / f"out{k}"))
        seen.append(spark.read.parquet(str(tmp_path / f"out{k}")))
    start, language, single, clean, mixed, coded = [[r.asDict() for r in f.collect()] for f in seen]
    assert sorted(r["doc_id"] or -1 for r in language) == sorted(r["doc_id"] or -1 for r in start if r["text"] and re.search("[a-z]", r["text"]))
    kept = {c for _, _, c in brute(sorted({(r["doc_id"], r["text"]) for r in language if r["doc_id"] is not None}))}
    assert sorted(r["doc_id"] for r in single if r["doc_id"] is not None) == sorted(kept) and sum(r["doc_id"] is None for r in single) == 1
    for a, b in zip(sorted(single, key=str), sorted(clean, key=str), strict=True):
        assert b["n_chars"] == len(b["text"])
    assert not any("04dbebab" in r["text"] for r in clean) and sum("[SECRET]" in r["text"] for r in clean) == 1
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in clean}
    often = [sum(r["doc_id"] == i for r in mixed) for i in {r["doc_id"] for r in mixed}]
    assert max(often) <= 2 and abs(len(mixed) - 1.5 * len(clean)) < 0.2 * len(clean)
    library = encoder(public_tokenizers.path(corpus_pipeline.VOCABULARY)).library
    want = sorted((r["doc_id"] or -1, library.encode(r["text"]).ids) for r in mixed)
    assert sorted((r["doc_id"] or -1, r["ids"]) for r in coded) == want


def test_run_and_empty_table(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 40
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(str(tmp_path / "e" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "e")).count() == 0


def test_run_leaves_the_session_and_only_its_last_table(spark, folder):
    before = {r["key"]: r["value"] for r in spark.sql("SET").collect()}
    tables = lambda: {p.name for p in Path(shared_folder(spark)).iterdir() if p.name.startswith("pipeline")}
    old = tables()
    corpus_pipeline.run(spark, folder)
    assert {r["key"]: r["value"] for r in spark.sql("SET").collect()} == before
    assert [name.rsplit("-", 1)[0] for name in tables() - old] == ["pipeline-byte-level-BPE-encoding-and-decoding"]
