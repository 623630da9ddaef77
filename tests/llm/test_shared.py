import os
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import _shared


def test_shared_folder_follows_the_session(spark):
    assert _shared.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    bare = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda name, default=None: default), sparkContext=SimpleNamespace(master=master))
    assert _shared.shared_folder(bare("local[2]")) == _shared.shared_folder(bare("local[2]"))
    with pytest.raises(ValueError):
        _shared.shared_folder(bare("spark://host:7077"))


def test_the_callers_session_is_left_alone(spark, odd):
    from tallyspark.llm import bpe_codec, jaccard_join, language_id

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    jaccard_join.jaccard_join(odd).count()
    language_id.predict(bpe_codec.encode(odd, __import__("public_tokenizers").path("byte_bpe_50k.json")), language_id.fit(odd, F.lit(True))).count()
    assert spark.conf.get(name) == before


def test_dropped_tables_are_gone(spark):
    scratch = []
    assert _shared.saved(spark.range(3).toDF("x"), "kept", scratch).count() == 3
    path = scratch[0]
    _shared.dropped(spark, scratch)
    assert not scratch and not os.path.exists(path)


def test_fresh_names():
    assert _shared.fresh(["a", "Text", "text_"], "text") == "text__" and _shared.fresh([], "x") == "x"


def test_string_bytes_of_slices_and_nulls():
    data, offsets = _shared.string_bytes(pa.array(["ab", None, "", "cé"]).slice(1))
    assert [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == ["", "", "cé"]
    assert _shared.string_bytes(pa.array([], pa.string()))[1].tolist() == [0]


def test_spans_cover_all_rows_once():
    offsets = np.array([0, 5, 5, 30, 31, 32])
    assert list(_shared.spans(offsets, 10)) == [(0, 2), (2, 3), (3, 5)]
    assert list(_shared.spans(np.array([0]), 10)) == []


def test_span_hash_depends_on_bytes_only():
    one, two = _shared.SpanHash(), _shared.SpanHash()
    data = np.frombuffer(b"abcXabc\0abc", np.uint8)
    h = one(data, np.array([0, 4, 8, 0]), np.array([3, 7, 11, 4]))
    assert h[0] == h[1] == h[2] != h[3] and h[0] == two(data[:3], np.array([0]), np.array([3]))[0]
    zeros = one(np.zeros(9, np.uint8), np.array([0, 0]), np.array([3, 4]))
    assert zeros[0] != zeros[1]
