"""Token operators against the libraries themselves."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import bpe_codec, token_counts, token_output
from tallyspark.llm._pieces import PieceEncoder, encoder
from tallyspark.llm._shared import string_bytes

from .conftest import ROWS

JSON, RANKS, MODEL = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"))
#: Pieces of text that the split pattern treats in different ways.
BITS = ["'", "s", "t", "re", "ll", "ve", "m", "d", " ", "  ", "\n", "\t", " ", "　", "a", "é", "Z", "ß", "1", "٣", "½", "!", "...", "日本", "שלום", "😀", "é", "‍", "\r\n", "x'll", "'re ", "<|endoftext|>", "_", "\u0085"]
texts = st.lists(st.sampled_from(BITS), max_size=30).map("".join)


@pytest.fixture(scope="module")
def rank_library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(code: PieceEncoder, some: list[str]) -> list[list[int]]:
    data, offsets = string_bytes(pa.array(some, pa.string()))
    ids, ends = code.encode(data, offsets)
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]


@settings(max_examples=150, deadline=None)
@given(st.lists(texts, min_size=1, max_size=5))
def test_pieces_give_the_librarys_ids(some):
    code = encoder(JSON)
    assert encoded(code, some) == [code.library.encode(x, add_special_tokens=False).ids for x in some]


@settings(max_examples=150, deadline=None)
@given(st.lists(texts, min_size=1, max_size=5))
def test_ranks_give_the_rank_librarys_ids(some):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    global _own
    _own = globals().get("_own") or tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert encoded(encoder(RANKS), some) == [_own.encode_ordinary(x) for x in some]


def pair(n):
    """Two words of 2 ** n letters whose polynomial hashes modulo a power of two agree."""
    one = "a"
    for _ in range(n):
        one += one.translate(str.maketrans("ab", "ba"))
    return one, one.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("path", [JSON, RANKS])
def test_words_that_polynomial_hashes_confuse(spark, path, rank_library):
    some = [*pair(10), *pair(11), *pair(7), *pair(3)]
    code = PieceEncoder(path)
    want = [code.library.encode(x, add_special_tokens=False).ids if path == JSON else rank_library.encode_ordinary(x) for x in some]
    assert encoded(code, some) == want
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    if path == JSON:
        files = token_output.write_tokens(docs, JSON)
        assert [r.ids for r in token_output.read_documents(spark, files).orderBy("key").collect()] == [[*x, 0] for x in want]
        assert [r.n_tokens for r in token_counts.token_counts(docs, JSON).orderBy("doc_id").collect()] == [len(x) for x in want]


def test_pieces_that_share_a_hash_are_told_apart(monkeypatch):
    code = PieceEncoder(JSON)
    monkeypatch.setattr(code, "hash", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    some = ["one two six ten", "the cat and dog", "x" * 300 + " " + "y" * 300, "z" * 300, "one two six ten"]
    for _ in range(2):
        assert encoded(code, some) == [code.library.encode(x, add_special_tokens=False).ids for x in some]


@settings(max_examples=60, deadline=None)
@given(texts, st.integers(9, 60))
def test_windows_of_a_long_text_give_its_ids(text, window):
    for path in (JSON, RANKS):
        code, whole = encoder(path), text * 3
        parts = [*code.parts(np.frombuffer(whole.encode(), np.uint8), window)]
        assert [i for p in parts for i in p.tolist()] == encoded(code, [whole])[0]


def test_texts_longer_than_a_window(spark, rank_library):
    whole = ("Some words, it's <|endoftext|> 12 3  \n\n" * 28_000) + "x" * 3_000
    docs = spark.createDataFrame([(1, "before"), (2, whole), (3, "after")], "doc_id long, text string")
    ids = rank_library.encode_ordinary(whole)
    got = bpe_codec.digests(docs, RANKS).orderBy("doc_id").collect()[1]
    assert (got.n_tokens, got.ids_sha256, got.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(whole.encode()).hexdigest())
    want = encoder(JSON).library.encode(whole, add_special_tokens=False).ids
    assert [r.n_tokens for r in token_counts.token_counts(docs, JSON).orderBy("doc_id").collect()][1] == len(want)
    files = token_output.write_tokens(docs, JSON)
    assert token_output.read_documents(spark, files, [2]).first().ids == [*want, 0]
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    part = docs.selectExpr("doc_id", "substring(text, 1, 30000) as text")
    assert [r.n_tokens for r in token_counts.token_counts(part, MODEL, chunk=3000, overlap=50).orderBy("doc_id").collect()][1] == len(model.encode(whole[:30_000]))


def test_helper_names_dont_touch_the_callers_columns(spark):
    docs = spark.createDataFrame([(1, "one two", "kept")], "doc_id long, text string, text_to_encode string")
    assert bpe_codec.encode(docs, RANKS).first().text_to_encode == "kept"


def test_memory_starts_again(monkeypatch):
    code = PieceEncoder(JSON, memory=20)
    some = [f"word{i} and more{i * 7}" for i in range(60)]
    for x in some:
        assert encoded(code, [x]) == [code.library.encode(x, add_special_tokens=False).ids]


@settings(max_examples=60, deadline=None)
@given(texts, st.integers(12, 40), st.integers(2, 9))
def test_spliced_counts_are_the_whole_texts(text, chunk, overlap):
    code = encoder(JSON)
    text = text.replace("<|endoftext|>", "") * 3
    assert token_counts.spliced(text.encode(), token_counts.piece_cuts(code), 8, chunk, overlap) == len(code.library.encode(text, add_special_tokens=False).ids)


def test_a_run_without_boundaries_widens_to_the_end():
    code = encoder(JSON)
    text = "x" * 3000
    assert token_counts.spliced(text.encode(), token_counts.piece_cuts(code), 8, 64, 4) == len(code.library.encode(text, add_special_tokens=False).ids)


def test_token_counts(odd, none):
    library = encoder(JSON).library
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(odd, JSON, chunk=5000, overlap=64).collect())
    want = []
    for i, text, *_ in ROWS:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((i is None, i or 0, len((text or "").encode()), n, n > 1024))
    assert got == sorted(want)
    assert token_counts.token_counts(none, JSON).count() == 0


def test_sentencepiece_counts(odd):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = sorted(r.n_tokens for r in token_counts.token_counts(odd, MODEL).collect())
    assert got == sorted(len(model.encode(text or "")) for _, text, *_ in ROWS)


def test_token_files(spark, odd, none):
    files = token_output.write_tokens(odd, JSON)
    library = encoder(JSON).library
    got = token_output.summaries(spark, files).collect()
    rows = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, want = 0, []
    for i, text, *_ in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    some = {r.key: r.ids for r in token_output.read_documents(spark, files, [7, 3, 99]).collect()}
    assert some == {3: [0], 7: [*library.encode(ROWS[8][1], add_special_tokens=False).ids, 0]}
    assert token_output.read_documents(spark, files, []).count() == 0
    assert token_output.read_documents(spark, files).count() == len(ROWS)
    empty = token_output.write_tokens(none, JSON)
    assert token_output.summaries(spark, empty).count() == 0


def test_dictionary_is_shared_and_checked(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "concat('common words of all documents, number ', id) as text")
    files = token_output.write_tokens(docs, JSON)
    blocks = files.blocks(spark)
    assert {r.dictionary for r in blocks.select("dictionary").distinct().collect()} == {hashlib.sha256(files.dictionary(spark)).hexdigest()[:16]}
    assert len(files.dictionary(spark)) > 0
    assert token_output.summaries(spark, files).count() == 400


def test_digests_equal_the_rank_library(odd, none, rank_library):
    got = sorted(tuple(r[1:]) for r in bpe_codec.digests(odd, RANKS).collect())
    want = []
    for _, text, *_ in ROWS:
        ids = rank_library.encode_ordinary(text or "")
        want.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe_codec.digests(none, RANKS).count() == 0


def test_encode_and_decode_round_trip(odd, none):
    both = bpe_codec.decode(bpe_codec.encode(odd, RANKS, offsets=True), RANKS)
    for r in both.collect():
        assert r.decoded == (r.text or "") and bytes(r.decoded_bytes) == r.decoded.encode()
        assert len(r.ids) == len(r.starts) == len(r.ends)
        if r.ids:
            assert r.starts[0] == 0 and r.ends[-1] == len(r.text)
    assert {"key", "size", "slots"} <= set(both.columns)
    assert bpe_codec.encode(none, RANKS).count() == 0


def test_ids_that_dont_give_the_text_are_an_error(odd):
    assert sorted(map(str, bpe_codec.encode(odd, RANKS, check=True).collect())) == sorted(map(str, bpe_codec.encode(odd, RANKS).collect()))
    ids = np.array(encoded(encoder(RANKS), ["some words"])[0])
    bpe_codec.held_against(bpe_codec.byte_table(RANKS), ids, np.frombuffer(b"some words", np.uint8))
    with pytest.raises(ValueError):
        bpe_codec.held_against(bpe_codec.byte_table(RANKS), ids, np.frombuffer(b"some word", np.uint8))


def test_split_characters(spark):
    ids = np.array(encoded(encoder(RANKS), ["a😀b"])[0])
    starts, ends = bpe_codec.token_offsets(ids, RANKS)
    assert starts[0] == 0 and ends[-1] == 3 and all(a < b or a == b for a, b in zip(starts, ends, strict=True))
    table = bpe_codec.byte_table(RANKS)
    one = next(i for i in range(len(table.counts)) if table.decode(np.array([i])).tobytes() == b"\xf0")
    got = bpe_codec.decode(spark.createDataFrame([([one],), (None,), ([],)], "ids array<int>"), RANKS).collect()
    assert [r.decoded for r in got] == ["�", "", ""] and bytes(got[0].decoded_bytes) == b"\xf0"
