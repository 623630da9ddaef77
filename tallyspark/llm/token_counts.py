"""Exact token counts of whole texts; huge texts in overlapping chunks that are spliced where both agree."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._pieces import GUARD, PieceEncoder, encoder
from ._shared import fresh, spans, string_bytes, tidy, whole_text

#: Bytes of a chunk, and of the overlap that is tried first.
CHUNK, OVERLAP = 1 << 16, 1 << 10

#: A chunk's places in bytes where a cut is stable, and the tokens of its first so many bytes.
Cuts = tuple[np.ndarray, Callable[[int], int]]


def spliced(data: bytes, cuts: Callable[[bytes], Cuts], guard: int, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``data``, from chunks that overlap.

    ``cuts`` gives the places of a chunk from which on the tokens depend on what follows alone. A place in
    the overlap that both chunks name, and that lies ``guard`` bytes before the first chunk's end (so that
    the missing rest can't have moved it), is a boundary of the whole text too: the first chunk counts up
    to it, the next from it on. Without such a place the overlap grows fourfold, up to all that is left.
    """
    total, begin, size = 0, 0, len(data)
    while True:
        end, wider = min(size, begin + chunk), overlap
        while True:
            end = _boundary(data, min(size, max(end, begin + 2 * wider)))
            places, tokens = cuts(data[begin:end])
            if end == size:
                return total + tokens(end - begin)
            start = _boundary(data, end - wider)
            following, _ = cuts(data[start : _boundary(data, min(size, end + guard))])
            common = np.intersect1d(places[(places > start - begin) & (places <= end - begin - guard)] + begin, following[following > 0] + start)
            if len(common):
                cut = int(common[0])
                total += tokens(cut - begin)
                begin = cut
                break
            wider *= 4


def _boundary(data: bytes, at: int) -> int:
    """``at``, moved back to the start of a character."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def piece_cuts(code: PieceEncoder) -> Callable[[bytes], Cuts]:
    """Cuts at piece starts: the split pattern looks back at nothing, so it goes on alike from any common piece start."""

    def cuts(chunk: bytes) -> Cuts:
        data = np.frombuffer(chunk, np.uint8)
        places, counts, _ = code.piece_counts(data, np.array([0, len(data)]))
        ends = np.append(0, np.cumsum(counts))
        return places, lambda n: int(ends[np.searchsorted(places, n)])

    return cuts


#: A single space between ASCII letters and digits, which normalising leaves alone.
_GAP = re.compile(rb"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


def word_cuts(model) -> Callable[[bytes], Cuts]:
    """Cuts behind single spaces, for a sentencepiece model whose pieces hold the word mark in front only: no piece spans such a space, and a chunk gets a mark in front as a word does."""

    def cuts(chunk: bytes) -> Cuts:
        gap = lambda n: n - 1 if n < len(chunk) else n
        return np.array([m.end() for m in _GAP.finditer(chunk)], np.int64), lambda n: len(model.encode(chunk[: gap(n)].decode("utf-8"), num_threads=1))

    return cuts


def _words_apart(model) -> bool:
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    one = lambda text: model.encode(text, out_type=str)
    return all("\u2581" not in p.lstrip("\u2581") for p in pieces) and one("b")[0].startswith("\u2581") and one("a b") == one("a") + one("b")


class Counter:
    """Token counts by the library that the vocabulary file is for: tokenizers for .json and .tiktoken, sentencepiece for .model."""

    def __init__(self, path: str, chunk: int, overlap: int) -> None:
        self.chunk, self.overlap = chunk, overlap
        if path.endswith(".model"):
            import sentencepiece

            self.model, self.code = sentencepiece.SentencePieceProcessor(model_file=path), None
            self.apart = _words_apart(self.model)
        else:
            self.code = encoder(path)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Counts of the texts data[offsets[i] : offsets[i + 1]]."""
        out = np.zeros(len(offsets) - 1, np.int64)
        long = np.diff(offsets) > self.chunk
        for a, b in _stretches(long):
            part = offsets[a : b + 1]
            one = data[part[0] : part[-1]]
            if long[a] and (self.apart if self.code is None else self.code.by_piece):
                out[a] = self._spliced(one.tobytes())
            elif self.code is None:
                texts = [one[s:e].tobytes().decode("utf-8") for s, e in zip((part[:-1] - part[0]).tolist(), (part[1:] - part[0]).tolist(), strict=True)]
                out[a:b] = [len(x) for x in self.model.encode(texts, num_threads=1)]
            else:
                for c, d in spans(part):
                    _, ends = self.code.encode(data[part[c] : part[d]], part[c : d + 1] - part[c])
                    out[a + c : a + d] = np.diff(ends)
        return out

    def _spliced(self, text: bytes) -> int:
        """Added tokens count one each; what stands between them is spliced."""
        if self.code is None:
            return spliced(text, word_cuts(self.model), 1, self.chunk, self.overlap)
        cuts = piece_cuts(self.code)
        return sum(1 if token is not None else spliced(text[a:b], cuts, GUARD, self.chunk, self.overlap) for a, b, token in self.code.stretches(text))


def _stretches(long: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges: each long row alone, the others together."""
    at = 0
    for row in [*np.flatnonzero(long).tolist(), len(long)]:
        if row > at:
            yield at, row
        if row < len(long):
            yield row, row + 1
        at = row + 1


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row's whole text.

    Counts are the library's own, without begin, end or added tokens; an added token's text inside a text
    counts as one token, as is the library's default. Null texts count as empty: 0 bytes, 0 tokens. Rows with
    equal or null keys are kept, each for itself; other columns play no part, whatever their names. Texts longer
    than ``chunk`` bytes go in overlapping chunks, but whole where the vocabulary's pieces can span any place
    (neither a byte-level nor a word-marked one). An empty table gives no rows.
    """
    base = docs.select(F.col(key), whole_text(text).alias(fresh([key], "text")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(path, chunk, overlap)
        for batch in batches:
            data, bounds = string_bytes(batch.column(1))
            found = [count(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]) for a, b in spans(bounds)]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(np.diff(bounds), pa.int64()), pa.array(np.concatenate(found) if found else [], pa.int64())], names=[key, "n_bytes", "n_tokens"])

    return base.mapInArrow(tidy(rows, keep=True), f"`{key}` {docs.schema[key].dataType.simpleString()}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
