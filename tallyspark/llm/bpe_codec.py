"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._pieces import byte_characters, encoder
from ._shared import CHUNK_BYTES, fresh, gathered, kept, spans, string_bytes, tidy, whole_text


#: Bytes of texts that ``encode`` takes together: its tasks hold the batch that they came in besides.
ENCODED = 1 << 17


class ByteTable:
    """Bytes of each id, from a vocabulary whose characters stand for bytes; added tokens stand for their own text."""

    def __init__(self, path: str) -> None:
        library = encoder(path).library
        value = {c: b for b, c in enumerate(byte_characters())}
        special = {i: t.content for i, t in library.get_added_tokens_decoder().items()}
        words = {i: w for w, i in library.get_vocab(with_added_tokens=True).items()}
        rows = [b""] * (max(words) + 1)
        for i, word in words.items():
            rows[i] = special[i].encode() if i in special else bytes(value[c] for c in word)
        self.counts = np.array([len(r) for r in rows], np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.flat = np.frombuffer(b"".join(rows), np.uint8)
        digits = [b"%d," % i for i in range(len(rows))]
        self.digit_counts = np.array([len(r) for r in digits], np.int64)
        self.digit_starts = np.cumsum(self.digit_counts) - self.digit_counts
        self.digits = np.frombuffer(b"".join(digits), np.uint8)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids; a character that ids split over several tokens is whole again once its bytes stand together."""
        return gathered(self.flat, self.starts[ids], self.counts[ids])


_tables: dict[str, ByteTable] = {}
kept.append(_tables)


def byte_table(path: str) -> ByteTable:
    if path not in _tables:
        _tables[path] = ByteTable(path)
    return _tables[path]


def token_offsets(ids: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) in characters of each id of one text.

    A token that begins inside a character starts at that character, and one that ends inside a
    character ends behind it, so neighbours that split a character both cover it.
    """
    table = byte_table(path)
    data, ends = table.decode(ids), np.cumsum(table.counts[ids])
    leads = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    starts = ends - table.counts[ids]
    inside = np.append((data & 0xC0) == 0x80, False)
    return leads[starts] - inside[starts], leads[ends]


def held_against(table: ByteTable, ids: np.ndarray, data: np.ndarray) -> None:
    """An error if ``ids`` don't decode to ``data``."""
    if not np.array_equal(table.decode(ids), data):
        raise ValueError("ids don't decode to their text")


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", offsets: bool = False, check: bool = False, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``ids`` (array<int>) of the whole text and, if asked for, ``starts`` and ``ends`` of each id in characters; unless ``keep_text``, without the text, which then goes to the task once and not back.

    With ``check`` the task decodes all ids again and holds them against their texts: a difference ends the job.
    A null or empty text has no ids. Repeated rows are encoded alike; columns of the same names are replaced, all
    others stay. Texts of any length go through in windows; an empty table stays empty.
    """
    made = [ids, *(["starts", "ends"] if offsets else [])]
    others = [c for c in docs.columns if c not in made and (keep_text or c != text)]
    codec = fresh([*docs.columns, *made], "text_to_encode")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*others).schema)
    base = docs.select(*others, whole_text(text).alias(codec))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in batches:
            data, bounds = string_bytes(batch.column(batch.num_columns - 1))
            rest = batch.select(batch.schema.names[:-1])
            for a, b in spans(bounds, ENCODED):
                found, ends = code.encode(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
                if check:
                    held_against(byte_table(path), found, data[bounds[a] : bounds[b]])
                columns = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found, pa.int32()))]
                if offsets:
                    each = [token_offsets(found[s:e], path) for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                    columns += [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([x[k] for x in each]) if each else [], pa.int32())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*rest.slice(a, b - a).columns, *columns], names=[*rest.schema.names, *made])

    return base.mapInArrow(tidy(rows, keep=True), ", ".join([*([schema] if schema else []), *(f"`{c}` array<int>" for c in made)]))


def decode(frame: DataFrame, path: str, ids: str = "ids", text: str = "decoded", raw: str = "decoded_bytes") -> DataFrame:
    """``frame`` with the bytes that ``ids`` stand for, and their text.

    Ids may begin or end inside a character, as in a part of a longer sequence: the bytes are exact, and the
    text shows each broken character as U+FFFD. Null or empty ids give empty bytes and text. Repeated rows are
    decoded alike; columns of the same names are replaced, all others stay. An empty table stays empty.
    """
    base = frame.drop(text, raw)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(path)
        for batch in batches:
            column = batch.column(ids)
            found = [table.decode(np.asarray(x.values, np.int64)).tobytes() if x.is_valid and len(x.values) else b"" for x in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in found], pa.string())], names=[*batch.schema.names, raw, text])

    return base.mapInArrow(tidy(rows, keep=True), f"{schema}, `{raw}` binary, `{text}` string")


def _hashed(ids: Iterator[np.ndarray], table: ByteTable) -> tuple[int, str, str]:
    """(number of ids, sha256 of the decimal ids joined by commas, sha256 of the decoded bytes) of one text's ids, a part at a time."""
    count, shown, back, gap = 0, hashlib.sha256(), hashlib.sha256(), b""
    for some in ids:
        if len(some):
            count += len(some)
            shown.update(gap)
            shown.update(gathered(table.digits, table.digit_starts[some], table.digit_counts[some])[:-1])
            back.update(table.decode(some))
            gap = b","
    return count, shown.hexdigest(), back.hexdigest()


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encodes every whole text, decodes the ids again and hashes both.

    Null texts count as empty: no ids, and the hashes of nothing. Rows with equal or null keys are kept as they are,
    and other columns play no part, whatever their names; an empty table gives no rows. Texts, ids and decoded bytes
    stay inside the task, a few MB at a time, of longer texts too.
    """
    base = docs.select(F.col(key), whole_text(text).alias(fresh([key], "text")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, table = encoder(path), byte_table(path)
        for batch in batches:
            data, bounds = string_bytes(batch.column(1))
            counts, shown, back = [], [], []
            for a, b in spans(bounds):
                if bounds[b] - bounds[a] > CHUNK_BYTES:  # one long text
                    n, one, two = _hashed(code.parts(data[bounds[a] : bounds[b]]), table)
                    counts.append(np.array([n]))
                    shown.append(one)
                    back.append(two)
                    continue
                ids, ends = code.encode(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
                counts.append(np.diff(ends))
                for bytes_of, widths, out, cut in ((gathered(table.digits, table.digit_starts[ids], table.digit_counts[ids]), table.digit_counts, shown, 1), (table.decode(ids), table.counts, back, 0)):
                    at = np.append(0, np.cumsum(widths[ids]))[ends]
                    view = memoryview(np.ascontiguousarray(bytes_of))
                    out += [hashlib.sha256(view[s : max(s, e - cut)]).hexdigest() for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(counts) if counts else [], pa.int64()), pa.array(shown, pa.string()), pa.array(back, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return base.mapInArrow(tidy(rows, keep=True), f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
