"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import CHUNK_BYTES, fresh, spans, string_bytes, tidy, whole_text

#: n-grams of 1 to this many characters, hashed to 2 ** BITS counters.
ORDERS, BITS = 3, 15
#: The model is fitted on about this many documents of each language, drawn by a hash of the id.
SAMPLE_DOCS = 3000
SMOOTHING = 0.5
UNDETERMINED = "und"


class Grams:
    """Hashes of all n-grams of consecutive texts. Letters count in lower case, everything else as a space."""

    def __init__(self) -> None:
        self.plain = np.zeros(0x110000, np.uint32)

    def letters(self, data: np.ndarray) -> np.ndarray:
        codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        found = self.plain[codes]
        if not found.all():
            for c in np.unique(codes[found == 0]).tolist():
                low = chr(c).lower()[:1]
                self.plain[c] = ord(low) if low.isalpha() else 0x20
            found = self.plain[codes]
        return found

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(each text's first character, the last one's end; for each order the hash of the n-gram at each character).

        An n-gram that would leave its text has hash 2 ** BITS.
        """
        codes = self.letters(data)
        ends = np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), offsets)
        out = []
        for n in range(1, ORDERS + 1):
            key = np.full(len(codes), (n * 0x9E3779B9) & 0xFFFFFFFF, np.uint32)
            for k in range(n):
                key[: len(codes) - k] = (key[: len(codes) - k] ^ codes[k:]) * np.uint32(0x85EBCA6B)
                key ^= key >> np.uint32(13)
            gram = (key * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS)).astype(np.int32)
            for k in range(1, n):  # the last n - 1 characters of each text begin no n-gram
                late = ends[1:] - k
                gram[late[late >= ends[:-1]]] = 1 << BITS
            out.append(gram)
        return ends, out

    def windows(self, data: np.ndarray, window: int = CHUNK_BYTES) -> Iterator[list[np.ndarray]]:
        """The hashes of one text a window at a time: of the n-grams that begin in it, the first characters of the next one read along."""
        lead, at = lambda i: i >= len(data) or data[i] & 0xC0 != 0x80, 0
        while at < len(data):
            end = min(at + window, len(data))
            while not lead(end):
                end += 1
            behind = end
            for _ in range(ORDERS - 1):
                behind = min(behind + 1, len(data))
                while not lead(behind):
                    behind += 1
            _, found = self(data[at:behind], np.array([0, behind - at]))
            n = int(((data[at:end] & 0xC0) != 0x80).sum())
            yield [gram[:n] for gram in found]
            at = end


@dataclass(frozen=True)
class LanguageModel:
    """Log probability of each n-gram for each language; the matrix has languages x (2 ** BITS + 1) cells, the last column 0."""

    languages: tuple[str, ...]
    prior: np.ndarray
    log_p: np.ndarray


def fit(docs: DataFrame, keep: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE_DOCS) -> LanguageModel:
    """Learns from rows where ``keep`` holds and text and lang are not null.

    About ``sample`` documents of each language are drawn by a hash of key and text, so rare languages are taken
    whole; their n-grams are counted by Spark, and the driver gets a number for each language and counter. Empty
    texts add to a language's share only; repeated rows are drawn together and count as often as they come; rows
    without a key and those that share one are drawn apart by their texts. Other columns play no part, whatever their names. Nothing to learn from makes a model
    without languages.
    """
    rows = docs.where(keep & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), whole_text(text).alias("text"), F.pmod(F.xxhash64(F.col(key).cast("string"), F.col(text).cast("string"), F.lit("language")), F.lit(1 << 30)).alias("draw"))
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return LanguageModel((), np.zeros(0), np.zeros((0, (1 << BITS) + 1)))
    bound = F.create_map(*[F.lit(x) for name in languages for x in (name, int(min(1.0, sample / sizes[name]) * (1 << 30)))])
    drawn = rows.where(F.col("draw") < bound[F.col("lang")]).select("lang", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, total = Grams(), {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), dtype=object)
            data, bounds = string_bytes(batch.column(1))
            for a, b in spans(bounds):
                if bounds[b] - bounds[a] > CHUNK_BYTES:  # one long text
                    for found in grams.windows(data[bounds[a] : bounds[b]]):
                        total[names[a]] = total.get(names[a], 0) + sum(np.bincount(gram, minlength=(1 << BITS) + 1) for gram in found)
                    continue
                ends, found = grams(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
                for name in set(names[a:b]):
                    mine = np.repeat(names[a:b] == name, np.diff(ends))
                    for gram in found:
                        total[name] = total.get(name, 0) + np.bincount(gram[mine], minlength=(1 << BITS) + 1)
        for name, n in total.items():
            at = np.flatnonzero(n[: 1 << BITS])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "gram", "n"])

    counts = drawn.mapInArrow(tidy(counted), "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((len(languages), 1 << BITS), SMOOTHING)
    place = {name: i for i, name in enumerate(languages)}
    at = np.array([place[x] for x in counts.column("lang").to_pylist()], np.int64)
    table[at, np.asarray(counts.column("gram"))] += np.asarray(counts.column("n"))
    log_p = np.zeros((len(languages), (1 << BITS) + 1))
    log_p[:, :-1] = np.log(table) - np.log(table.sum(1, keepdims=True))
    size = np.array([sizes[x] for x in languages], float)
    return LanguageModel(languages, np.log(size / size.sum()), log_p)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the probability of that language under the model.

    A null text, or one without a letter, is undetermined with score 0; so is every text if nothing could be
    learned. Ties go to the language first in code point order. Columns of the same names are replaced, others stay,
    whatever their names. Repeated rows are told alike, long texts go through in windows, and an empty table stays
    empty.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    # a text goes to the task once; where it isn't a string column, as a string
    plain = text in kept and docs.schema[text].dataType.simpleString() == "string"
    copy = [] if plain else [whole_text(text).alias(fresh(docs.columns, "text_to_tell"))]
    base = docs.select(*kept, *copy, F.coalesce(F.col(text).cast("string").rlike(r"\p{L}"), F.lit(False)).alias(fresh(docs.columns, "lettered")))
    place = kept.index(text) if plain else len(kept)
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "lang_pred string, score double"])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a bounded matrix

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, known = Grams(), shared.value
        names = np.array([*known.languages, UNDETERMINED], dtype=object)
        for batch in batches:
            data, bounds = string_bytes(batch.column(place))
            best, score = np.full(batch.num_rows, len(names) - 1), np.zeros(batch.num_rows)
            for a, b in spans(bounds) if known.languages else ():
                log_p = np.empty((len(known.languages), b - a))
                if bounds[b] - bounds[a] > CHUNK_BYTES:  # one long text
                    log_p[:, 0] = known.prior
                    for found in grams.windows(data[bounds[a] : bounds[b]]):
                        log_p[:, 0] += [sum(one[gram].sum() for gram in found) for one in known.log_p]
                else:
                    ends, found = grams(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
                    for i, one in enumerate(known.log_p):
                        sums = np.zeros(len(found[0]) + 1)
                        np.cumsum(sum(one[gram] for gram in found), out=sums[1:])
                        log_p[i] = np.diff(sums[ends]) + known.prior[i]
                best[a:b] = log_p.argmax(0)
                score[a:b] = 1 / np.exp(log_p - log_p.max(0)).sum(0)
            mute = ~np.asarray(batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False), bool)
            best[mute], score[mute] = len(names) - 1, 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(names[best], pa.string()), pa.array(score)], names=[*kept, "lang_pred", "score"])

    return base.mapInArrow(tidy(rows), schema)
