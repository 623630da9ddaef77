"""Document quality: a linear-chain conditional random field labels every line good or bad.

A line's features are its own and its neighbours'. Documents are labelled, lines aren't: training starts from
what a line's own features say about its document's label, without the chain, then alternates. Given the model, each document's lines get the marginals nearest to
the model's whose length-weighted mean fits the label; given those, the weights are fitted. So good lines of a bad
document and bad lines of a good one need not follow its label. Scoring runs forward-backward over a document's
lines and averages the marginals weighted by line length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import CHUNK_BYTES, SpanHash, crc_of_id, fresh, mixed, spans, string_bytes, tidy, whole_text

#: The model is fitted on at most this many labelled documents, drawn by a hash of the id, and of each on at most so many lines in a row at a drawn place: 102 MB of features.
SAMPLE_DOCS, SAMPLE_LINES = 5000, 100
#: Rounds of labelling lines, and steps of fitting in each.
ROUNDS, STEPS, RATE, PENALTY = 2, 110, 0.08, 1e-3
#: A good document's lines come to at least this mean, a bad one's to at most one less this.
SURE = 0.9
THRESHOLD = 0.3
#: A longer line counts as lines of this many bytes.
LINE_BYTES = 1 << 16

#: Byte classes of a line. Bytes of 128 and more are parts of letters.
LOWER, UPPER, DIGIT, BLANK, STOP, SYMBOL, HIGH = range(7)


def _classes() -> np.ndarray:
    kind = np.full(256, SYMBOL, np.uint8)
    for name, characters in ((LOWER, b"abcdefghijklmnopqrstuvwxyz"), (UPPER, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (DIGIT, b"0123456789"), (BLANK, b" \t\r\n\x0b\x0c"), (STOP, b".,;:'\"()-?")):
        kind[list(characters)] = name
    kind[128:] = HIGH
    return kind


KINDS = _classes()
OWN = 17


def own_features(data: np.ndarray, offsets: np.ndarray, hash_of: SpanHash) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(each line's own features, line lengths in bytes, each text's first line, hash of each line in its text).

    Lines end at line feeds; a text has one line more than line feeds, so an empty text has one empty line. What
    depends on all lines of a text, REPEATS and LINES, is filled in by ``in_text``.
    """
    # a line feed behind each text, so that no line spans two
    rows = len(offsets) - 1
    buffer = np.full(len(data) + rows, 10, np.uint8)
    buffer[np.arange(len(data)) + np.repeat(np.arange(rows), np.diff(offsets))] = data
    ends = np.flatnonzero(buffer == 10)
    starts = np.append(0, ends[:-1] + 1)
    long = np.flatnonzero(ends - starts > LINE_BYTES)
    extra = np.concatenate([np.zeros(0, np.int64), *[np.arange(starts[i] + LINE_BYTES, ends[i], LINE_BYTES) for i in long]])
    if len(extra):
        starts, ends = np.sort(np.concatenate([starts, extra])), np.sort(np.concatenate([ends, extra]))
    first = np.searchsorted(starts, offsets + np.arange(rows + 1))
    n, size = len(starts), (ends - starts).astype(np.float64)
    doc = np.repeat(np.arange(rows), np.diff(first))
    kind = KINDS[buffer]

    def share(flags: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(flags, dtype=np.int64))
        return (total[ends] - total[starts]) / np.maximum(size, 1)

    of = [share(kind == k) for k in range(7)]
    again = np.append(False, (buffer[1:] == buffer[:-1]) & (kind[1:] >= STOP) & (kind[1:] < HIGH))
    again[extra] = False
    # words
    blank = kind == BLANK
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
    apart = extra[~blank[extra] & ~blank[extra - 1]]
    begin, end = np.sort(np.concatenate([edge[::2], apart])), np.sort(np.concatenate([edge[1::2], apart]))
    line = np.searchsorted(ends, begin, "right")
    words = np.bincount(line, minlength=n).astype(np.float64)
    distinct = top = np.zeros(n)
    closed = np.zeros(n)
    if len(begin):
        hashes = hash_of(buffer, begin, end)
        keyed = np.sort((line.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
        new = np.flatnonzero(np.append(True, keyed[1:] != keyed[:-1]))
        which, count = (keyed[new] >> np.uint64(40)).astype(np.int64), np.diff(np.append(new, len(keyed)))
        distinct = np.bincount(which, minlength=n).astype(np.float64)
        top = np.zeros(n)
        np.maximum.at(top, which, count)
        closed = np.bincount(line, kind[end - 1] == SYMBOL, minlength=n) / np.maximum(words, 1)
    keyed = mixed(hash_of(buffer, starts, ends) ^ mixed(doc.astype(np.uint64) + np.uint64(1)))
    letters = of[LOWER] + of[UPPER] + of[HIGH]
    last = kind[np.maximum(ends - 1, 0)]
    own = np.column_stack([
        np.log1p(size) / 6, letters, of[UPPER] / np.maximum(letters, 1e-9), of[DIGIT], of[BLANK], of[STOP], of[SYMBOL], of[HIGH],
        share(again), np.minimum(size / np.maximum(words, 1), 40) / 10, distinct / np.maximum(words, 1), top / np.maximum(words, 1), closed,
        np.zeros(n), (size > 0) & (last == STOP), np.log1p(words) / 5, np.zeros(n),
    ])
    return own, size, first, keyed


#: Columns of a line's own features that depend on its whole text: how often the text repeats the line, and its lines.
REPEATS, LINES = 13, 16


def in_text(own: np.ndarray, size: np.ndarray, first: np.ndarray, keyed: np.ndarray) -> np.ndarray:
    """``own`` with what depends on all lines of each text."""
    _, back, count = np.unique(keyed, return_inverse=True, return_counts=True)
    own[:, REPEATS] = np.where(size > 0, np.log(count[back]), 0.0)
    lines = np.diff(first)
    own[:, LINES] = np.repeat(np.log1p(lines) / 5, lines)
    return own


def line_features(data: np.ndarray, offsets: np.ndarray, hash_of: SpanHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line with its neighbours' beside them, zeros beyond the text; line lengths in bytes; each text's first line)."""
    own, size, first, keyed = own_features(data, offsets, hash_of)
    in_text(own, size, first, keyed)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return np.column_stack([own, before, after]), size, first


def line_windows(data: np.ndarray, window: int = CHUNK_BYTES) -> Iterator[np.ndarray]:
    """Stretches of whole lines of one text, without the line feed that ends each."""
    at = 0
    while len(data) - at > window:
        feeds = np.flatnonzero(data[at : at + window] == 10)
        if len(feeds):
            yield data[at : at + feeds[-1]]
            at += int(feeds[-1]) + 1
        else:
            cut = max(window // LINE_BYTES, 1) * LINE_BYTES
            yield data[at : at + cut]
            at += cut + int(data[at + cut] == 10)
    yield data[at:]


@dataclass
class ChainModel:
    """Weights of a line's score for good, transitions and start scores (bad 0, good 1)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    moves: np.ndarray
    start: np.ndarray

    def lines(self, x: np.ndarray) -> np.ndarray:
        """Scores of lines with their neighbours' features beside them."""
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights + self.bias

    def long_text(self, data: np.ndarray, hash_of: SpanHash, window: int = CHUNK_BYTES) -> tuple[np.ndarray, np.ndarray]:
        """(scores of the lines of one text, their lengths), a stretch of lines at a time: a score is a sum of a line's own part and its neighbours'."""
        keys = [own_features(x, np.array([0, len(x)]), hash_of)[3] for x in line_windows(data, window)]
        known, count = np.unique(np.concatenate(keys), return_counts=True)
        total, parts, sizes = sum(map(len, keys)), [], []
        zero = np.zeros(OWN)
        part = lambda own, k: np.clip((own - self.mean[k * OWN : (k + 1) * OWN]) / self.scale[k * OWN : (k + 1) * OWN], -6, 6) @ self.weights[k * OWN : (k + 1) * OWN]
        for x in line_windows(data, window):
            own, size, _, keyed = own_features(x, np.array([0, len(x)]), hash_of)
            own[:, REPEATS] = np.where(size > 0, np.log(count[np.searchsorted(known, keyed)]), 0.0)
            own[:, LINES] = np.log1p(total) / 5
            parts.append([part(own, k) for k in range(3)])
            sizes.append(size)
        own, before, after = (np.concatenate([p[k] for p in parts]) for k in range(3))
        return own + np.append(part(zero, 1), before[:-1]) + np.append(after[1:], part(zero, 2)) + self.bias, np.concatenate(sizes)


def forward_backward(score: np.ndarray, first: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probability of good for each line, expected moves, expected starts) over all texts, which have a line at least.

    All texts take a step together, longest first, so that each step works on a leading part.
    """
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    heads, sizes = first[:-1][order], -length[order]
    emit = np.exp(np.clip(np.column_stack([-score / 2, score / 2]), -30, 30))
    step, begin = np.exp(moves), np.exp(start)
    steps = int(length.max(initial=0))
    active = [int(np.searchsorted(sizes, -t, "left")) for t in range(steps)]
    a, b = np.empty_like(emit), np.empty_like(emit)
    for t in range(steps):
        at = heads[: active[t]] + t
        now = (a[at - 1] @ step if t else begin) * emit[at]
        a[at] = now / now.sum(1, keepdims=True)
    for t in range(steps - 1, -1, -1):
        at = heads[: active[t]] + t
        now = np.ones((len(at), 2))
        if t + 1 < steps and (m := active[t + 1]):
            now[:m] = (emit[at[:m] + 1] * b[at[:m] + 1]) @ step.T
        b[at] = now / now.sum(1, keepdims=True)
    both = a * b
    good = both[:, 1] / both.sum(1)
    inner = np.ones(len(score), bool)
    inner[first[:-1]] = False
    to = np.flatnonzero(inner)
    pair = a[to - 1][:, :, None] * step * (emit[to] * b[to])[:, None, :]
    pair /= pair.sum((1, 2), keepdims=True)
    p = good[first[:-1]]
    return good, pair.sum(0), np.array([(1 - p).sum(), p.sum()])


def fitting(score: np.ndarray, first: np.ndarray, weight: np.ndarray, label: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like ``forward_backward``, of the nearest chain whose weighted mean is at least SURE in documents labelled 1 and at most 1 - SURE in the others.

    That chain adds a multiple of each line's weight to its score, one for each document, found by halving.
    """
    lines = np.diff(first)
    share = weight / np.repeat(np.add.reduceat(weight, first[:-1]), lines)
    scaled = share * np.repeat(lines, lines)
    mean = lambda tilt: np.add.reduceat(forward_backward(score + np.repeat(tilt, lines) * scaled, first, moves, start)[0] * share, first[:-1])
    free = mean(np.zeros(len(label)))
    aim = np.where(label > 0, SURE, 1 - SURE)
    free_of = np.where(label > 0, free >= aim, free <= aim)
    low, high = np.where(label > 0, 0.0, -60.0), np.where(label > 0, 60.0, 0.0)
    for _ in range(20):
        middle = (low + high) / 2
        over = mean(middle) > aim
        low, high = np.where(over, low, middle), np.where(over, middle, high)
    return forward_backward(score + np.repeat(np.where(free_of, 0.0, (low + high) / 2), lines) * scaled, first, moves, start)


def train(features: np.ndarray, first: np.ndarray, label: np.ndarray, rounds: int = ROUNDS) -> ChainModel:
    """Weights for documents labelled 0 or 1, by Adam on all texts at once with a quadratic penalty.

    The first round gives lines their document's label and fits each line by itself, on its own features alone, so that
    lines that good and bad documents share come out between; later rounds fit the whole chain to the labels that
    ``fitting`` then gives the lines.
    """
    weight = np.expm1(features[:, 0].astype(np.float64) * 6) + 1
    mean, scale = features.mean(0, dtype=np.float64), features.std(0, dtype=np.float64) + 1e-6
    x = np.clip((features - mean.astype(features.dtype)) / scale.astype(features.dtype), -6, 6)
    d = x.shape[1]
    theta = np.zeros(d + 7)
    parts = lambda: (x @ theta[:d].astype(x.dtype) + theta[d], theta[d + 1 : d + 5].reshape(2, 2), theta[d + 5 :])
    y = np.repeat(label, np.diff(first)).astype(float)
    moved, began = np.zeros((2, 2)), np.zeros(2)
    alone = np.zeros(d + 7)
    alone[[*range(min(OWN, d)), d]] = 1
    alone[[REPEATS, LINES]] = 0
    for turn in range(rounds + 1):
        if turn:
            score, moves, start = parts()
            y, moved, began = fitting(score, first, weight, label, moves, start)
        m, v = np.zeros(d + 7), np.zeros(d + 7)
        for t in range(1, STEPS + 1):
            score, moves, start = parts()
            if turn:
                good, pairs, starts = forward_backward(score, first, moves, start)
            else:
                good, pairs, starts = 1 / (1 + np.exp(-np.clip(score, -30, 30))), moved, began
            off = y - good
            slope = np.concatenate([x.T @ off.astype(x.dtype), [off.sum()], (moved - pairs).ravel(), began - starts]) / len(label) - PENALTY * theta
            slope = slope if turn else slope * alone
            m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
            theta += RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return ChainModel(mean, scale, theta[:d], float(theta[d]), theta[d + 1 : d + 5].reshape(2, 2), theta[d + 5 :])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE_DOCS, lines: int = SAMPLE_LINES) -> ChainModel | None:
    """Learns from labelled documents that aren't held out; None if none are left.

    At most ``sample`` documents are drawn from the labels by a hash of the key, so only their texts are read out,
    and of each at most ``lines`` lines in a row at a place that the hash says; features are made by Spark, and the
    driver gets numbers of no more than that. Null texts are empty ones; rows without a key or label don't count;
    repeated rows and labels count as often as they meet, but no more than ``sample`` of them in all. Other columns play no part, whatever their names.
    """
    draw = F.xxhash64(F.col(key).cast("string"), F.lit("quality"))
    drawn = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"), draw.alias("draw")).orderBy("draw", "key", "label").limit(sample)
    some = docs.select(F.col(key).alias("key"), whole_text(text).alias("text")).join(F.broadcast(drawn), "key").select("label", "draw", "text")  # at most `sample` rows

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_of = SpanHash()
        for batch in batches:
            draws = batch.column(1).to_pylist()
            data, bounds = string_bytes(batch.column(2))
            for a, b in spans(bounds):
                x, _, first = line_features(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], hash_of)
                out = []
                for draw, s, e in zip(draws[a:b], first[:-1].tolist(), first[1:].tolist(), strict=True):
                    at = s + draw % max(e - s - lines + 1, 1)
                    out.append(x[at : min(at + lines, e)].astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(out, pa.binary())], names=["label", "draw", "lines"])

    rows = some.mapInArrow(tidy(featured), "label int, draw long, lines binary").orderBy("draw", "label", "lines").limit(sample).toArrow()
    found = [np.frombuffer(x, np.float32).reshape(-1, 3 * OWN) for x in rows.column("lines").to_pylist()]
    if not found:
        return None
    order = sorted(range(len(found)), key=lambda i: (len(found[i]), found[i].tobytes()))
    label_of = np.asarray(rows.column("label"))[order]
    return train(np.concatenate([found[i] for i in order]), np.append(0, np.cumsum([len(found[i]) for i in order])), (label_of > 0).astype(int))


def held_out(key: str = "doc_id"):
    return F.pmod(crc_of_id(key), F.lit(5)) == 0


def score(docs: DataFrame, model: ChainModel | None, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, held_out, score, predicted) of every row's whole text.

    The score is the mean over lines of the probability of good, weighted by bytes plus one. Null texts count as
    empty and have one empty line. Rows with equal or null keys are kept, equal texts score alike, and long texts go
    through in windows. Other columns play no part, whatever their names; an empty table gives no rows. Without a
    model every score is 0.5.
    """
    base = docs.select(F.col(key), held_out(key).alias(fresh([key], "held_out")), whole_text(text).alias(fresh([key], "text")))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_of, chain = SpanHash(), shared.value
        for batch in batches:
            data, bounds = string_bytes(batch.column(2))
            out = np.full(batch.num_rows, 0.5)
            for a, b in spans(bounds) if chain else ():
                if bounds[b] - bounds[a] > CHUNK_BYTES:  # one long text
                    line, size = chain.long_text(data[bounds[a] : bounds[b]], hash_of)
                    first = np.array([0, len(line)])
                else:
                    x, size, first = line_features(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], hash_of)
                    line = chain.lines(x)
                good, _, _ = forward_backward(line, first, chain.moves, chain.start)
                out[a:b] = np.add.reduceat(good * (size + 1), first[:-1]) / np.add.reduceat(size + 1, first[:-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.clip(out, 0, 1))], names=[key, "held_out", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return base.mapInArrow(tidy(rows), f"`{key}` {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
