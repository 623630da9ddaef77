"""Byte-level BPE over many texts: the tokenizers library merges each distinct piece once, numpy puts the texts together.

A byte-level BPE cuts text into pieces by its pattern and merges within a piece only, so the ids of a
text are its pieces' ids in a row. Word-like pieces repeat a lot, so each worker remembers the ids of
the pieces it has met (up to a bound, then it starts again) and asks the library for new ones only.
Characters are classed by asking the library's own splitter, once for each character.
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np

from ._shared import CHUNK_BYTES, LONG_SPAN, SpanHash, byte_windows, gathered, kept, span_word

SPACE, LETTER, NUMBER, OTHER, UNKNOWN = 0, 1, 2, 3, 255
#: Pieces that a worker remembers, of some 200 bytes each.
PIECES = 250_000
#: Bytes behind a piece's start that can decide whether it is one: the split pattern looks no further ahead.
GUARD = 8

#: The split pattern of byte-level BPE as the public rank files use it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself if printable Latin-1, else the next free one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def library_tokenizer(path: str):
    """A tokenizers.Tokenizer from a .json file, or from a .tiktoken rank file.

    For ranks, every split of a token into two tokens is a merge, in order of the joined token's rank:
    the pair that the rank rule would join next is then also the first merge that applies.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    if path.endswith(".json"):
        return Tokenizer.from_file(path)
    ranks, shown = read_ranks(path), byte_characters()
    text = {token: "".join([shown[b] for b in token]) for token in ranks}
    merges = []
    for token, _ in sorted(ranks.items(), key=lambda item: item[1]):
        pairs = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        merges += [(text[a], text[b]) for a, b in sorted(pairs, key=lambda pair: (ranks[pair[0]], ranks[pair[1]]))]
    made = Tokenizer(models.BPE(vocab={text[token]: rank for token, rank in ranks.items()}, merges=merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(PATTERN), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    made.decoder = decoders.ByteLevel()
    return made


class PieceEncoder:
    """ids of whole texts as the tokenizers library gives them, without added tokens."""

    SLOTS = 1 << 20

    def __init__(self, path: str, memory: int = PIECES) -> None:
        self.library, self.memory = library_tokenizer(path), memory
        #: Added tokens with their ids, and whether pieces can be handled apart; any other layout goes to the library as whole texts.
        self.added, self.by_piece = ({}, True) if path.endswith(".tiktoken") else self._layout(path)
        self.finder = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        self.hash = SpanHash()
        self._forget()

    @staticmethod
    def _layout(path: str) -> tuple[dict[bytes, int], bool]:
        with open(path, encoding="utf-8") as file:
            layout = json.load(file)
        splitter, model, added = layout.get("pre_tokenizer") or {}, layout["model"], layout.get("added_tokens") or []
        by_bytes = splitter.get("type") == "ByteLevel" and splitter.get("use_regex") and not splitter.get("add_prefix_space")
        plain = model["type"] == "BPE" and not layout.get("normalizer") and not layout.get("post_processor") and not model.get("dropout")
        alone = not any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip"))
        return {t["content"].encode(): t["id"] for t in added}, bool(by_bytes and plain and alone)

    def _forget(self) -> None:
        self.keys, self.slots = np.zeros(self.SLOTS, np.uint64), np.full(self.SLOTS, -1, np.int64)
        self.known: dict[int, int] = {}
        self.starts, self.counts, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        #: the pieces themselves, as words of eight bytes and lengths; long ones as bytes
        self.word_at, self.words, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.long: dict[int, bytes] = {}

    def _kind(self, character: str) -> int:
        alone = lambda text: len(self.library.pre_tokenizer.pre_tokenize_str(text)) == 1
        return LETTER if alone("a" + character) else NUMBER if alone("1" + character) else OTHER if alone("!" + character) else SPACE

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte positions where the pieces of consecutive texts start, and each text's first piece."""
        letters = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        at = np.flatnonzero((data & 0xC0) != 0x80)
        kinds = self.kinds[letters]
        if (kinds == UNKNOWN).any():
            for c in np.unique(letters[kinds == UNKNOWN]).tolist():
                self.kinds[c] = self._kind(chr(c))
            kinds = self.kinds[letters]
        n = len(letters)
        first = np.zeros(n + 1, bool)
        first[np.searchsorted(at, offsets[:-1][np.diff(offsets) > 0])] = True
        first[n] = True
        start = first.copy()
        start[1:n] |= kinds[1:] != kinds[:-1]
        runs = np.flatnonzero(start)
        begin, end = runs[:-1], runs[1:]
        mark, kind = start[:n], kinds[begin]
        # white space before more text: its last character stands alone or leads the next piece
        inner = (kind == SPACE) & ~first[end]
        mark[end[inner & (end - begin > 1)] - 1] = True
        led = begin[(kind != SPACE) & ~first[begin]]
        led = led[letters[led - 1] == 0x20]
        mark[led] = False
        # 's 't 're 've 'm 'll 'd: an apostrophe that starts a piece takes letters of the next run
        quote = np.flatnonzero((kind[:-1] == OTHER) & (kind[1:] == LETTER) & (end[:-1] - begin[:-1] == 1) & (letters[begin[:-1]] == 0x27)) if len(kind) > 1 else np.zeros(0, np.int64)
        for q in quote.tolist():
            b, e = int(begin[q + 1]), int(end[q + 1])
            if not mark[b - 1] or first[b]:
                continue
            two = chr(letters[b]) + (chr(letters[b + 1]) if b + 1 < e else "")
            taken = 1 if two[0] in "stmd" else 2 if two in ("re", "ve", "ll") else 0
            if taken:
                mark[b] = False
                if b + taken < e:
                    mark[b + taken] = True
        places = at[np.flatnonzero(mark)]
        return places, np.searchsorted(places, offsets)

    def _slots(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The memory's entry of each piece. Entries are found by hash and held against the piece's bytes."""
        keys = self.hash(data, starts, ends)
        low = (keys & np.uint64(self.SLOTS - 1)).astype(np.int64)
        found = self.slots[low]
        miss = np.flatnonzero((self.keys[low] != keys) | (found < 0))
        if len(miss):
            fresh, where, back = np.unique(keys[miss], return_index=True, return_inverse=True)
            if len(self.known) + len(fresh) > self.memory and self.known:
                self._forget()
                return self._slots(data, starts, ends)
            named = fresh.tolist()
            entry = np.fromiter((self.known.get(k, -1) for k in named), np.int64, len(named))
            new = np.flatnonzero(entry < 0)
            if len(new):
                entry[new] = self._learn(data, starts[miss[where[new]]], ends[miss[where[new]]])
                self.known.update(zip(fresh[new].tolist(), entry[new].tolist(), strict=True))
            found[miss] = entry[back]
            place = (fresh & np.uint64(self.SLOTS - 1)).astype(np.int64)
            self.keys[place], self.slots[place] = fresh, entry
        other = np.flatnonzero(~self._same(data, starts, ends, found))
        if len(other):  # pieces that share a hash with another one
            found[other] = self._learn(data, starts[other], ends[other])
        return found

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """New entries for these pieces, from the library."""
        raw, size = data.tobytes(), ends - starts
        texts = [raw[s:e].decode("utf-8") for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        ids = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        entry = len(self.counts) + np.arange(len(ids))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(counts.sum()))])
        wide = np.where(size <= LONG_SPAN, -(-size // 8), 0)
        at = np.cumsum(wide) - wide
        words, windows = np.zeros(int(wide.sum()), np.uint64), byte_windows(data)
        for k in range(int(wide.max(initial=0))):
            live = np.flatnonzero(wide > k)
            words[at[live] + k] = span_word(windows, starts[live], size[live] - 8 * k, k)
        self.word_at = np.concatenate([self.word_at, len(self.words) + at])
        self.words = np.concatenate([self.words, words])
        self.sizes = np.concatenate([self.sizes, size])
        self.long.update((int(entry[i]), raw[starts[i] : ends[i]]) for i in np.flatnonzero(size > LONG_SPAN).tolist())
        return entry

    def _same(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Whether each piece's bytes are its entry's."""
        size = ends - starts
        same = self.sizes[entry] == size
        windows, k = byte_windows(data), 0
        live = np.flatnonzero(same & (size <= LONG_SPAN))
        while len(live):
            match = span_word(windows, starts[live], size[live] - 8 * k, k) == self.words[self.word_at[entry[live]] + k]
            same[live[~match]] = False
            k += 1
            live = live[match]
            live = live[size[live] > 8 * k]
        for i in np.flatnonzero(same & (size > LONG_SPAN)).tolist():
            same[i] = data[starts[i] : ends[i]].tobytes() == self.long[int(entry[i])]
        return same

    def piece_counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece starts, tokens of each piece, each text's first piece)."""
        starts, firsts = self.pieces(data, offsets)
        slots = self._slots(data, starts, np.append(starts[1:], len(data)))
        return starts, self.counts[slots], firsts

    def stretches(self, data: bytes) -> Iterator[tuple[int, int, int | None]]:
        """(start, end, id) of a text's stretches: added tokens, which the library treats before it splits, with their id, and what is between them with None."""
        at = 0
        for hit in self.finder.finditer(data) if self.finder else ():
            if hit.start() > at:
                yield at, hit.start(), None
            yield hit.start(), hit.end(), self.added[hit.group()]
            at = hit.end()
        if at < len(data):
            yield at, len(data), None

    def parts(self, data: np.ndarray, window: int = CHUNK_BYTES) -> Iterator[np.ndarray]:
        """The ids of one text, a window at a time.

        A window ends where a piece starts that the bytes behind the window can't have moved: GUARD bytes before
        its end. A piece without such an end makes the window grow.
        """
        if not self.by_piece:
            yield self._whole(data, np.array([0, len(data)]), [0])[0]
            return
        for start, end, token in self.stretches(data.tobytes()):
            if token is not None:
                yield np.array([token], np.int32)
                continue
            size = window
            while start < end:
                stop = start + size
                while start < stop < end and data[stop] & 0xC0 == 0x80:
                    stop -= 1
                some = data[start : min(stop, end)]
                begins, _ = self.pieces(some, np.array([0, len(some)]))
                if stop < end:
                    sure = begins[(begins > 0) & (begins <= len(some) - GUARD)]
                    if not len(sure):
                        size *= 2
                        continue
                    some = some[: sure[-1]]
                    begins = begins[begins < sure[-1]]
                slots = self._slots(some, begins, np.append(begins[1:], len(some)))
                yield gathered(self.flat, self.starts[slots], self.counts[slots])
                start, size = start + len(some), window

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets into ids) of the texts data[offsets[i] : offsets[i + 1]]; offsets start at 0."""
        if not self.by_piece:
            return self._whole(data, offsets, range(len(offsets) - 1))
        odd = np.diff(offsets) > CHUNK_BYTES
        if self.finder:
            for hit in self.finder.finditer(data.tobytes()):
                odd[np.searchsorted(offsets, hit.start(), "right") - 1] = True
        if not odd.any():
            starts, firsts = self.pieces(data, offsets)
            slots = self._slots(data, starts, np.append(starts[1:], len(data)))
            counts = self.counts[slots]
            return gathered(self.flat, self.starts[slots], counts), np.append(0, np.cumsum(counts))[firsts]
        found, at = [], 0
        for row in [*np.flatnonzero(odd).tolist(), len(odd)]:
            if row > at:
                found.append(self.encode(data[offsets[at] : offsets[row]], offsets[at : row + 1] - offsets[at]))
            if row < len(odd):
                ids = np.concatenate([np.zeros(0, np.int32), *self.parts(data[offsets[row] : offsets[row + 1]])])
                found.append((ids, np.array([0, len(ids)])))
            at = row + 1
        return np.concatenate([x for x, _ in found]), np.append(0, np.cumsum(np.concatenate([np.diff(e) for _, e in found])))

    def _whole(self, data: np.ndarray, offsets: np.ndarray, rows) -> tuple[np.ndarray, np.ndarray]:
        found = [self.library.encode(data[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8"), add_special_tokens=False).ids for r in rows]
        ends = np.append(0, np.cumsum([len(x) for x in found], dtype=np.int64))
        return np.fromiter((i for x in found for i in x), np.int32, int(ends[-1])), ends


_encoders: dict[str, PieceEncoder] = {}
kept.append(_encoders)


def encoder(path: str, memory: int = PIECES) -> PieceEncoder:
    """One encoder for each file in each worker; it remembers ``memory`` pieces from then on."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    _encoders[path].memory = memory
    return _encoders[path]
