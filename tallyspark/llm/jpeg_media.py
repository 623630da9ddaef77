"""Media columns: baseline JPEG read in numpy.

The decoder parses markers, Huffman-decodes the scan, keeps the quantised coefficients and draws a luminance
thumbnail of one pixel for each block from the DC terms. All restart intervals of all images of a batch that
share tables are decoded in step, each numpy operation taking one symbol of every interval.

``to_jpeg`` makes such images from texts without loss: a block's 64 coefficients hold 64 payload bytes.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import fresh, spans, string_bytes, tidy, whole_text

#: Fixed values of the format: markers.
SOI, EOI, SOF0, DHT, DQT, DRI, SOS, COM, RST0 = 0xD8, 0xD9, 0xC0, 0xC4, 0xDB, 0xDD, 0xDA, 0xFE, 0xD0
#: A payload byte b is the coefficient b + SHIFT, so that every value has SIZE bits and 0 is never met.
SHIFT, SIZE = 256, 9
#: Most blocks on a side of an image.
SIDE = 8191
#: Bytes of texts, and blocks, handled at once; longer texts and images go through in windows of so many bytes.
PASS_BYTES, PASS_BLOCKS, WINDOW = 1 << 20, 1 << 15, 1 << 20
#: Bytes that hold all that comes before a long image's scan.
HEAD_BYTES = 1 << 20


class JpegError(ValueError):
    """The bytes aren't a baseline JPEG."""


@dataclass
class Header:
    """What comes before a scan's bits."""

    width: int = 0
    height: int = 0
    restart: int = 0
    comment: bytes = b""
    quants: dict[int, np.ndarray] = field(default_factory=dict)
    codes: dict[int, tuple[bytes, bytes]] = field(default_factory=dict)
    #: (component id, horizontal and vertical factor, quantisation table) and, in scan order, (component, DC table, AC table)
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)
    scan: list[tuple[int, int, int]] = field(default_factory=list)

    def layout(self) -> tuple:
        """Images of equal layouts can be decoded in step."""
        return (self.restart, tuple(self.parts), tuple(self.scan), tuple(sorted(self.codes.items())))

    def grid(self) -> tuple[int, int]:
        """MCUs of the scan across and down; in a scan of one component an MCU is a block of that component."""
        most = [max(p[k] for p in self.parts) for k in (1, 2)]
        if len(self.scan) == 1:
            own = self.parts[self.scan[0][0]]
            return tuple(-(-(-(-size * own[k] // m)) // 8) for size, k, m in zip((self.width, self.height), (1, 2), most, strict=True))
        return -(-self.width // (8 * most[0])), -(-self.height // (8 * most[1]))

    def luminance(self) -> int:
        """Place of the image's first component in the scan."""
        return [c for c, _, _ in self.scan].index(0)

    def factors(self, place: int) -> tuple[int, int]:
        """Blocks across and down that a component of the scan has in an MCU."""
        return (1, 1) if len(self.scan) == 1 else self.parts[self.scan[place][0]][1:3]


def _frame(body: bytes, head: Header) -> None:
    depth, head.height, head.width, n = struct.unpack_from(">BHHB", body)
    head.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
    if depth != 8 or not head.width or not head.height or not n:
        raise JpegError("not an image of 8-bit samples")
    if any(not 1 <= x <= 4 for p in head.parts for x in p[1:3]) or len({p[0] for p in head.parts}) < n:
        raise JpegError("no such components")


def _next_marker(data: bytes, at: int) -> int:
    """Where the entropy-coded bytes from ``at`` on end."""
    while (at := data.find(b"\xff", at)) >= 0 and at + 1 < len(data):
        if data[at + 1] not in (0, 0xFF) and not RST0 <= data[at + 1] <= RST0 + 7:
            return at
        at += 1
    return len(data)


def parse(data: bytes) -> tuple[Header, int]:
    """(header, where the bits begin) of the scan that holds the image's first component; scans of others before it are passed over."""
    if data[:2] != bytes([0xFF, SOI]):
        raise JpegError("no SOI marker")
    head, at = Header(), 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise JpegError(f"no marker at {at}")
        kind = data[at + 1]
        if kind == 0xFF:  # a fill byte
            at += 1
            continue
        if kind == EOI:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if size < 2 or len(body) < size - 2:
            raise JpegError("a segment ends early")
        at += 2 + size
        if kind == SOF0:
            _frame(body, head)
        elif 0xC1 <= kind <= 0xCF and kind not in (DHT, 0xC8, 0xCC):
            raise JpegError("not baseline")
        elif kind == DQT:
            while body:
                wide = 1 + (body[0] >> 4)
                head.quants[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.int64)
                body = body[1 + 64 * wide :]
        elif kind == DHT:
            while body:
                n = sum(body[1:17])
                if len(body) < 17 + n or sum(c << (15 - i) for i, c in enumerate(body[1:17])) > 1 << 16:
                    raise JpegError("no such code")
                head.codes[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind == DRI:
            head.restart = struct.unpack(">H", body)[0]
        elif kind == COM:
            head.comment = body
        elif kind == SOS:
            ids = [p[0] for p in head.parts]
            head.scan = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            if 0 not in [c for c, _, _ in head.scan]:
                at = _next_marker(data, at)
                continue
            if any(d not in head.codes or (16 | a) not in head.codes for _, d, a in head.scan) or len(head.quants.get(head.parts[0][3], ())) < 64:
                raise JpegError("tables are missing")
            return head, at
    raise JpegError("no scan")


def _lookup(code: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(length, symbol) of the code that a 16-bit window begins with; length 0 where there is none."""
    length, symbol = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    value = at = 0
    for bits in range(1, 17):
        for _ in range(code[0][bits - 1]):
            low = value << (16 - bits)
            length[low : low + (1 << (16 - bits))] = bits
            symbol[low : low + (1 << (16 - bits))] = code[1][at]
            value, at = value + 1, at + 1
        value <<= 1
    return length, symbol


def unstuffed(scan: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(entropy-coded bytes without stuffing and markers, start of each restart interval in them, bytes of the scan)."""
    lead = np.flatnonzero(scan[:-1] == 0xFF)
    after = scan[lead + 1]
    marks = (after != 0) & (after != 0xFF)
    ends = lead[marks & ~((after >= RST0) & (after <= RST0 + 7))]
    end = int(ends[0]) if len(ends) else len(scan)
    lead, after = lead[lead < end], after[lead < end]
    restarts = lead[(after >= RST0) & (after <= RST0 + 7)]
    keep = np.ones(end, bool)
    keep[lead[after == 0] + 1] = False
    keep[restarts] = keep[restarts + 1] = False
    position = np.append(0, np.cumsum(keep))
    return scan[:end][keep], np.append(0, position[restarts]), end


def decode_intervals(head: Header, bits: np.ndarray, starts: np.ndarray, mcus: np.ndarray) -> list[np.ndarray]:
    """Quantised coefficients in zigzag order of restart intervals that start at ``starts`` and hold ``mcus`` MCUs.

    For each component of the scan an array (intervals, blocks of the longest, 64).
    """
    padded = np.concatenate([bits, np.zeros(12, np.uint8)]).astype(np.uint64)
    window = np.zeros(len(padded) - 7, np.uint64)
    for k in range(8):
        window |= padded[k : k + len(window)] << np.uint64(56 - 8 * k)
    tables = [(_lookup(head.codes[d]), _lookup(head.codes[16 | a])) for _, d, a in head.scan]
    factors = [head.factors(i) for i in range(len(head.scan))]
    longest = int(mcus.max(initial=0))
    out = [np.zeros((len(starts), longest * h * v, 64), np.int16) for h, v in factors]
    at = starts.astype(np.int64) * 8
    previous = np.zeros((len(head.scan), len(starts)), np.int64)
    limit = 8 * (len(window) - 1)

    def value(where: np.ndarray, code: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, signed number behind it) at the bit positions of these intervals, which move on."""
        place = at[where]
        if (place > limit).any():
            raise JpegError("the scan ends early")
        ahead = window[place >> 3] << (place & 7).astype(np.uint64)
        peek = (ahead >> np.uint64(48)).astype(np.int64)
        length, symbol = code[0][peek], code[1][peek]
        if not length.all():
            raise JpegError("no such code")
        size = symbol & 15
        shift = length.astype(np.uint64)
        extra = ((ahead << shift) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
        at[where] = place + length + size
        return symbol, np.where((size > 0) & (extra < (1 << np.maximum(size - 1, 0))), extra - (1 << size) + 1, extra)

    for m in range(longest):
        live = np.flatnonzero(mcus > m)
        for part, ((h, v), (dc, ac)) in enumerate(zip(factors, tables, strict=True)):
            for block in range(m * h * v, (m + 1) * h * v):
                _, step = value(live, dc)
                previous[part, live] += step
                out[part][live, block, 0] = previous[part, live]
                busy, k = live, np.ones(len(live), np.int64)
                while len(busy):
                    symbol, number = value(busy, ac)
                    k = k + (symbol >> 4)
                    stop = symbol == 0
                    put = ~stop & (k < 64) & ((symbol & 15) > 0)
                    out[part][busy[put], block, k[put]] = number[put]
                    k = k + 1
                    go = ~stop & (k < 64)
                    if not go.all():
                        busy, k = busy[go], k[go]
    return out


@dataclass
class Image:
    """What a decoder keeps: coefficients of the first component by block in MCU order, and the luminance thumbnail."""

    header: Header
    blocks: np.ndarray
    thumbnail: np.ndarray


def decode(images: list[bytes]) -> list[Image]:
    """Decodes baseline images; those of one layout and of intervals of about one length together."""
    groups: dict[tuple, list[int]] = {}
    heads, scans = [], []
    for i, data in enumerate(images):
        head, at = parse(data)
        across, down = head.grid()
        total = across * down
        bits, begin, _ = unstuffed(np.frombuffer(data, np.uint8)[at:])
        blocks = total * sum(h * v for h, v in map(head.factors, range(len(head.scan))))
        if 2 * blocks > 8 * len(bits):  # a block takes two bits at least
            raise JpegError("the scan ends early")
        each = head.restart or total
        count = np.full(len(begin), each)
        count[-1] = total - each * (len(begin) - 1)
        if not 0 < count[-1] <= each:
            raise JpegError("restart intervals don't fit the size")
        heads.append(head)
        scans.append((bits, begin, count))
        groups.setdefault((head.layout(), int(count[0]).bit_length()), []).append(i)
    out: list[Image | None] = [None] * len(images)
    for members in groups.values():
        head = heads[members[0]]
        base = np.append(0, np.cumsum([len(scans[i][0]) for i in members]))
        found = decode_intervals(head, np.concatenate([scans[i][0] for i in members]), np.concatenate([scans[i][1] + b for i, b in zip(members, base[:-1], strict=True)]), np.concatenate([scans[i][2] for i in members]))[head.luminance()]
        h, v = head.factors(head.luminance())
        at = 0
        for i in members:
            count = scans[i][2]
            part = found[at : at + len(count)]
            at += len(count)
            blocks = np.concatenate([x[: c * h * v] for x, c in zip(part, count.tolist(), strict=True)]) if (count * h * v != part.shape[1]).any() else part.reshape(-1, 64)
            out[i] = Image(heads[i], blocks, _thumbnail(heads[i], blocks[:, 0], h, v))
    return out


def _scan_windows(scan: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, bool]]:
    """(bytes of whole restart intervals, whether they are the last) of a scan, about ``size`` bytes at a time."""
    at, wide = 0, size
    while at + wide < len(scan):
        some = scan[at : at + wide]
        lead = np.flatnonzero((some[:-1] == 0xFF) & (some[1:] >= RST0) & (some[1:] <= RST0 + 7))
        if not len(lead):
            wide *= 2
            continue
        end = int(lead[-1]) + 2
        yield some[:end], False
        at, wide = at + end, size
    yield scan[at:], True


def decode_windows(head: Header, scan: np.ndarray, size: int = WINDOW) -> Iterator[np.ndarray]:
    """Coefficients of the first component's blocks in MCU order, a window of restart intervals at a time, of an image that has such intervals."""
    across, down = head.grid()
    left, place = across * down, head.luminance()
    if 2 * left > 8 * len(scan):  # a block takes two bits at least
        raise JpegError("the scan ends early")
    h, v = head.factors(place)
    for some, last in _scan_windows(scan, size):
        bits, begin, _ = unstuffed(some)
        begin = begin if last else begin[:-1]
        count = np.full(len(begin), head.restart)
        if last:
            count[-1] = left - head.restart * (len(begin) - 1)
        left -= int(count.sum())
        if not 0 < count[-1] <= head.restart or left < 0 or (left == 0) != last:
            raise JpegError("restart intervals don't fit the size")
        found = decode_intervals(head, bits, begin, count)[place]
        yield found[np.arange(found.shape[1]) < (count * h * v)[:, None]]


def _thumbnail(head: Header, dc: np.ndarray, h: int, v: int) -> np.ndarray:
    """A pixel for each luminance block, from its DC term: dequantised, over 8, plus 128."""
    across, down = head.grid()
    level = dc.astype(np.int64) * int(head.quants[head.parts[0][3]][0])
    pixels = np.clip(np.floor_divide(level + 4, 8) + 128, 0, 255).astype(np.uint8)
    return pixels.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)


def thumbnail_hash(pixels: np.ndarray) -> str:
    """64 bits: cells of an 8 by 8 grid that are brighter than the mean; then the crc32 of all pixels."""
    rows, columns = (np.arange(8) * n // 8 for n in pixels.shape)
    total = np.zeros((pixels.shape[0] + 1, pixels.shape[1] + 1), np.int64)
    total[1:, 1:] = pixels.astype(np.int64).cumsum(0).cumsum(1)
    low, high = np.maximum(np.append(rows[1:], pixels.shape[0]), rows + 1), np.maximum(np.append(columns[1:], pixels.shape[1]), columns + 1)
    sums = total[low][:, high] - total[rows][:, high] - total[low][:, columns] + total[rows][:, columns]
    means = sums / np.outer(low - rows, high - columns)
    return f"{np.packbits(means > means.mean()).tobytes().hex()}-{zlib.crc32(pixels.tobytes()):08x}"


def _segment(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


#: One code of one bit, for a number of SIZE bits without zeros before it.
_ONE_CODE = bytes([1, *[0] * 15, SIZE])


def _stuffed(blocks: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the blocks, each an interval with its marker by ``number`` behind it; where each of their 82 bytes begins, and the end)."""
    # ten bits a coefficient: the code 0, then the nine bits of b + 256
    value = blocks.astype(np.uint16).reshape(-1, 16, 4) + SHIFT
    packed = np.empty((len(blocks), 16, 5), np.uint8)
    packed[:, :, 0] = value[:, :, 0] >> 2
    packed[:, :, 1] = (value[:, :, 0] & 3) << 6 | value[:, :, 1] >> 4
    packed[:, :, 2] = (value[:, :, 1] & 15) << 4 | value[:, :, 2] >> 6
    packed[:, :, 3] = (value[:, :, 2] & 63) << 2 | value[:, :, 3] >> 8
    packed[:, :, 4] = value[:, :, 3] & 255
    rows = np.empty((len(blocks), 82), np.uint8)
    rows[:, :80] = packed.reshape(-1, 80)
    rows[:, 80], rows[:, 81] = 0xFF, RST0 + number % 8
    # a zero behind each FF of the bits
    flat = rows.ravel()
    stuffed = (rows == 0xFF) & (np.arange(82) < 80)
    wide = stuffed.ravel().astype(np.int64) + 1
    at = np.append(0, np.cumsum(wide))
    out = np.zeros(at[-1], np.uint8)
    out[at[:-1]] = flat
    return out, at


def _around(count: int) -> tuple[bytes, bytes]:
    """What stands before the intervals of an image of so many payload blocks, and behind them: blocks of payload bytes 0 that fill the last row, as the comment says how much counts."""
    across = int(np.ceil(np.sqrt(count)))
    down = -(-count // across)
    if down > SIDE:
        raise JpegError("too many blocks for an image")
    head = b"\xff\xd8" + _segment(COM, b"payload %d" % (64 * count)) + _segment(DQT, b"\0" + b"\1" * 64)
    head += _segment(SOF0, struct.pack(">BHHBBBB", 8, 8 * down, 8 * across, 1, 1, 0x11, 0)) + _segment(DHT, b"\x00" + _ONE_CODE + b"\x10" + _ONE_CODE)
    spare = b"".join(bytes([0x40, 0x10, 0x04, 0x01, 0x00]) * 16 + bytes([0xFF, RST0 + (count + k) % 8]) for k in range(across * down - count))
    return head + _segment(DRI, b"\0\1") + _segment(SOS, b"\1\1\0\0\x3f\0"), spare


def encode_payloads(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A gray baseline JPEG for each payload, whose length is a positive multiple of 64: a block is a restart interval, so that DC terms stand alone."""
    first = offsets // 64
    count = np.diff(first)
    blocks = data.reshape(-1, 64)
    out, at = _stuffed(blocks, np.arange(len(blocks)) - np.repeat(first[:-1], count))
    images = []
    for i in range(len(count)):
        head, spare = _around(int(count[i]))
        body = out[at[82 * first[i]] : at[82 * first[i + 1]]].tobytes() + spare
        images.append(head + body[:-2] + b"\xff\xd9")
    return images


def encode_long(text: np.ndarray, window: int = WINDOW) -> pa.Buffer:
    """What ``encode_payloads`` makes of one text's bytes and the zeros behind them, a window at a time."""
    count = max(-(-len(text) // 64), 1)
    head, spare = _around(count)
    out, step = pa.BufferOutputStream(), max(window // 64, 1)
    out.write(head)
    for start in range(0, count, step):
        part = text[64 * start : 64 * (start + step)]
        blocks = part if len(part) % 64 == 0 and len(part) else np.append(part, np.zeros(-len(part) % 64 or 64, np.uint8))
        made, _ = _stuffed(blocks.reshape(-1, 64), start + np.arange(len(blocks) // 64))
        out.write(made if start + step < count or spare else made[:-2])
    out.write(spare[:-2] + b"\xff\xd9")
    return out.getvalue()


def payload(image: Image) -> np.ndarray | None:
    """The bytes that ``encode_payloads`` stored; None of an image that it can't have made."""
    named = re.fullmatch(rb"payload ([1-9][0-9]{0,11})", image.header.comment)
    size, values = int(named[1]) if named else 0, image.blocks.ravel() - np.int16(SHIFT)
    if not size or size % 64 or not 0 <= len(values) - size < 64 * image.header.grid()[0]:
        return None
    if values.min() < 0 or values.max() > 255 or values[size:].any():
        return None
    return values[:size].astype(np.uint8)


def read_long(raw: np.ndarray, window: int = WINDOW) -> tuple | None:
    """What ``describe`` tells of one long image, whose blocks are read a window at a time; None if it has no restart intervals to stop at."""
    view = memoryview(raw)
    whole = hashlib.sha256(view).hexdigest()
    broken = (None, None, None, len(raw), whole, None, None, None)
    try:
        head, at = parse(bytes(view[:HEAD_BYTES]))
    except (JpegError, LookupError, struct.error, ValueError):
        if len(raw) > HEAD_BYTES:  # what the scan needs may come later
            return None
        return broken
    if not head.restart:
        return None
    try:
        named = re.fullmatch(rb"payload ([1-9][0-9]{0,11})", head.comment)
        across, down = head.grid()
        h, v = head.factors(head.luminance())
        size, total = int(named[1]) if named else 0, 64 * across * down * h * v
        stored = bool(size) and size % 64 == 0 and 0 <= total - size < 64 * across
        levels, held, done, tail = [], hashlib.sha256(), 0, b""
        for blocks in decode_windows(head, raw[at:], window):
            levels.append(blocks[:, 0].copy())
            values = blocks.ravel() - np.int16(SHIFT)
            mine = values[: max(size - done, 0)]
            stored = stored and values.min() >= 0 and values.max() <= 255 and not values[len(mine) :].any()
            if stored and len(mine):
                part = mine.astype(np.uint8).tobytes()
                held.update(part)
                tail = part[-64:]
            done += len(values)
        feature = f"{head.width}x{head.height}-{thumbnail_hash(_thumbnail(head, np.concatenate(levels), h, v))}"
    except (JpegError, ArithmeticError, LookupError, struct.error, ValueError):
        return broken
    found = (size, held.hexdigest(), zlib.crc32(tail)) if stored else (None, None, None)
    return (*found, len(raw), whole, feature, head.width, head.height)


def to_jpeg(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): every whole text as a JPEG that holds its bytes, zeros up to a positive multiple of 64 behind them.

    Null texts count as empty. Equal texts make equal images; rows with equal or null keys are kept, and other
    columns play no part, whatever their names. An empty table gives no rows. A long text goes through in windows, so a
    worker holds it, its image and a few MB. An image is one value of a row, so a text's image must stay under 2 GB.
    """
    base = docs.select(F.col(key), whole_text(text).alias(fresh([key], "text")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = string_bytes(batch.column(1))
            for a, b in spans(bounds, PASS_BYTES):
                size = np.diff(bounds[a : b + 1])
                if size[0] > PASS_BYTES:  # one long text
                    image = encode_long(data[bounds[a] : bounds[b]])
                    ends = pa.py_buffer(np.array([0, image.size], np.int32))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 1), pa.array(size, pa.int64()), pa.BinaryArray.from_buffers(pa.binary(), 1, [None, ends, image])], names=[key, "n_bytes", "media"])
                    continue
                full = np.maximum(-(-size // 64), 1) * 64
                at = np.append(0, np.cumsum(full))
                padded = np.zeros(at[-1], np.uint8)
                padded[np.arange(size.sum()) + np.repeat(at[:-1] - (np.cumsum(size) - size), size)] = data[bounds[a] : bounds[b]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(size, pa.int64()), pa.array(encode_payloads(padded, at), pa.binary())], names=[key, "n_bytes", "media"])

    return base.mapInArrow(tidy(rows), f"`{key}` {docs.schema[key].dataType.simpleString()}, n_bytes long, media binary")


def describe(media: DataFrame, key: str = "doc_id", column: str = "media", kept: tuple[str, ...] = ("n_bytes",)) -> DataFrame:
    """(key, *kept, width, height, payload columns, media_bytes, media_sha256, feature) of every image.

    The feature is width, height and the thumbnail's hashes, so equal images have equal ones. Null, empty or broken
    media have null there and no dimensions; an image that ``to_jpeg`` can't have made has its thumbnail but no
    payload columns. Rows with equal or null keys are kept; columns not named in ``kept`` are left out, whatever
    their names. An empty table gives no rows. Long images with restart intervals, as ``to_jpeg`` makes them, are read in
    windows; others are decoded whole.
    """
    schema = f"`{key}` {media.schema[key].dataType.simpleString()}, " + "".join(f"`{c}` {media.schema[c].dataType.simpleString()}, " for c in kept)
    schema += "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int"

    def read(some: list[bytes]) -> list[tuple]:
        try:
            images = decode(some)
        except (JpegError, ArithmeticError, LookupError, struct.error, ValueError):
            if len(some) > 1:
                return [x for one in some for x in read([one])]
            return [(None, None, None, len(some[0]), hashlib.sha256(some[0]).hexdigest(), None, None, None)]
        out = []
        for raw, image in zip(some, images, strict=True):
            found = payload(image)
            held = None if found is None else found.tobytes()
            w, h = image.header.width, image.header.height
            out.append((None if held is None else len(held), None if held is None else hashlib.sha256(held).hexdigest(), None if held is None else zlib.crc32(held[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), f"{w}x{h}-{thumbnail_hash(image.thumbnail)}", w, h))
        return out

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
        names = [key, *kept, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"]
        for batch in batches:
            data, bounds = string_bytes(batch.column(column))
            for a, b in spans(bounds, PASS_BLOCKS * 82):
                long = read_long(data[bounds[a] : bounds[b]]) if bounds[b] - bounds[a] > PASS_BLOCKS * 82 else None
                some = [] if long else [x or b"" for x in batch.column(column).slice(a, b - a).to_pylist()]
                found = list(zip(*([long] if long else read(some)), strict=True))
                kept_ = [batch.column(c).slice(a, b - a) for c in (key, *kept)]
                yield pa.RecordBatch.from_arrays([*kept_, *[pa.array(c, t) for c, t in zip(found, types, strict=True)]], names=names)

    return media.select(key, *kept, column).mapInArrow(tidy(rows), schema)
