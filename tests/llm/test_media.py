import hashlib
import struct
import zlib

import numpy as np
import pytest

from tallyspark.llm import jpeg_media as M

from .conftest import ROWS


def test_texts_round_trip(odd, none):
    got = sorted(((r.doc_id if r.doc_id is not None else -99, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in M.describe(M.to_jpeg(odd)).collect()))
    want = []
    for i, text, *_ in ROWS:
        raw = (text or "").encode()
        held = raw + bytes(max(-len(raw) % 64, 64 if not raw else 0))
        want.append((i if i is not None else -99, len(raw), len(held), hashlib.sha256(held).hexdigest(), zlib.crc32(held[-64:])))
    assert got == sorted(want)
    assert M.describe(M.to_jpeg(none)).count() == 0


def test_broken_media_have_no_dimensions(spark):
    good = M.encode_payloads(np.arange(64, dtype=np.uint8), np.array([0, 64]))[0]
    media = spark.createDataFrame([(1, bytearray(good)), (2, None), (3, bytearray(b"")), (4, bytearray(good[:-30])), (5, bytearray(b"\xff\xd8junk"))], "doc_id long, media binary")
    got = {r.doc_id: (r.width, r.payload_bytes) for r in M.describe(media, kept=()).collect()}
    assert got[1] == (8, 64) and all(got[i][0] is None for i in (2, 3, 5))


def bits_of(value, size):
    return format(value if value >= 0 else value + (1 << size) - 1, f"0{size}b") if size else ""


def plain_jpeg(blocks, across, down, restart=0, factors=((1, 1),)):
    """A baseline image with codes of equal lengths, runs, end-of-block codes and several components; ``blocks`` are in MCU order by component."""
    symbols = [r << 4 | s for r in range(16) for s in range(1, 11)] + [0x00, 0xF0]
    code = {s: format(i, "08b") for i, s in enumerate(symbols)}
    out, bits, before = b"", "", [0] * len(factors)
    at = [0] * len(factors)

    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")

    for mcu in range(across * down):
        if restart and mcu and mcu % restart == 0:
            out += flush(bits) + bytes([0xFF, 0xD0 + (mcu // restart - 1) % 8])
            bits, before = "", [0] * len(factors)
        for c, (h, v) in enumerate(factors):
            for _ in range(h * v):
                block = [int(x) for x in blocks[c][at[c]]]
                at[c] += 1
                step, before[c] = block[0] - before[c], block[0]
                size = abs(step).bit_length()
                bits += format(size, "04b") + bits_of(step, size)
                run = 0
                last = max([k for k in range(1, 64) if block[k]], default=0)
                for k in range(1, last + 1):
                    if not block[k]:
                        run += 1
                        continue
                    while run > 15:
                        bits, run = bits + code[0xF0], run - 16
                    size = abs(block[k]).bit_length()
                    bits, run = bits + code[run << 4 | size] + bits_of(block[k], size), 0
                if last < 63:
                    bits += code[0]
    seg = M._segment
    big_h, big_v = max(h for h, _ in factors), max(v for _, v in factors)
    head = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(M.DQT, b"\0" + bytes([16] + [1] * 63))
    head += seg(M.SOF0, struct.pack(">BHHB", 8, down * 8 * big_v, across * 8 * big_h, len(factors)) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(factors)))
    head += seg(M.DHT, b"\0" + bytes([0, 0, 0, 12, *[0] * 12]) + bytes(range(12))) + seg(M.DHT, b"\x10" + bytes([*[0] * 7, len(symbols), *[0] * 8]) + bytes(symbols))
    head += seg(M.DRI, struct.pack(">H", restart)) if restart else b""
    return head + seg(M.SOS, bytes([len(factors)]) + b"".join(bytes([i + 1, 0]) for i in range(len(factors))) + b"\0\x3f\0") + out + flush(bits) + b"\xff\xd9"


def random_blocks(draw, n):
    x = np.where(draw.random((n, 64)) < 0.15, draw.integers(-900, 900, (n, 64)), 0)
    x[:, 0] = draw.integers(-60, 60, n)
    return x


@pytest.mark.parametrize("restart", [0, 2, 3])
def test_gray_images(restart):
    draw = np.random.default_rng(restart)
    blocks = random_blocks(draw, 6)
    image = M.decode([plain_jpeg([blocks], 3, 2, restart)])[0]
    assert (image.blocks == blocks).all() and (image.header.width, image.header.height) == (24, 16)
    assert (image.thumbnail == np.clip((blocks[:, 0] * 16 + 4) // 8 + 128, 0, 255).reshape(2, 3)).all()


def test_colour_images_keep_luminance():
    draw = np.random.default_rng(9)
    luma, one, two = random_blocks(draw, 24), random_blocks(draw, 6), random_blocks(draw, 6)
    image = M.decode([plain_jpeg([luma, one, two], 3, 2, 0, ((2, 2), (1, 1), (1, 1)))])[0]
    assert (image.blocks == luma).all() and image.thumbnail.shape == (4, 6)


def test_other_formats_are_refused():
    with pytest.raises(M.JpegError):
        M.parse(b"\x89PNG")
    gray = plain_jpeg([random_blocks(np.random.default_rng(1), 1)], 1, 1)
    with pytest.raises(M.JpegError):
        M.parse(gray.replace(bytes([0xFF, M.SOF0]), b"\xff\xc2"))


def entropy(image):
    """The scan's bytes of an image of one scan."""
    return image[M.parse(image)[1] : -2]


def colour(scans, across, down):
    """An image of three components with a scan for each, in the order of ``scans``: (component, entropy-coded bytes)."""
    gray = plain_jpeg([np.zeros((1, 64))], 1, 1)
    tables = gray[2 : gray.index(b"\xff\xc0")] + gray[gray.index(b"\xff\xc4") : gray.index(b"\xff\xda")]
    frame = M._segment(M.SOF0, struct.pack(">BHHB", 8, 8 * down, 8 * across, 3) + b"".join(bytes([i + 1, 0x11, 0]) for i in range(3)))
    return b"\xff\xd8" + tables + frame + b"".join(M._segment(M.SOS, bytes([1, c + 1, 0, 0, 0x3F, 0])) + bits for c, bits in scans) + b"\xff\xd9"


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1)])
def test_a_scan_for_each_component(order):
    draw = np.random.default_rng(6)
    blocks = [random_blocks(draw, 12) for _ in range(3)]
    alone = [plain_jpeg([b], 4, 3) for b in blocks]
    image = colour([(c, entropy(alone[c])) for c in order], 4, 3)
    one, gray = M.decode([image, alone[0]])
    assert (one.blocks == blocks[0]).all() and (one.thumbnail == gray.thumbnail).all()


def test_fill_bytes_before_a_marker():
    draw = np.random.default_rng(7)
    blocks = random_blocks(draw, 4)
    image = plain_jpeg([blocks], 2, 2)
    at = image.index(b"\xff\xc0")
    assert (M.decode([image[:at] + b"\xff\xff" + image[at:]])[0].blocks == blocks).all()


def test_hostile_images_end_no_task(spark):
    good = M.encode_payloads(np.arange(128, dtype=np.uint8), np.array([0, 128]))[0]
    factors = good.replace(b"\x01\x11\x00", b"\x01\x00\x00")
    huge = good.replace(struct.pack(">HH", 8, 16), struct.pack(">HH", 65535, 65535))
    other = [good.replace(b"payload 128", x) for x in (b"payload xx!", b"payload 999", b"payload 064", b"payload 192", b"payload    ", b"payload -64", b"payload 127")]
    media = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate([good, factors, huge, *other])], "doc_id long, media binary")
    got = {r.doc_id: (r.width, r.payload_bytes, r.feature is None) for r in M.describe(media, kept=()).collect()}
    assert got[0] == (16, 128, False) and got[1] == got[2] == (None, None, True)
    assert all(got[i] == (16, None, False) for i in range(3, 10))


@pytest.mark.parametrize("seed", range(40))
def test_broken_bytes_raise_nothing_else(seed):
    draw = np.random.default_rng(seed)
    image = bytearray(plain_jpeg([random_blocks(draw, 6)], 3, 2, restart=2))
    for _ in range(draw.integers(1, 6)):
        image[draw.integers(2, len(image))] = draw.integers(0, 256)
    try:
        M.decode([bytes(image)])
    except (M.JpegError, ArithmeticError, LookupError, struct.error, ValueError):
        pass


def plainly(image):
    """(width, height, feature) of a gray image with a block for each restart interval, bit by bit."""
    at, tables, size, quant = 2, {}, None, None
    while True:
        kind, n = image[at + 1], int.from_bytes(image[at + 2 : at + 4], "big")
        body, at = image[at + 4 : at + 2 + n], at + 2 + n
        if kind == 0xC0:
            size = int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big")
        elif kind == 0xDB:
            quant = body[1]
        elif kind == 0xC4:
            while body:
                counts, symbols, code, place = body[1:17], body[17:], 0, 0
                for bits in range(16):
                    for _ in range(counts[bits]):
                        tables[body[0], format(code, f"0{bits + 1}b")] = symbols[place]
                        code, place = code + 1, place + 1
                    code <<= 1
                body = symbols[place:]
        elif kind == 0xDA:
            break
    pieces, raw, i = [b""], image[at:-2], 0
    while i < len(raw):
        if raw[i] == 0xFF and raw[i + 1] == 0:
            pieces[-1] += b"\xff"
            i += 2
        elif raw[i] == 0xFF:
            pieces.append(b"")
            i += 2
        else:
            pieces[-1] += raw[i : i + 1]
            i += 1
    pixels = []
    for piece in pieces:
        bits = "".join(format(b, "08b") for b in piece)
        n = next(k for k in range(1, 17) if (0, bits[:k]) in tables)
        wide = tables[0, bits[:n]]
        value = int(bits[n : n + wide], 2) if wide else 0
        value = value if not wide or value >> (wide - 1) else value - (1 << wide) + 1
        pixels.append(min(255, max(0, (value * quant + 4) // 8 + 128)))
    w, h = size
    rows = [pixels[k : k + w // 8] for k in range(0, len(pixels), w // 8)]
    cuts = lambda n: [(k * n // 8, max((k + 1) * n // 8 if k < 7 else n, k * n // 8 + 1)) for k in range(8)]
    cells = [[x for r in rows[a:b] for x in r[c:d]] for a, b in cuts(len(rows)) for c, d in cuts(len(rows[0]))]
    means = [sum(c) / len(c) for c in cells]
    bits = "".join("1" if m > sum(means) / 64 + 1e-9 else "0" for m in means)
    return w, h, f"{w}x{h}-{int(bits, 2):016x}-{zlib.crc32(bytes(x for r in rows for x in r)):08x}"


def test_the_querys_features_by_a_plain_decoder(spark):
    from tallyspark.llm import queries

    media = {r.doc_id: bytes(r.media) for r in M.to_jpeg(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()}
    rows = queries.op5_jpeg_media(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(media) > 100
    for r in rows:
        assert (r.width, r.height, r.feature) == plainly(media[r.doc_id]) and r.media_bytes == len(media[r.doc_id])


def padded(text):
    out = np.zeros(max(-(-len(text) // 64), 1) * 64, np.uint8)
    out[: len(text)] = text
    return out


@pytest.mark.parametrize("size", [1, 63, 64, 65, 640, 4096, 5000, 70_001])
@pytest.mark.parametrize("window", [64, 700, 1 << 20])
def test_long_texts_make_the_same_image(size, window):
    text = np.random.default_rng(size).integers(0, 256, size).astype(np.uint8)
    whole = padded(text)
    image = M.encode_payloads(whole, np.array([0, len(whole)]))[0]
    assert M.encode_long(text, window).to_pybytes() == image
    raw = np.frombuffer(image, np.uint8)
    one = M.decode([image])[0]
    want = (len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:].tobytes()), len(image), hashlib.sha256(image).hexdigest(), f"{one.header.width}x{one.header.height}-{M.thumbnail_hash(one.thumbnail)}", one.header.width, one.header.height)
    assert M.read_long(raw, window) == want
    for broken in (image[:-90], image[:300], image[:-2] + b"\0" * 5000 + image[-2:], image[:400] + image[470:], b"\xff\xd8 no image" * 30):
        found = M.read_long(np.frombuffer(broken, np.uint8), window)
        try:
            M.decode([broken])
        except Exception:
            assert found[:3] == (None, None, None) and found[3] == len(broken) and found[5] is None
        else:
            assert found[3] == len(broken)


def test_windows_of_other_images_with_restarts():
    draw = np.random.default_rng(4)
    image = plain_jpeg([random_blocks(draw, 48)], 8, 6, restart=5)
    one = M.decode([image])[0]
    head, at = M.parse(image)
    for window in (100, 400, 10**6):
        assert np.array_equal(np.concatenate(list(M.decode_windows(head, np.frombuffer(image, np.uint8)[at:], window))), one.blocks)
    assert M.read_long(np.frombuffer(plain_jpeg([random_blocks(draw, 4)], 2, 2), np.uint8)) is None


MEMORY = """
import resource, sys
import numpy as np, pyarrow as pa
from tallyspark.llm import jpeg_media as M
text = np.frombuffer(b"some words of a very long text, " * (100 << 15), np.uint8)
image = M.encode_long(text)
found = M.read_long(np.frombuffer(image, np.uint8))
assert found[0] == len(text) and found[5]
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


def test_a_text_of_100_mb_stays_below_500_mb():
    import subprocess
    import sys

    done = subprocess.run([sys.executable, "-c", MEMORY], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.split()[-1]) < 500
