import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from pairloom.llm import gif


@pytest.mark.parametrize("depth", [2, 5, 8])
def test_lzw_round_trip(depth):
    rng = random.Random(depth)
    for n in (1, 2, 5, 600, 5000, 60_000):
        for top in (1, 2, 1 << depth):
            data = bytes(rng.randrange(top) for _ in range(n))
            assert gif.lzw_decode(gif.lzw_encode(data, depth), depth, n).tobytes() == data
    run = b"\0" * 100_000
    assert gif.lzw_decode(gif.lzw_encode(run, depth), depth, len(run)).tobytes() == run


def test_lzw_known_stream():
    """The well-known ten by ten sample image: a code stream made by another encoder."""
    stream = bytes.fromhex("8c2d99872a1cdc33a00275ec95faa8de608c04914c01")
    pixels = gif.lzw_decode(stream, 2, 100).reshape(10, 10)
    assert pixels[0].tolist() == [1, 1, 1, 1, 1, 2, 2, 2, 2, 2]
    assert pixels[9].tolist() == [2, 2, 2, 2, 2, 1, 1, 1, 1, 1]
    assert pixels[4].tolist() == [1, 1, 1, 0, 0, 0, 0, 2, 2, 2]


def codes_to_bytes(codes, depth):
    """Bits of codes, widths counted as a reader does; no clear code on a full table (a deferred clear)."""
    out = bits = n = 0
    free, width = (1 << depth) + 2, depth + 1
    parts = []
    after_clear = False
    for c in codes:
        out |= c << bits
        bits += width
        n += 1
        if c == 1 << depth:
            free, width, after_clear = (1 << depth) + 2, depth + 1, True
            continue
        if after_clear:
            after_clear = False
        elif free < 4096:
            free += 1
        if free == 1 << width and width < 12:
            width += 1
    while bits > 0:
        parts.append(out & 255)
        out >>= 8
        bits -= 8
    return bytes(parts)


def test_deferred_clear():
    data = [k * 7 % 251 for k in range(9000)]  # single pixels only, far beyond a full table
    stream = codes_to_bytes([256, *data, 257], 8)
    assert gif.lzw_decode(stream, 8, len(data)).tolist() == data


def test_broken_files():
    good = gif.encode_gif(b"x" * 192)
    for bad in (b"", b"GIF00a" + good[6:], good[:100], good[:-5]):
        with pytest.raises(ValueError):
            list(gif.decode_gif(bad))
    with pytest.raises(ValueError):
        gif.encode_gif(b"x")


PALETTE = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])  # black, red, green, blue
BLACK, RED, GREEN, BLUE = ((0, 0, 0, 255), (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255))
NOTHING = (0, 0, 0, 0)


def image(pixels, left=0, top=0, disposal=0, clear=None, delay=0, palette=None, interlaced=False):
    pixels = np.array(pixels, np.uint8)
    h, w = pixels.shape
    stored = pixels
    if interlaced:
        stored = pixels[[*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]]
    head = struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (clear is not None), delay, clear or 0, 0)
    flags = (0x81 if palette else 0) | (0x40 if interlaced else 0)
    return head + struct.pack("<BHHHHB", 0x2C, left, top, w, h, flags) + (palette or b"") + bytes([2]) + gif._blocks(gif.lzw_encode(stored.tobytes(), 2))


def picture(w, h, *images, palette=PALETTE):
    comment = b"\x21\xfe\x05hello\x00"
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0x81 if palette else 0, 0, 0) + (palette or b"") + comment + b"".join(images) + b"\x3b"


def shown(frame):
    return [[tuple(int(x) for x in p) for p in row] for row in frame.canvas]


def test_disposal_and_transparency():
    whole = image([[1, 1], [1, 1]], disposal=1, delay=5)
    previous = image([[2]], disposal=3, delay=7)
    background = image([[3]], left=1, top=1, disposal=2)
    holes = image([[2, 0], [0, 2]], clear=0)
    frames = list(gif.decode_gif(picture(2, 2, whole, previous, background, holes)))
    assert [shown(f) for f in frames] == [
        [[RED, RED], [RED, RED]],
        [[GREEN, RED], [RED, RED]],
        [[RED, RED], [RED, BLUE]],
        [[GREEN, RED], [RED, GREEN]],
    ]
    assert [(f.delay, f.disposal) for f in frames] == [(5, 1), (7, 3), (0, 2), (0, 0)]
    cleared = list(gif.decode_gif(picture(2, 2, whole, background, image([[2]], clear=0))))[-1]
    assert shown(cleared) == [[GREEN, RED], [RED, NOTHING]]
    counts = cleared.histogram()
    assert counts.sum() == 3 and counts[0b110000] == 2 and counts[0b001100] == 1


def test_local_palette_interlacing_and_cropping():
    local = bytes([9, 9, 9, 8, 8, 8, 7, 7, 7, 6, 6, 6])
    rows = [[k % 4] for k in range(20)]
    (frame,) = gif.decode_gif(picture(1, 20, image(rows, palette=local, interlaced=True), palette=None))
    assert [int(r[0][0]) for r in frame.canvas] == [9 - k % 4 for k in range(20)]
    (frame,) = gif.decode_gif(picture(2, 2, image([[1] * 3] * 3, left=1, top=1)))
    assert shown(frame) == [[NOTHING, NOTHING], [NOTHING, RED]]
    with pytest.raises(ValueError, match="palette"):
        list(gif.decode_gif(picture(1, 1, image([[1]]), palette=None)))


def test_payload_round_trip(make_docs, odd):
    docs = make_docs(odd, clashes=True)
    rows = gif.media_digests(gif.media(docs)).collect()
    assert len(rows) == len(odd)
    by_text = {}
    for i, t in odd:
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (192 if not raw else 0))
        by_text[len(raw), hashlib.sha256(payload).hexdigest(), len(payload), zlib.crc32(payload[-16:])] = raw
    for r in rows:
        assert (r.n_bytes, r.payload_sha256, r.payload_bytes, r.tail_crc32) in by_text
        assert r.media_bytes > 0 and len(r.media_sha256) == 64 and r.feature.startswith("frames=")
    assert gif.media_digests(gif.media(docs.limit(0))).count() == 0


def test_timed_frames(spark):
    data = gif.encode_gif(bytes(192 * 300), delay=3)
    df = spark.createDataFrame([(1, bytearray(data)), (2, None)], "doc_id long, media binary")
    rows = {r.doc_id: r for r in gif.media_frames(df).collect()}
    assert [(f.delay, f.height, sum(f.histogram)) for f in rows[1].frames] == [(3, 256, 192 * 256), (3, 44, 192 * 256)]
    assert rows[2].frames is None
