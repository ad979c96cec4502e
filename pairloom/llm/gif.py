"""Media columns: GIF files with timed frames and colour histograms.

The decoder reads any GIF: LZW code streams with early or deferred clear codes, global and local
palettes, interlacing, transparency, and the disposal of each frame before the next one is drawn.
A code stream is decoded a segment (from one clear code to the next) at a time: code widths depend
only on the place in the segment, so all its codes are cut out at once, and every entry of the code
table is a piece of what the segment has already given, so references are followed by pointer jumping.

The encoder stores bytes without loss as pixels of a grey palette, `WIDTH` to a row and `ROWS` rows to
a frame, with a real LZW dictionary.

Defined cases: null counts as empty; an empty text is stored as one row of spaces; equal texts give
equal files; an empty table gives an empty result; other columns are ignored. A broken file raises
ValueError.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import map_texts

WIDTH, ROWS, DELAY = 192, 256, 10
#: Fixed values of the format.
EXTENSION, IMAGE, TRAILER, CONTROL = 0x21, 0x2C, 0x3B, 0xF9
MOST_BITS = 12
GREYS = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()


def _widths(n: int, depth: int, start: int = 0) -> np.ndarray:
    """Bits of the codes number start, start + 1, ... after a clear code."""
    last = (1 << depth) + 1 + np.arange(start, start + n)
    return np.clip(np.floor(np.log2(last)).astype(np.int64) + 1, depth + 1, MOST_BITS)


_WIDTHS = {depth: _widths(1 << MOST_BITS, depth) for depth in range(1, 9)}


def lzw_encode(data: bytes, depth: int = 8) -> bytes:
    """Code stream of one image, without its block structure."""
    clear, most = 1 << depth, 1 << MOST_BITS
    first = clear + 2
    codes, cuts = [clear], [1]  # cuts: where a segment's numbering starts anew
    table: dict[int, int] = {}
    if data:
        known, emit, free, now = table.get, codes.append, first, data[0]
        for byte in memoryview(data)[1:]:
            key = now << 8 | byte
            if (code := known(key)) is not None:
                now = code
                continue
            emit(now)
            table[key] = free
            free += 1
            now = byte
            if free == most:
                emit(clear)
                cuts.append(len(codes))
                table.clear()
                free = first
        emit(now)
    codes.append(clear + 1)
    widths = np.concatenate([[depth + 1], *(_WIDTHS[depth][: b - a] for a, b in zip(cuts, [*cuts[1:], len(codes)]))])
    bits = np.arange(MOST_BITS)
    grid = (np.array(codes)[:, None] >> bits & 1).astype(bool)
    return np.packbits(grid[bits < widths[:, None]], bitorder="little").tobytes()


def lzw_decode(data: bytes, depth: int, size: int) -> np.ndarray:
    """The `size` pixels of a code stream."""
    clear, end = 1 << depth, (1 << depth) + 1
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.int64)
    words = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    out, have, at, total = [], 0, 0, 8 * len(data)
    while have < size:
        codes, place = [], 0
        while True:  # the codes of one segment
            widths = _WIDTHS[depth] if not place else np.full(1 << MOST_BITS, MOST_BITS)
            stops = at + np.cumsum(widths)
            starts = stops - widths
            starts = starts[stops <= total]
            if not len(starts):
                raise ValueError("the code stream ends early")
            got = words[starts >> 3] >> (starts & 7) & ((1 << widths[: len(starts)]) - 1)
            marks = np.flatnonzero((got == clear) | (got == end))
            if len(marks):
                n = int(marks[0])
                codes.append(got[:n])
                at, ended = int(stops[n]), got[n] == end
                break
            codes.append(got)
            at, place, ended = int(stops[len(starts) - 1]), place + len(starts), False
            if len(starts) < len(widths) and at + MOST_BITS > total:
                ended = True  # no end code
                break
        code = np.concatenate(codes)
        if len(code):
            pixels = _expand(code, clear)
            out.append(pixels)
            have += len(pixels)
        if ended:
            break
    found = np.concatenate(out) if out else np.zeros(0, np.uint8)
    if len(found) < size:
        raise ValueError("too few pixels in the code stream")
    return found[:size]


def _expand(code: np.ndarray, clear: int) -> np.ndarray:
    """Pixels of a segment. Entry clear + 2 + j is what code j gave and one pixel more."""
    n, back = len(code), code - (clear + 2)
    if (back >= np.arange(n)).any():
        raise ValueError("a code that is not in the table")
    literal = back < 0
    if literal.all():
        return code.astype(np.uint8)
    # length: steps on the way to the earlier code that up leads to
    up, length = np.where(literal, np.arange(n), back), np.where(literal, 0, 1)
    while not literal[up].all():
        length = length + length[up]
        up = up[up]
    length += 1
    start = np.cumsum(length) - length
    owner = np.repeat(np.arange(n), length)
    place = np.arange(len(owner))
    from_ = np.where(literal[owner], place, start[np.maximum(back, 0)][owner] + place - start[owner])
    while True:
        further = from_[from_]
        if (further == from_).all():
            break
        from_ = further
    return code[owner[from_]].astype(np.uint8)


def _blocks(data: bytes) -> bytes:
    """data in blocks of up to 255 bytes, each with its length before it, and the closing empty block."""
    whole = len(data) // 255 * 255
    grid = np.frombuffer(data[:whole], np.uint8).reshape(-1, 255)
    head = np.concatenate([np.full((len(grid), 1), 255, np.uint8), grid], 1).tobytes()
    rest = data[whole:]
    return head + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def encode_gif(payload: bytes, width: int = WIDTH, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """payload, a positive multiple of `width` bytes, as the pixels of one or more grey frames."""
    if not payload or len(payload) % width:
        raise ValueError(f"the payload has to be a positive multiple of {width}")
    lines = len(payload) // width
    parts = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, lines), 0xF7, 0, 0), GREYS]
    for at in range(0, lines, rows):
        n = min(rows, lines - at)
        parts.append(struct.pack("<BBBBHBB", EXTENSION, CONTROL, 4, 1 << 2, delay, 0, 0))
        parts.append(struct.pack("<BHHHHBB", IMAGE, 0, 0, width, n, 0, 8))
        parts.append(_blocks(lzw_encode(payload[at * width : (at + n) * width])))
    return b"".join(parts) + bytes([TRAILER])


@dataclass
class Frame:
    delay: int
    left: int
    top: int
    width: int
    height: int
    disposal: int
    #: What is shown while the frame lasts: rows, columns, red green blue and opacity (0 or 255).
    canvas: np.ndarray

    def histogram(self) -> np.ndarray:
        """Visible pixels by colour, four levels each of red, green and blue: 64 counts."""
        shown = self.canvas[self.canvas[..., 3] > 0]
        levels = shown[:, :3].astype(np.int64) >> 6
        return np.bincount(levels[:, 0] << 4 | levels[:, 1] << 2 | levels[:, 2], minlength=64)

    def drawn(self) -> np.ndarray:
        """The part of the canvas that this frame has drawn on."""
        return self.canvas[self.top : self.top + self.height, self.left : self.left + self.width]


def _read_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def decode_gif(data: bytes) -> Iterator[Frame]:
    """The frames of a file, in order, drawn one over the other."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    try:
        yield from _frames(data)
    except (IndexError, struct.error) as e:
        raise ValueError("the file ends early") from e


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    n = 2 << (flags & 7)
    colours = np.zeros((256, 3), np.uint8)
    colours[:n] = np.frombuffer(data[at : at + 3 * n], np.uint8).reshape(n, 3)
    return colours, at + 3 * n


def _frames(data: bytes) -> Iterator[Frame]:
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    shared, at = _palette(data, 13, flags)
    canvas = np.zeros((height, width, 4), np.uint8)
    delay = disposal = 0
    clear_index = None
    while (kind := data[at]) != TRAILER:
        if kind == EXTENSION:
            label = data[at + 1]
            body, at = _read_blocks(data, at + 2)
            if label == CONTROL:
                bits, delay, index = struct.unpack_from("<BHB", body)
                disposal, clear_index = bits >> 2 & 7, index if bits & 1 else None
            continue
        if kind != IMAGE:
            raise ValueError(f"unknown block {kind:#x}")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        own, at = _palette(data, at + 10, flags)
        depth = data[at]
        stream, at = _read_blocks(data, at + 1)
        pixels = lzw_decode(stream, depth, w * h).reshape(h, w)
        if flags & 0x40:  # rows come as every 8th, the 8ths between, the 4ths between, the odd ones
            rows = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
            pixels = pixels[np.argsort(rows)]
        colours = own if own is not None else shared
        if colours is None:
            raise ValueError("no palette")
        before = canvas.copy() if disposal == 3 else None
        canvas = canvas.copy()
        box = canvas[top : top + h, left : left + w]
        pixels = pixels[: box.shape[0], : box.shape[1]]
        drawn = np.concatenate([colours[pixels], np.full((*pixels.shape, 1), 255, np.uint8)], 2)
        if clear_index is None:
            box[:] = drawn
        else:
            seen = pixels != clear_index
            box[seen] = drawn[seen]
        yield Frame(delay, left, top, w, h, disposal, canvas)
        if disposal == 2:
            canvas = canvas.copy()
            canvas[top : top + h, left : left + w] = 0
        elif disposal == 3:
            canvas = before
        delay = disposal = 0
        clear_index = None


def payload_of(text: str) -> tuple[int, bytes]:
    """Length in UTF-8, and the bytes filled up with spaces to a positive multiple of WIDTH."""
    raw = text.encode("utf-8", "replace")
    return len(raw), raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b" ")


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: every text as a GIF file."""

    def work(texts: list[str]) -> list:
        payloads = [payload_of(t) for t in texts]
        return [[n for n, _ in payloads], [encode_gif(p) for _, p in payloads]]

    return map_texts(docs, work, "doc_id long, n_bytes long, media binary", id_col, text_col)


def media_frames(stored: DataFrame, payload: bool = False, media_col: str = "media") -> DataFrame:
    """stored with `frames`: delay, box, disposal and 64-bin colour histogram of each frame.

    payload: also `payload`, the red samples of what each frame has drawn, laid end to end, and no
    media column. A null file has null frames.
    """
    frame = "struct<delay:int,left:int,top:int,width:int,height:int,disposal:int,histogram:array<long>>"
    kept = [c for c in stored.columns if c not in ("frames", "payload")]
    kinds = dict(stored.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), f"frames array<{frame}>", *(["payload binary"] if payload else [])])

    def one(data: bytes | None):
        if data is None:
            return None, None
        out, samples = [], []
        for f in decode_gif(data):
            out.append({"delay": f.delay, "left": f.left, "top": f.top, "width": f.width, "height": f.height, "disposal": f.disposal, "histogram": f.histogram()})
            if payload:
                samples.append(f.drawn()[..., 0].tobytes())
        return out, b"".join(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([*((n, pa.int32()) for n in ("delay", "left", "top", "width", "height", "disposal")), ("histogram", pa.list_(pa.int64()))]))
        for batch in batches:
            if batch.num_rows:
                read = [one(d) for d in batch.column(media_col).to_pylist()]
                more = [pa.array([x for x, _ in read], kind), *([pa.array([x for _, x in read], pa.binary())] if payload else [])]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*kept, "frames", *(["payload"] if payload else [])])

    return stored.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(run, schema)


def media_digests(stored: DataFrame) -> DataFrame:
    """Digests of stored files and of what is read back from them, a row per document."""
    read = media_frames(stored, payload=True)
    total = F.aggregate("frames", F.array_repeat(F.lit(0).cast("long"), 64), lambda acc, f: F.zip_with(acc, f["histogram"], lambda a, b: a + b))
    filled = F.filter(F.transform(total, lambda n, i: F.when(n > 0, F.concat_ws(":", i, n))), lambda x: x.isNotNull())
    return read.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.lit("frames="), F.size("frames"), F.lit(";time="), F.aggregate("frames", F.lit(0), lambda s, f: s + f["delay"]), F.lit(";colours="), F.concat_ws(",", filled)).alias("feature"),
    )
