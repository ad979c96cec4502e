"""Grey images without an imaging library: decoding of bitmaps, resampling and contrast."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Weights of red, green and blue in a grey level.
GREY = np.array([0.299, 0.587, 0.114])


def bitmap(content: bytes) -> np.ndarray:
    """Grey levels (rows from the top) of an uncompressed bitmap of 8, 24 or 32 bits."""
    at, _, width, height, _, bits, packing = struct.unpack_from("<IIiiHHI", content, 10)
    if packing not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError(f"a bitmap of {bits} bits, packing {packing}")
    stride = -(-width * bits // 32) * 4
    rows = np.frombuffer(content, np.uint8, stride * abs(height), at).reshape(abs(height), stride)
    rows = rows[::-1] if height > 0 else rows
    if bits == 8:
        header, colours = struct.unpack_from("<I", content, 14)[0], struct.unpack_from("<I", content, 46)[0] or 256
        palette = np.frombuffer(content, np.uint8, 4 * colours, 14 + header).reshape(-1, 4)
        pixels = palette[rows[:, :width]]
    else:
        pixels = rows[:, : width * bits // 8].reshape(abs(height), width, -1)
    return np.floor(pixels[..., 2::-1] @ GREY + 0.5).astype(np.uint8)


def to_bitmap(grey: np.ndarray) -> bytes:
    """The bitmap of 8 bits of grey levels."""
    height, width = grey.shape
    stride = -(-width // 4) * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, :width] = grey[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(-1, 4).copy()
    palette[:, 3] = 0
    at = 14 + 40 + palette.size
    head = struct.pack("<2sIHHI", b"BM", at + rows.size, 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, rows.size, 0, 0, 256, 0)
    return head + palette.tobytes() + rows.tobytes()


def grey_image(content: bytes) -> np.ndarray:
    """Grey levels of an image. Bitmaps are decoded here; other formats need Pillow, which is optional."""
    if content[:2] == b"BM":
        return bitmap(content)
    try:
        from PIL import Image
    except ImportError as e:
        raise RuntimeError("decoding images other than bitmaps needs Pillow") from e
    return np.asarray(Image.open(io.BytesIO(content)).convert("L"))


def _cubic(x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    return np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0))


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)


#: Kernels and how far they reach.
KERNELS = {"bicubic": (_cubic, 2.0), "lanczos": (_lanczos, 3.0)}


def _weights(size: int, to: int, kernel: str) -> np.ndarray:
    """(to, size) weights of the old pixels in each new one; a smaller image averages over what it skips."""
    shape, reach = KERNELS[kernel]
    step = size / to
    wide = max(step, 1.0)
    centre = (np.arange(to) + 0.5) * step
    pixel = np.arange(size) + 0.5
    w = shape((pixel[None, :] - centre[:, None]) / wide) * (np.abs(pixel[None, :] - centre[:, None]) < reach * wide)
    return w / w.sum(1, keepdims=True)


def resampled(grey: np.ndarray, width: int, height: int, kernel: str = "lanczos") -> np.ndarray:
    """The image in another size."""
    rows = _weights(grey.shape[0], height, kernel) @ grey.astype(float) @ _weights(grey.shape[1], width, kernel).T
    # Halves stay halves, in whatever order the products were summed.
    return np.clip(np.floor(np.round(rows, 6) + 0.5), 0, 255).astype(np.uint8)


def enlarged(grey: np.ndarray, times: int = 3) -> np.ndarray:
    return resampled(grey, grey.shape[1] * times, grey.shape[0] * times, "bicubic")


def at_resolution(grey: np.ndarray, dpi: float, wanted: float = 500.0, tolerance: float = 0.01) -> np.ndarray:
    """The image at the wanted resolution, as it is where it is within the tolerance already."""
    if abs(dpi / wanted - 1) <= tolerance:
        return grey
    return resampled(grey, max(1, round(grey.shape[1] * wanted / dpi)), max(1, round(grey.shape[0] * wanted / dpi)))


def pixels_of_blocks(mask: np.ndarray, shape: tuple[int, int], size: int = 8) -> np.ndarray:
    """Which pixels lie in the blocks of a mask, cut to the image."""
    return mask.repeat(size, 0).repeat(size, 1)[: shape[0], : shape[1]]


def resized(found: DataFrame, width: int, height: int, kernel: str) -> DataFrame:
    """image, pixels (grey levels row by row) of images (image, bytes) in another size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"image": pdf["image"], "pixels": [resampled(grey_image(b), width, height, kernel).ravel().tolist() for b in pdf["bytes"]]})

    return found.select("image", "bytes").mapInPandas(run, f"image {dict(found.dtypes)['image']}, pixels array<int>")


def as_bitmaps(found: DataFrame, side: int) -> DataFrame:
    """image, bytes: square bitmaps of images (image, pixels)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"image": pdf["image"], "bytes": [to_bitmap(np.asarray(p, np.uint8).reshape(-1, side)) for p in pdf["pixels"]]})

    return found.select("image", "pixels").mapInPandas(run, f"image {dict(found.dtypes)['image']}, bytes binary")
