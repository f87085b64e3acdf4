"""Bitmaps as columns: RGB bytes with a width and a height, encoded, decoded and changed over Arrow batches."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BITMAP = "struct<width:int,height:int,data:binary>"
PNG = b"\x89PNG\r\n\x1a\n"


def encode_ppm(p: np.ndarray) -> bytes:
    return b"P6\n%d %d\n255\n" % (p.shape[1], p.shape[0]) + p.tobytes()


def decode_ppm(data: bytes) -> np.ndarray:
    kind, width, height, most, body = data.split(maxsplit=3)[0], *data.split(maxsplit=3)[1:3], *data.split(maxsplit=3)[3].split(b"\n", 1)
    if kind != b"P6" or most != b"255":
        raise ValueError("PPM")
    return np.frombuffer(body, np.uint8, int(width) * int(height) * 3).reshape(int(height), int(width), 3)


def encode_bmp(p: np.ndarray) -> bytes:
    """24 bits, rows from the bottom up, each filled to four bytes."""
    h, w = p.shape[:2]
    row = -(-3 * w // 4) * 4
    out = np.zeros((h, row), np.uint8)
    out[:, : 3 * w] = p[::-1, :, ::-1].reshape(h, 3 * w)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + h * row, 0, 0, 54, 40, w, h, 1, 24, 0, h * row, 2835, 2835, 0, 0) + out.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    start, w, h, bits = struct.unpack_from("<I", data, 10)[0], *struct.unpack_from("<ii", data, 18), struct.unpack_from("<H", data, 28)[0]
    if data[:2] != b"BM" or bits != 24:
        raise ValueError("BMP")
    row = -(-3 * w // 4) * 4
    rows = np.frombuffer(data, np.uint8, abs(h) * row, start).reshape(abs(h), row)[:, : 3 * w].reshape(abs(h), w, 3)[:, :, ::-1]
    return rows[::-1] if h > 0 else rows


def encode_png(p: np.ndarray) -> bytes:
    """8 bits a channel, grey, RGB or RGBA, rows unfiltered."""
    h, w, c = p.shape
    raw = np.zeros((h, 1 + w * c), np.uint8)
    raw[:, 1:] = p.reshape(h, w * c)
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return PNG + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)) + part(b"IDAT", zlib.compress(raw.tobytes())) + part(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    from vellum.functions.codecs import predictor_decode

    if data[:8] != PNG:
        raise ValueError("PNG")
    at, body, head = 8, b"", ()
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"IHDR":
            head = struct.unpack_from(">IIBBBBB", data, at + 8)
        elif kind == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += 12 + n
    w, h, bits, color, _, _, interlaced = head
    if bits != 8 or interlaced or color not in (0, 2, 6):
        raise ValueError("PNG kind")
    c = {0: 1, 2: 3, 6: 4}[color]
    return np.frombuffer(predictor_decode(zlib.decompress(body), 15, c, w), np.uint8).reshape(h, w, c)


ENCODE: dict[str, Callable[[np.ndarray], bytes]] = {"ppm": encode_ppm, "bmp": encode_bmp, "png": encode_png}
DECODE: dict[str, Callable[[bytes], np.ndarray]] = {"ppm": decode_ppm, "bmp": decode_bmp, "png": decode_png}


def pixels(width: int, height: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, len(data) // max(1, width * height))


def grayscale(p: np.ndarray) -> np.ndarray:
    g = np.floor(p[:, :, :3].astype(float) @ [0.2126, 0.7152, 0.0722] + 0.5).astype(np.uint8)
    return np.repeat(g[:, :, None], 3, axis=2)


def resize(p: np.ndarray, width: int, height: int) -> np.ndarray:
    """The nearest pixel."""
    return p[np.arange(height) * p.shape[0] // height][:, np.arange(width) * p.shape[1] // width]


def blend(over: np.ndarray, under: np.ndarray, mode: str) -> np.ndarray:
    """Separable blend modes on channels in 0..1."""
    s, b = over / 255.0, under / 255.0
    out = {
        "Normal": lambda: s, "Multiply": lambda: s * b, "Screen": lambda: s + b - s * b, "Darken": lambda: np.minimum(s, b), "Lighten": lambda: np.maximum(s, b), "Difference": lambda: np.abs(s - b), "Exclusion": lambda: s + b - 2 * s * b,
        "HardLight": lambda: np.where(s <= 0.5, 2 * s * b, 1 - 2 * (1 - s) * (1 - b)), "Overlay": lambda: np.where(b <= 0.5, 2 * s * b, 1 - 2 * (1 - s) * (1 - b)),
        "ColorDodge": lambda: np.where(b == 0, 0.0, np.minimum(1.0, b / np.maximum(1 - s, 1e-12))), "ColorBurn": lambda: np.where(b == 1, 1.0, 1 - np.minimum(1.0, (1 - b) / np.maximum(s, 1e-12))),
    }[mode]()
    return np.floor(out * 255 + 0.5).astype(np.uint8)


CHANGES: dict[str, Callable[..., np.ndarray]] = {
    "flip_horizontal": lambda p: p[:, ::-1], "flip_vertical": lambda p: p[::-1], "rotate": lambda p, turns=1: np.rot90(p, -turns), "grayscale": grayscale, "resize": resize,
    "crop": lambda p, x, y, w, h: p[y : y + h, x : x + w],
}


def encode(bitmap: Column, kind: str) -> Column:
    @F.pandas_udf("binary")
    def run(b: pd.DataFrame) -> pd.Series:
        return pd.Series([None if d is None else ENCODE[kind](pixels(w, h, bytes(d))) for w, h, d in zip(b["width"], b["height"], b["data"], strict=True)])

    return run(bitmap)


def decode(data: Column, kind: str) -> Column:
    @F.pandas_udf(BITMAP)
    def run(s: pd.Series) -> pd.DataFrame:
        out = [DECODE[kind](bytes(x)) for x in s]
        return pd.DataFrame({"width": [p.shape[1] for p in out], "height": [p.shape[0] for p in out], "data": [np.ascontiguousarray(p).tobytes() for p in out]})

    return run(data)


def change(bitmap: Column, what: str, *args: int) -> Column:
    @F.pandas_udf(BITMAP)
    def run(b: pd.DataFrame) -> pd.DataFrame:
        out = [CHANGES[what](pixels(w, h, bytes(d)), *args) for w, h, d in zip(b["width"], b["height"], b["data"], strict=True)]
        return pd.DataFrame({"width": [p.shape[1] for p in out], "height": [p.shape[0] for p in out], "data": [np.ascontiguousarray(p).tobytes() for p in out]})

    return run(bitmap)


def blended(over: Column, under: Column, mode: str) -> Column:
    """The bytes of two bitmaps of one size, blended."""

    @F.pandas_udf("binary")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([blend(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8), mode).tobytes() for x, y in zip(a, b, strict=True)])

    return run(over, under)


def count_dark(pixels: np.ndarray) -> int:
    """Pixels (their channels last) all of whose first three channels are below 128."""
    dark = pixels[..., 0] < 128
    for k in range(1, min(3, pixels.shape[-1])):
        dark &= pixels[..., k] < 128
    return int(np.count_nonzero(dark))


def dark_pixels(bitmap: Column, channels: int = 3) -> Column:
    """Pixels all of whose channels are below 128."""

    @F.pandas_udf("bigint")
    def run(b: pd.DataFrame) -> pd.Series:
        return pd.Series([count_dark(np.frombuffer(d, np.uint8).reshape(-1, channels)) for d in b["data"]])

    return run(bitmap)


def has_transparency(data: Column) -> Column:
    """Whether any alpha of RGBA bytes is below 255."""

    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda d: bool((np.frombuffer(d, np.uint8)[3::4] < 255).any()))

    return run(data)
