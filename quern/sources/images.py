"""Images from bytes to grids: PNG, BMP and PNM decoded with numpy, resized bilinearly with antialiasing, scaled to [0, 1].

JPEG, GIF and WebP need a codec that is not there; they, and what is no sound image, give a null image with a reason.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.grid import bilinear

#: Pixels that an image may have.
MOST_PIXELS = 89_478_485
FOREIGN = {b"\xff\xd8\xff": "jpeg", b"GIF8": "gif", b"RIFF": "webp"}
IMAGE = "struct<width:int,height:int,r:array<float>,g:array<float>,b:array<float>,reason:string>"


def _png(data: bytes) -> np.ndarray:
    at, packed, head, palette = 8, [], None, None
    while at + 12 <= len(data):
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if at + 12 + size > len(data) or zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError("broken chunk")
        if kind == b"IHDR" and size == 13:
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None or head[6]:
        raise ValueError("no header, or interlaced")
    width, height, depth, colour = head[:4]
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if channels is None or depth not in (1, 2, 4, 8, 16) or not 0 < width * height <= MOST_PIXELS:
        raise ValueError("colour type, depth or size")
    row, step = -(-width * channels * depth // 8), max(1, channels * depth // 8)
    raw = zlib.decompressobj().decompress(b"".join(packed), height * (row + 1))
    if len(raw) != height * (row + 1):
        raise ValueError("too little data")
    lines = np.frombuffer(raw, np.uint8).reshape(height, row + 1)
    out, above = np.empty((height, row), np.uint8), np.zeros(row, np.uint8)
    for y in range(height):
        above = out[y] = _line(int(lines[y, 0]), lines[y, 1:], above, step)
    if depth == 16:
        out = out[:, ::2]
    elif depth < 8:
        out = np.unpackbits(out, axis=1).reshape(height, -1, depth) @ (1 << np.arange(depth)[::-1]).astype(np.uint8)
        out = out if colour == 3 else (out * (255 // (2**depth - 1))).astype(np.uint8)
    pixels = out[:, : width * channels].reshape(height, width, channels)
    if colour == 3:
        if palette is None or pixels.max() >= len(palette):
            raise ValueError("palette")
        return palette[pixels[:, :, 0]]
    return pixels[:, :, :3] if channels >= 3 else np.repeat(pixels[:, :, :1], 3, axis=2)


def _line(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        return np.concatenate([np.cumsum(line[k::step], dtype=np.uint8)[:, None] for k in range(step)], axis=1).ravel() if len(line) % step == 0 else _slow(kind, line, above, step)
    if kind in (3, 4):
        return _slow(kind, line, above, step)
    raise ValueError(f"row filter {kind}")


def _slow(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    x, up = line.tolist(), above.tolist()
    for k in range(len(x)):
        left, corner = (x[k - step], up[k - step]) if k >= step else (0, 0)
        if kind == 1:
            guess = left
        elif kind == 3:
            guess = (left + up[k]) // 2
        else:
            p = left + up[k] - corner
            a, b, c = abs(p - left), abs(p - up[k]), abs(p - corner)
            guess = left if a <= b and a <= c else up[k] if b <= c else corner
        x[k] = (x[k] + guess) & 255
    return np.array(x, np.uint8)


def _bmp(data: bytes) -> np.ndarray:
    start, _, width, height, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if packing or bits not in (24, 32) or width <= 0 or not 0 < width * abs(height) <= MOST_PIXELS:
        raise ValueError("only plain bitmaps of 24 or 32 bits")
    row = -(-width * bits // 32) * 4
    x = np.frombuffer(data, np.uint8, row * abs(height), start).reshape(abs(height), row)[:, : width * bits // 8].reshape(abs(height), width, bits // 8)
    return (x[::-1] if height > 0 else x)[:, :, 2::-1]


def _pnm(data: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        fields.append(int(data[at:end]))
        at = end
    width, height, most = fields
    channels = 3 if data[:2] == b"P6" else 1
    if most != 255 or not 0 < width * height <= MOST_PIXELS:
        raise ValueError("only 8-bit images")
    x = np.frombuffer(data, np.uint8, width * height * channels, at + 1).reshape(height, width, channels)
    return x if channels == 3 else np.repeat(x, 3, axis=2)


def decode(data: bytes) -> np.ndarray:
    """height x width x 3 bytes; alpha is dropped and grey repeated. ValueError for everything else."""
    for mark, name in FOREIGN.items():
        if data.startswith(mark):
            raise ValueError(f"no codec for {name}")
    try:
        if data.startswith(b"\x89PNG\r\n\x1a\n"):
            return _png(data)
        if data.startswith(b"BM"):
            return _bmp(data)
        if data[:2] in (b"P5", b"P6"):
            return _pnm(data)
    except (struct.error, zlib.error, IndexError) as e:
        raise ValueError(f"broken image: {e}") from e
    raise ValueError("no image")


def _matrix(n: int, m: int) -> np.ndarray:
    out = np.zeros((m, n))
    for j, taps in enumerate(bilinear(n, m, antialias=True)):
        for i, v in taps:
            out[j, i] += v
    return out


def load(data: bytes, size: tuple[int, int] = (224, 224)) -> np.ndarray:
    """3 x height x width numbers in [0, 1] of an image resized to `size` (width, height)."""
    x = decode(data).astype(float)
    down, along = _matrix(x.shape[0], size[1]), _matrix(x.shape[1], size[0])
    return np.stack([down @ x[:, :, c] @ along.T for c in range(3)]) / 255.0


def with_image(df: DataFrame, content: str = "content", size: tuple[int, int] = (224, 224), out: str = "image") -> DataFrame:
    """Add a struct of the original width and height, the three channels' grids (row-major, size[0] wide) that the grid operators
    take, and the reason where there is none. An Arrow function over one image at a time."""

    def one(data):
        try:
            if data is None:
                raise ValueError("null")
            height, width = decode(bytes(data)).shape[:2]
            r, g, b = (c.ravel().astype(np.float32) for c in load(bytes(data), size))
            return width, height, r, g, b, None
        except ValueError as e:
            return None, None, None, None, None, str(e)

    @F.pandas_udf(IMAGE)
    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(v) for v in values], columns=["width", "height", "r", "g", "b", "reason"])

    return df.withColumn(out, run(F.col(content)))
