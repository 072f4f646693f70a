"""Media columns: lossless PNG in binary columns, read back with checksum tests, and low-frequency cosine hashes.

Encoder and decoder are written on zlib and numpy: 8-bit greyscale or RGB, no interlace, all five row filters.
Nulls: a null payload is stored as the empty text is (one row of spaces); a null image decodes to null. Bytes that are no sound
PNG, or a chunk whose checksum fails, raise ValueError in `decode_png`; `read_media` turns that into null. What an image
unpacks to is bounded by its header, and the header by `most`. Null ids and repeated rows pass through, an empty
table gives no rows, very long texts are one tall image, and other columns stay whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: 64 RGB pixels: one row of samples. Payloads are padded to whole rows.
ROW_BYTES = 192
CHANNELS = 3


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def filter_rows(samples: np.ndarray, bpp: int, kind: int) -> np.ndarray:
    """Apply row filter `kind` (0 none, 1 sub, 2 up, 3 average, 4 Paeth) to every row."""
    x = samples.astype(np.int16)
    left = np.zeros_like(x)
    left[:, bpp:] = x[:, :-bpp]
    up = np.zeros_like(x)
    up[1:] = x[:-1]
    if kind == 0:
        out = x
    elif kind == 1:
        out = x - left
    elif kind == 2:
        out = x - up
    elif kind == 3:
        out = x - (left + up) // 2
    else:
        corner = np.zeros_like(x)
        corner[1:, bpp:] = x[:-1, :-bpp]
        out = x - _paeth(left, up, corner)
    return out.astype(np.uint8)


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    pa_, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))


def unfilter_rows(kinds: np.ndarray, rows: np.ndarray, bpp: int) -> np.ndarray:
    """Undo the row filters. Runs of rows of the kinds none, sub and up are undone at once, others row by row."""
    out = np.empty_like(rows)
    n, width = rows.shape
    y = 0
    while y < n:
        kind = int(kinds[y])
        end = y + 1
        while end < n and kinds[end] == kind:
            end += 1
        if kind == 0:
            out[y:end] = rows[y:end]
        elif kind == 1:
            out[y:end] = np.cumsum(rows[y:end].reshape(end - y, width // bpp, bpp), axis=1, dtype=np.uint8).reshape(end - y, width)
        elif kind == 2:
            first = out[y - 1] if y else np.zeros(width, np.uint8)
            out[y:end] = np.cumsum(rows[y:end], axis=0, dtype=np.uint8) + first
        elif kind in (3, 4):
            for r in range(y, end):
                up = (out[r - 1] if r else np.zeros(width, np.uint8)).astype(np.int16)
                left, corner = np.zeros(bpp, np.int16), np.zeros(bpp, np.int16)
                for x in range(0, width, bpp):
                    above = up[x : x + bpp]
                    guess = (left + above) // 2 if kind == 3 else _paeth(left, above, corner)
                    left = (rows[r, x : x + bpp] + guess) & 255
                    out[r, x : x + bpp] = left
                    corner = above
        else:
            raise ValueError(f"row filter {kind}")
        y = end
    return out


def encode_png(samples: np.ndarray, channels: int = CHANNELS, level: int = 1) -> bytes:
    """samples: rows of bytes, channels interleaved. Each image takes the filter whose sample of rows has the least sum
    of absolute residuals, a rule that only looks at the image, so equal payloads give equal bytes."""
    height, width = samples.shape
    probe = samples[:: max(1, height // 8)]
    cost = [int(np.abs(filter_rows(probe, channels, k).view(np.int8).astype(np.int32)).sum()) if k else int(probe.sum(dtype=np.int64)) for k in (0, 1, 2)]
    kind = int(np.argmin(cost))
    body = np.empty((height, width + 1), np.uint8)
    body[:, 0], body[:, 1:] = kind, filter_rows(samples, channels, kind)
    header = struct.pack(">IIBBBBB", width // channels, height, 8, 2 if channels == 3 else 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(body.tobytes(), level)) + _chunk(b"IEND", b"")


#: Bytes that a foreign image may unpack to.
MOST = 1 << 28


def decode_png(data: bytes, most: int = 2**31 - 1) -> tuple[np.ndarray, int]:
    """(rows of samples, channels). Every chunk's checksum is tested; an image of more than `most` bytes is not unpacked."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, packed, head, ended = 8, [], None, False
    while at + 12 <= len(data) and not ended:
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(data) < at + 12 + size or struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"checksum of chunk {kind!r}")
        if kind == b"IHDR":
            if size != 13:
                raise ValueError("size of the header")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended, at = kind == b"IEND", at + 12 + size
    if head is None or not ended or head[2] != 8 or head[3] not in (0, 2) or head[6]:
        raise ValueError("no 8-bit greyscale or RGB image without interlace")
    channels = 3 if head[3] == 2 else 1
    width, height = head[0] * channels, head[1]
    size = height * (width + 1)
    if not 0 < size <= most:
        raise ValueError("size of the image")
    unpack = zlib.decompressobj()
    try:
        raw = np.frombuffer(unpack.decompress(b"".join(packed), size + 1), np.uint8)
        if len(raw) == size and not unpack.eof:  # the stream's own checksum may be left to read
            raw = np.concatenate((raw, np.frombuffer(unpack.decompress(unpack.unconsumed_tail, 1), np.uint8)))
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if len(raw) != size or not unpack.eof:
        raise ValueError("size of the image data")
    raw = raw.reshape(height, width + 1)
    return unfilter_rows(raw[:, 0], raw[:, 1:], channels), channels


def _shrink(n: int, to: int) -> np.ndarray:
    """to x n matrix of area means."""
    edges = np.arange(to + 1) * (n / to)
    cells = np.arange(n)
    part = np.minimum(edges[1:, None], cells[None] + 1) - np.maximum(edges[:-1, None], cells[None])
    part = np.clip(part, 0, None)
    return part / part.sum(axis=1, keepdims=True)


_k = np.arange(32)
_COS = np.cos(np.pi * (2 * _k[None] + 1) * np.arange(8)[:, None] / 64)


def cosine_hash(samples: np.ndarray, channels: int = CHANNELS) -> str:
    """64 bits, as 16 hex digits: the 8 x 8 lowest frequencies of the 32 x 32 area-mean greyscale, each above the median of
    all but the constant one. Coefficients are rounded first, so that sums in another order give the same bits."""
    height, width = samples.shape
    grey = samples.reshape(height, width // channels, channels).mean(axis=2)
    small = _shrink(height, 32) @ grey @ _shrink(grey.shape[1], 32).T
    low = np.round(_COS @ small @ _COS.T, 6)
    bits = (low > np.median(low.ravel()[1:])).ravel()
    return np.packbits(bits).tobytes().hex()


def pad_payload(text: bytes) -> bytes:
    return text.ljust(max(1, -(-len(text) // ROW_BYTES)) * ROW_BYTES, b" ")


def to_media(text: str | None) -> bytes:
    """A text's bytes, padded with spaces to whole rows, as a PNG of 64 RGB pixels a row."""
    return encode_png(np.frombuffer(pad_payload((text or "").encode()), np.uint8).reshape(-1, ROW_BYTES))


def store_media(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """Add a binary column of PNGs made from the texts; a narrow map, all other columns stay."""

    @F.pandas_udf("binary")
    def run(texts):
        return texts.map(to_media)

    return df.withColumn(out, run(F.col(text).cast("string")))


def read_media(df: DataFrame, media: str = "media", out: str = "payload", most: int = MOST) -> DataFrame:
    """Add the bytes that the PNG holds; null where the column is null or no sound PNG of at most `most` bytes."""

    def one(data):
        try:
            return None if data is None else decode_png(bytes(data), most)[0].tobytes()
        except ValueError:
            return None

    @F.pandas_udf("binary")
    def run(values):
        return values.map(one)

    return df.withColumn(out, run(F.col(media)))


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def described(df: DataFrame, media: str = "media", most: int = MOST) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of a table with doc_id,
    n_bytes and a binary column of images: what reading each back gives. Nulls where there is no sound image. A narrow map."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 6
        try:
            samples, channels = decode_png(data, most)
        except ValueError:
            return (None, None, None, len(data), hashlib.sha256(data).hexdigest(), None)
        payload = samples.tobytes()
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(samples, channels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(x.as_py()) for x in batch.column("media")]
            columns = list(zip(*found)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(x, f.type) for x, f in zip(columns, list(schema)[2:]))], schema=schema)

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_bytes").cast("long").alias("n_bytes"), F.col(media).alias("media")).mapInArrow(run, DIGEST)


def media_digest(df: DataFrame) -> DataFrame:
    """One row per row of (doc_id, text): each text is stored as PNG in a binary column of a written table; the table is read
    back, and both are described. No shuffle."""
    text = F.col("text").cast("string")
    slim = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    return described(stage(store_media(slim).drop("text"), "media"), most=2**31 - 1)
