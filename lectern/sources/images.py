"""Images as 64-bit signatures: PNG files decoded to 8-bit grey inside tasks, the rest by column expressions.

A provider names how a file's bytes become a signature and how two signatures compare; others can be registered.
An image that its provider can't read has a null signature and is in no group; it fails no job.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from lectern.functions import bits

#: Side of the square that an image is reduced to.
SIDE = 8

# Fixed values of the PNG format: its first bytes, channels by colour type, and (start, step) of the seven passes of
# interlaced images, as x, y, dx, dy.
_MAGIC = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _unfiltered(lines: np.ndarray, unit: int) -> np.ndarray:
    """Rows of bytes without their row filters. What a byte depends on is left of it and above it, so all bytes
    of a diagonal are made at once, whatever the filters of their rows."""
    kinds, body = lines[:, 0], lines[:, 1:].reshape(len(lines), -1, unit)
    if kinds.size and kinds.max() > 4:
        raise ValueError("unknown row filter")
    height, width = body.shape[:2]
    done = np.zeros((height + 1, width + 1, unit), np.int32)
    if not kinds.any():
        return body.reshape(height, -1)
    for d in range(height + width - 1):
        r = np.arange(max(0, d - width + 1), min(height, d + 1))
        c = d - r
        left, up, corner = done[r + 1, c], done[r, c + 1], done[r, c]
        to_left, to_up, to_corner = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        nearest = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
        guess = np.select([kinds[r, None] == k for k in (1, 2, 3, 4)], [left, up, (left + up) >> 1, nearest], 0)
        done[r + 1, c + 1] = (body[r, c] + guess) & 255
    return done[1:, 1:].astype(np.uint8).reshape(height, -1)


def _samples(rows: np.ndarray, width: int, depth: int, channels: int) -> np.ndarray:
    """(height, width, channels) of a pass's bytes, as integers of the image's own depth."""
    if depth == 16:
        return rows.reshape(len(rows), width, channels, 2).astype(np.int32) @ np.array([256, 1], np.int32)
    if depth < 8:
        spread = np.unpackbits(rows, axis=1).reshape(len(rows), -1, depth)
        rows = (spread @ (1 << np.arange(depth)[::-1]))[:, : width * channels]
    return rows.reshape(len(rows), width, channels).astype(np.int32)


def png_grey(content: bytes) -> np.ndarray:
    """A PNG image as rows of 8-bit grey: Rec. 601 weights for colours, transparency unseen. ValueError otherwise."""
    if not content.startswith(_MAGIC):
        raise ValueError("no PNG image")
    at, header, palette, packed = len(_MAGIC), None, None, []
    while at + 8 <= len(content):
        size, kind = struct.unpack_from(">I4s", content, at)
        data = content[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", data)
        elif kind == b"PLTE":
            palette = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        elif kind == b"IDAT":
            packed.append(data)
        elif kind == b"IEND":
            break
        at += size + 12
    if header is None or header[3] not in (*_CHANNELS,) or not header[0] * header[1] or (header[3] == 3 and palette is None):
        raise ValueError("no image in the file")
    width, height, depth, colour, _, _, interlaced = header
    channels = _CHANNELS[colour]
    passes = [(x, y, dx, dy, -(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in (_PASSES if interlaced else ((0, 0, 1, 1),)) if x < width and y < height]
    lengths = [h * (1 + -(-w * channels * depth // 8)) for *_, w, h in passes]
    raw = zlib.decompressobj().decompress(b"".join(packed), sum(lengths))
    if len(raw) < sum(lengths):
        raise ValueError("the image ends early")
    pixels, start = np.zeros((height, width, channels), np.int32), 0
    for (x, y, dx, dy, w, h), length in zip(passes, lengths, strict=True):
        lines = np.frombuffer(raw, np.uint8, length, start).reshape(h, -1)
        pixels[y::dy, x::dx] = _samples(_unfiltered(lines, max(1, channels * depth // 8)), w, depth, channels)
        start += length
    if colour == 3:
        pixels = palette[np.minimum(pixels[:, :, 0], len(palette) - 1)]
    elif depth != 8:
        pixels = (pixels * 255 * 2 + (1 << depth) - 1) // (2 * ((1 << depth) - 1))
    grey = pixels[:, :, 0] if pixels.shape[2] < 3 else (pixels[:, :, :3] @ np.array([299, 587, 114], np.int32) + 500) // 1000
    return grey.astype(np.uint8)


def reduced(grey: np.ndarray, side: int = SIDE) -> np.ndarray:
    """side x side means of equal areas, pixels on a border shared by their parts; halves round up."""

    def shares(n: int) -> np.ndarray:
        edge, pixel = np.arange(side)[:, None] * n, np.arange(n)[None, :] * side
        return np.clip(np.minimum(edge + n, pixel + side) - np.maximum(edge, pixel), 0, None).astype(np.int64)

    area = grey.shape[0] * grey.shape[1]
    return (2 * (shares(grey.shape[0]) @ grey.astype(np.int64) @ shares(grey.shape[1]).T) + area) // (2 * area)


@F.udf(ArrayType(IntegerType()), useArrow=False)
def grey_samples(content):
    """The 64 grey samples of a PNG image, row by row; null if it can't be read. Rows go to Python a hundred at
    a time, so few images are in memory at once."""
    try:
        return None if content is None else [int(v) for v in reduced(png_grey(bytes(content))).ravel()]
    except (ValueError, struct.error, zlib.error):
        return None


@dataclass(frozen=True)
class Provider:
    """samples: a file's bytes to what is read of it; signature: that to a number; similarity: two signatures to a share;
    to_text and from_text: the form in which caches keep them."""

    samples: Callable[[Column], Column]
    signature: Callable[[Column], Column]
    similarity: Callable[[Column, Column], Column]
    to_text: Callable[[Column], Column]
    from_text: Callable[[Column], Column]


PROVIDERS: dict[str, Provider] = {}


def register(name: str, provider: Provider) -> None:
    """Makes a provider known by its name; one of the same name gives way."""
    PROVIDERS[name] = provider


register("average-hash", Provider(grey_samples, bits.average_hash, bits.similarity, bits.to_hex, bits.from_hex))


def with_signature(files: DataFrame, provider: str = "average-hash", content: str = "content", signature: str = "signature") -> DataFrame:
    """Rows with their bytes' signature in the bytes' place."""
    chosen = PROVIDERS[provider]
    return files.withColumn("__samples", chosen.samples(F.col(content))).drop(content).withColumn(signature, chosen.signature(F.col("__samples"))).drop("__samples")


def read_signatures(spark: SparkSession, path: str, provider: str = "average-hash", glob: str = "*.png", known: DataFrame | None = None) -> DataFrame:
    """(name, signature) of the images below ``path``. Those that ``known`` (name, signature as text) has aren't decoded."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "content")
    if known is None:
        return with_signature(files, provider)
    old = files.select("name").join(known.select("name", PROVIDERS[provider].from_text(F.col("signature")).alias("signature")), "name")
    return old.unionByName(with_signature(files.join(known.select("name"), "name", "left_anti"), provider))


def encoded_png(pixels: np.ndarray, depth: int = 8, filters: int | None = None) -> bytes:
    """PNG bytes of (height, width, channels) samples, one to four channels of 8 or 16 bits; row r has the filter
    ``filters``, or r modulo 5."""
    height, width, channels = pixels.shape
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    unit = channels * depth // 8
    body = pixels.astype(">u2" if depth == 16 else np.uint8).tobytes()
    plain = np.frombuffer(body, np.uint8).reshape(height, width, unit).astype(np.int32)
    framed = np.pad(plain, ((1, 0), (1, 0), (0, 0)))
    left, up, corner = framed[1:, :-1], framed[:-1, 1:], framed[:-1, :-1]
    guess = left + up - corner
    off = [np.abs(guess - v) for v in (left, up, corner)]
    nearest = np.where((off[0] <= off[1]) & (off[0] <= off[2]), left, np.where(off[1] <= off[2], up, corner))
    kinds = np.arange(height) % 5 if filters is None else np.full(height, filters)
    made = np.select([(kinds == k)[:, None, None] for k in (1, 2, 3, 4)], [plain - left, plain - up, plain - ((left + up) >> 1), plain - nearest], plain) & 255
    lines = np.hstack([kinds[:, None], made.reshape(height, -1)]).astype(np.uint8)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return _MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")
