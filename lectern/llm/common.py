"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators._store import removed, scratch_path, shared_folder, stored  # noqa: F401

#: Bytes of text that one vectorised step works on. Longer texts are steps of their own, which work through
#: them in pieces of this size.
SLICE_BYTES = 1 << 20

#: Whitespace of the word and normalisation rules: space and \t \n \v \f \r.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: Column | str, k: int) -> Column:
    """crc32 of the id written as text, modulo k."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(col.cast("string")) % F.lit(k)


def text_buffer(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and its row offsets, without copies; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    n, start = len(array), array.offset
    bufs = array.buffers()
    offsets = np.frombuffer(bufs[1], kind)[start : start + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; a longer text is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def by_group(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, share: int = 2000) -> DataFrame:
    """Inner join of ``rows`` with their groups, where one group may hold most of the rows. Groups of over
    1/share of the rows number ``share`` at most, so they are broadcast and their rows stay where they
    are; the other rows meet their groups in a shuffle that no key can burden."""
    limit = max(1, rows.count() // share)
    hot = F.broadcast(groups.where(F.col(size) > limit))
    light = rows.join(hot.select(*keys), keys, "left_anti").join(groups.where(F.col(size) <= limit), keys)
    return rows.join(hot, keys).unionByName(light)


#: Ids that are broadcast at most, about 64 MB of hash table; beyond, rows are shuffled to them.
BROADCAST_IDS = 500_000


def restricted(df: DataFrame, ids: DataFrame, on: Column, how: str) -> DataFrame:
    """Semi or anti join of ``df`` with stored, distinct ids: broadcast only while they are few."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, on, how)


def by_top(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, top: int = 2000) -> DataFrame:
    """Inner join of ``rows`` with stored groups of known sizes. Few groups are broadcast. Of many, the ``top``
    largest are, and their rows stay where they are; any other has at most 1/top of all rows that join,
    so that those can meet in a shuffle."""
    if groups.count() <= BROADCAST_IDS:
        return rows.join(F.broadcast(groups), keys)
    hot = F.broadcast(stored(groups.orderBy(F.col(size).desc(), *keys).limit(top), "hot-groups"))
    light = rows.join(hot.select(*keys), keys, "left_anti").join(groups.join(hot.select(*keys), keys, "left_anti"), keys)
    return rows.join(hot, keys).unionByName(light)


# Hashing of byte strings in arrays -----------------------------------------------------------------

_U = np.uint64
BASE = _U(0x9E3779B97F4A7C15)
BASE_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x + _U(salt * 2 + 1) * BASE
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


#: A random number for each byte, so that the polynomials have no structure that text could meet.
BYTE_CODES = mixed(np.arange(1, 257, dtype=np.uint64), 77)


class Powers:
    """Powers of the base and of its inverse modulo 2^64, as many as have been asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, len(self.up) + (len(self.up) >> 2))
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64), dtype=np.uint64)]) for b in (BASE, BASE_INVERSE))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix hashes modulo 2^64: entry i covers the first i bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(np.take(BYTE_CODES, data) * POWERS.to(len(data))[0], out=out[1:], dtype=np.uint64)
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from start to end, equal for equal bytes wherever they are."""
    down = POWERS.to(len(prefix))[1]
    return mixed((np.take(prefix, end) - np.take(prefix, start)) * np.take(down, start) + (end - start).astype(np.uint64) * _LENGTH)


_LENGTH = _U(0xD6E8FEB86659FD93)


def gram_hashes(prefix: np.ndarray, n: int) -> np.ndarray:
    """``span_hashes`` of the n bytes from every position."""
    down = POWERS.to(len(prefix))[1]
    return mixed((prefix[n:] - prefix[:-n]) * down[: len(prefix) - n] + _U(n * int(_LENGTH) % (1 << 64)))


# Hot keys ------------------------------------------------------------------------------------------

#: Keys that are split at most: any other has less than a thousandth or so of all rows.
SPLIT_KEYS = 2_000


def split_plan(sampled: DataFrame, group_rows: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent grams of ``sampled`` rows (gram), one document in ``sample``, sorted as unsigned
    numbers, and into how many groups each is split: about the square root of its rows, if these are more than
    ``group_rows``. It decides a layout only, never a result. SPLIT_KEYS rows at most come to the driver."""
    counts = sampled.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") >= max(2, group_rows // (4 * sample)))
    rows = sorted((r["gram"] & (1 << 64) - 1, r["n"] * sample) for r in counts.orderBy(F.col("n").desc(), "gram").limit(SPLIT_KEYS).collect())
    sizes = np.array([n for _, n in rows], np.int64)
    return np.array([g for g, _ in rows], np.uint64), np.where(sizes > group_rows, np.ceil(np.sqrt(sizes)).astype(np.int64), 1)


def within(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values the sorted array ``known`` has."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


def salts(grams: np.ndarray, docs: np.ndarray, split: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """The group of each row of a split gram, by its document; -1 for whole grams."""
    out = np.full(len(grams), -1, np.int64)
    mine = np.nonzero(within(grams, split))[0]
    if len(mine):
        many = parts[np.searchsorted(split, grams[mine])]
        out[mine] = np.where(many > 1, (mixed(docs[mine].astype(np.int64).view(np.uint64), 3) % many.astype(np.uint64)).astype(np.int64), -1)
    return out
