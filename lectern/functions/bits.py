"""64-bit image signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def average_hash(samples: Column | str) -> Column:
    """64 samples as a bit mask: bit i is set if sample i is at least the mean of all."""
    values = F.transform(_c(samples), lambda v: v.cast("double"))
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)
    return F.aggregate(
        F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i"))),
        F.lit(0).cast("long"),
        lambda a, p: a.bitwiseOR(F.when(p["v"] >= mean, F.call_function("shiftleft", F.lit(1).cast("long"), p["i"])).otherwise(F.lit(0).cast("long"))),
    )


def similarity(a: Column | str, b: Column | str) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(_c(a).bitwiseXOR(_c(b))) / F.lit(64.0)


def to_hex(a: Column | str) -> Column:
    return F.lpad(F.lower(F.hex(_c(a))), 16, "0")


def from_hex(text: Column | str) -> Column:
    """The signature of 16 hex digits; null if it isn't one."""
    t = F.lower(_c(text))
    high, low = F.conv(F.substring(t, 1, 8), 16, 10).cast("long"), F.conv(F.substring(t, 9, 8), 16, 10).cast("long")
    signed = F.when(high >= 1 << 31, high - (1 << 32)).otherwise(high)
    return F.when(t.rlike("^[0-9a-f]{16}$"), signed * F.lit(1 << 32).cast("long") + low)


def box_height(box: Column | str) -> Column:
    """Height of a box of eight coordinates x, y from the top left on: the taller side."""
    b = _c(box)
    return F.greatest(b[7] - b[1], b[5] - b[3])
