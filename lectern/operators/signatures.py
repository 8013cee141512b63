"""Pairs of similar 64-bit signatures."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.bits import similarity


def similar_pairs(rows: DataFrame, group: str, id_col: str, signature: str, threshold: float = 0.9) -> DataFrame:
    """(group, a, b, similarity) of the rows of one group whose signatures agree in ``threshold`` of their
    bits, a < b. Signatures that differ in d bits, cut into d + 1 bands, agree in a whole band: the bands
    are what is joined. A pair that shares several bands is taken from the first."""
    most = math.floor((1 - threshold) * 64 + 1e-9)
    cuts = [64 * k // (most + 1) for k in range(most + 2)]
    band = lambda k: F.shiftrightunsigned(F.col("sig"), cuts[k]).bitwiseAND(F.lit((1 << (cuts[k + 1] - cuts[k])) - 1).cast("long"))
    s = rows.select(F.col(group).alias("grp"), F.col(id_col).alias("id"), F.col(signature).alias("sig")).where("sig is not null")
    if most >= 63:
        raise ValueError("the threshold leaves no band to join on")
    keyed = s.select("grp", "id", "sig", F.posexplode(F.array(*[band(k) for k in range(most + 1)])).alias("band", "bits"))
    a, b = (keyed.select("grp", "band", "bits", F.col("id").alias(n), F.col("sig").alias(f"s_{n}")) for n in ("a", "b"))
    met = a.join(b, ["grp", "band", "bits"]).where("a < b")
    same_before = F.lit(False)
    for k in range(most + 1):
        width = F.lit((1 << (cuts[k + 1] - cuts[k])) - 1).cast("long")
        agrees = F.shiftrightunsigned(F.col("s_a").bitwiseXOR(F.col("s_b")), cuts[k]).bitwiseAND(width) == 0
        same_before = same_before | (agrees & (F.col("band") > k))
    return met.where(~same_before).select(F.col("grp").alias(group), "a", "b", similarity("s_a", "s_b").alias("similarity")).where(F.col("similarity") >= threshold)


def top_similar(pairs: DataFrame, group: str, k: int = 3) -> DataFrame:
    """The k best partners of each row, of either side of the pairs."""
    both = pairs.unionByName(pairs.select(group, F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    w = Window.partitionBy(group, "a").orderBy(F.col("similarity").desc(), "b")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
