from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lectern.functions import bits
from lectern.operators import folds


def clusters(spark, hashes, threshold=0.9):
    df = spark.createDataFrame([("f", k, f"i{k}", h) for k, h in enumerate(hashes)], "file string, pos long, name string, sig long")
    return [(r.grp, r.candidate, r.similarity) for r in folds.leader_clusters(df, "file", "pos", "name", "sig", threshold).orderBy("pos").collect()]


def test_leader_clusters(spark):
    assert clusters(spark, [0, 1]) == [(None, None, None), ("i0", None, 63 / 64)]
    assert clusters(spark, [0, 0xFFFFFFFF, 0xFFFFFFFF]) == [(None, None, None), (None, "i0", 0.5), ("i1", None, 1.0)]
    assert clusters(spark, [0, 0b11, 0b101])[2] == ("i0", None, 62 / 64)
    assert clusters(spark, [0, None, -1]) == [(None, None, None), (None, None, None), (None, "i0", 0.0)]


def fold(spark, chunks):
    rows = [(t, None, None, {k: (v, None, None) for k, v in r.items()} if r else None) for t, r in chunks]
    df = spark.createDataFrame([(rows,)], f"c array<{folds.CHUNK}>")
    return [(c.text, {k: v.text for k, v in c.references.items()} if c.references else {}) for c in df.select(folds.merge_reference_chunks("c").alias("c")).first().c]


def test_merge_reference_chunks(spark):
    r = {"en": "r"}
    assert fold(spark, [(None, r), ("t", {})]) == [("t", r)]
    assert fold(spark, [(None, r), ("t", {"x": "y"})]) == [(None, r), ("t", {"x": "y"})]
    assert fold(spark, [(None, {"a": "1"}), (None, {"b": "2"}), ("t", {})]) == [(None, {"a": "1"}), ("t", {"b": "2"})]
    assert fold(spark, [("t", {}), (None, r)]) == [("t", {}), (None, r)]
    assert fold(spark, [("a", {}), ("b", {})]) == [("a", {}), ("b", {})]


def test_confident_text_error(spark):
    df = spark.createDataFrame([("ab", [("zz", 0.1)])], "text string, spans array<struct<text:string,confidence:double>>")
    with pytest.raises(Exception, match="span not in text"):
        df.select(folds.confident_text("text", "spans")).collect()


def test_single(spark):
    df = spark.createDataFrame([([],), ([("a",)],)], "c array<struct<t:string>>")
    assert [r[0] and r[0].t for r in df.select(folds.single("c")).collect()] == [None, "a"]
    with pytest.raises(Exception, match="more than one chunk"):
        spark.createDataFrame([([("a",), ("b",)],)], "c array<struct<t:string>>").select(folds.single("c")).collect()


def test_signatures(spark):
    df = spark.createDataFrame([([0.0] * 32 + [1.0] * 32,)], "v array<double>")
    h = df.select(bits.average_hash("v").alias("h")).withColumns({"x": bits.to_hex("h")}).withColumn("back", bits.from_hex("x")).first()
    assert h.x == "ffffffff00000000" and h.back == h.h
    assert spark.range(1).select(bits.similarity(F.lit(0).cast("long"), F.lit(1).cast("long"))).first()[0] == 63 / 64
