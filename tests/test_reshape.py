from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions import time as TM
from lectern.operators import filters, lookup, reshape, stats


def test_line_kinds(spark):
    df = spark.createDataFrame([("f", 0, "（ドア）\n（太郎）やあ\n元気?\n♪～")], "file string, pos long, text string")
    got = [(r.kind, r.actor, r.text) for r in reshape.line_kinds(df).orderBy("part").collect()]
    assert got == [("SoundEffect", None, "（ドア）"), ("Primary", "太郎", "やあ\n元気?"), ("SoundEffect", None, "♪～")]


def test_input_kind(spark):
    df = spark.createDataFrame([("a", "1.JPG"), ("a", "2.png")], "g string, n string")
    with pytest.raises(Exception, match="mixed"):
        reshape.input_kind(df, "g", "n").collect()
    assert reshape.input_kind(df.where("n = '1.JPG'"), "g", "n").first().kind == "image"


def test_nested_and_cache(spark):
    df = spark.createDataFrame([([([1, 2],), ([],)],)], "a array<struct<b:array<int>>>")
    assert df.select(reshape.leaf_count(F.col("a"), "b")).first()[0] == 2
    cache = spark.createDataFrame([("x", 1)], "path string, v int")
    assert reshape.to_compute(spark.createDataFrame([("x",), ("y",), ("y",)], "path string"), cache).collect()[0].path == "y"
    assert reshape.json_array(cache).first()[0] == '[{"path":"x","v":1}]'


def scalars():
    return [
        (T.title_key(F.lit("  The B!! c-3 ")), "the b c 3"), (T.title_key(F.lit("\\N")), None), (T.title_key(F.lit("!!")), ""), (T.slug(F.lit(" A & b! ")), "a-b"), (T.slug(F.lit("!"), F.lit("x")), "x"),
        (T.ruby(F.lit("桃[もも]を")), "<ruby>桃<rt>もも</rt></ruby>を"), (T.ruby(F.lit("これは音[おと]"), "remove"), "これは音"), (T.base_name(F.lit("/a/ep01.content.yaml")), "ep01"), (T.base_name(F.lit("/a/b.txt")), None),
        (T.uri_escaped(F.lit("a b/ü~*.jpg")), "a%20b/%C3%BC~%2A.jpg"), (T.film_qualifier(F.lit("x.S01E02.mkv")), "-s01e02"), (T.film_qualifier(F.lit("x")), None), (T.kebab(F.lit("OnScreenText")), "on-screen-text"),
        (T.entity_id(F.lit("http://w/entity/Q5")), "Q5"), (T.coerced(F.lit("TRUE")), "true"), (T.coerced(F.lit("12")), "12"), (T.coerced(F.lit('a"b')), '"a\\"b"'), (T.clean_file_name(F.lit(' a:b?"c" ')), "a_b__c_"),
        (T.natural_key(F.lit("a10b2")), "a0000000010b0000000002"), (T.sound_file(F.lit("[sound:a.mp3]")), "a.mp3"), (T.node_id(F.lit("big dog (x), y")), "big_dog_x"), (T.html_text(F.lit("<b>a</b><!-- x --> &amp;lt;")), "a &lt;"),
        (T.parenthetical_ruby(F.lit("音(おと)と（x）")), "音[おと]と[x]"), (T.without_extensions(F.lit("a/b.c.d")), "b"), (TM.ttml_time(F.lit("00:00:01.5")), 1_500_000), (TM.ttml_time(F.lit("20t")), 2), (TM.ttml_time(F.lit("5f")), None),
        (TM.vtt_time(F.lit("01:02.003")), 62_003_000), (TM.vtt_time(F.lit("1:2.3")), None), (TM.format_clock(F.lit(9_000_000)), "00:00:09"), (TM.format_vtt(F.lit(1_250_000), True), "00:00:01,250"), (T.display_title(F.create_map(F.lit("ja"), F.lit("x"))), "x"),
        (T.language_codes(F.lit("Japanese [Original], Brazilian Portuguese, English - Audio Description"), {"japanese": "ja", "portuguese": "pt", "english": "en"}), ["en", "ja", "pt"]),
        (T.language_codes(F.lit("Japanese [Original], English"), {"japanese": "ja", "english": "en"}, True), ["ja"]), (T.lines(F.lit("a\r\nb\rc\n")), ["a", "b", "c"]), (T.is_japanese_text(F.lit("口入人")), False), (T.is_japanese_text(F.lit("かな")), True),
    ]


def test_scalars(spark):
    cases = scalars()
    got = spark.range(1).select(*[c.alias(f"c{k}") for k, (c, _) in enumerate(cases)]).first()
    assert list(got) == [want for _, want in cases]


def test_recognised_lines(spark):
    box = lambda h: [0, 0, 1, 0, 1, h, 0, h]
    rows = [("i", "漢字", [("漢字", 0.9)], box(10)), ("i", "かんじ", [("x", 0.9)], box(5)), ("i", "weak", [("x", 0.1)], box(10)), ("i", "弱い", [("x", 0.1)], box(10)), ("i", "大", [("x", None)], box(9))]
    df = spark.createDataFrame(rows, "image string, text string, words array<struct<text:string,confidence:double>>, box array<int>")
    assert {r.text for r in filters.recognised_lines(df, "image", "text", "words", "box").collect()} == {"漢字", "大"}


def test_lookups(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    with pytest.raises(Exception, match="duplicate key"):
        lookup.require_unique(t.union(t), ["k"]).collect()
    with pytest.raises(Exception, match="differ in length"):
        lookup.zip_rows(t, t.limit(1).withColumnsRenamed({"k": "k2", "v": "v2"}), ["k"], ["k2"], strict=True).collect()
    with pytest.raises(Exception, match="missing"):
        lookup.changed(t, t.limit(0), "k", ["v"]).collect()
    assert lookup.changed(t, t.withColumn("v", F.lit(1)), "k", ["v"]).count() == 1
    paths = spark.createDataFrame([("/a/b/c",), ("/x",)], "path string")
    marked = spark.createDataFrame([("/a",), ("/a/b",)], "directory string")
    assert {r.path: r.directory for r in lookup.nearest_ancestor(paths, marked).collect()} == {"/a/b/c": "/a/b", "/x": None}
    left = spark.createDataFrame([(1, "a", ""), (2, "z", ""), (3, "z", "in")], "id int, k string, i string")
    met, table = lookup.with_gaps(left, t.select("k", F.col("v").cast("string").alias("s")), "k", "i", "s")
    assert {r.id: r.s for r in met.collect()} == {1: "1", 2: "", 3: "in"} and table.count() == 3
    assert stats.duplicates(spark.createDataFrame([("A",), ("a",), ("b",)], "k string"), "k").collect()[0].n == 2
    with pytest.raises(Exception, match="not in the corpus"):
        stats.utility(spark.createDataFrame([("v", "t", 1)], "volume string, term string, cnt int"), spark.createDataFrame([], "term string, n_docs int"), F.lit(1)).collect()
