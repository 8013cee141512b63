"""Queries do the whole job: each row of a small table counts, and all of its text."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import functions as F

from lectern.operators import resolve
from lectern.plans import catalogue
from lectern.sources import blocks


def test_fuzzy_title_ranked(spark, tmp_path):
    names = ["red fox", "red fox", "Red  Fox", "blue owl", "red fox", "blue owl", "Brand 3", "lone elk", "..."]
    kinds = ["STANDARD", "PROMO", "ODD", "ECONOMY", "PROMO", "ECONOMY", "PROMO", "ODD", "PROMO"]
    parts = [(k, n, f"Brand#{k % 4}", t, 100.0 + k % 3) for k, (n, t) in enumerate(zip(names * 2, kinds * 2, strict=True), 1)]
    spark.createDataFrame(parts, "p_partkey bigint, p_name string, p_brand string, p_type string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    key = lambda x: re.sub(r"[\W_]+", " ", x.lower()).strip()
    rank = {"PROMO": 0, "ECONOMY": 1, "STANDARD": 2}
    want = {}
    for film, name, *_ in parts:
        works = [w for w in parts if w[0] != film and key(name) and key(name) in (key(w[1]), key(w[2]))]
        works = [w[0] for w in sorted(works, key=lambda w: (rank.get(w[3], 99), -w[4], w[0]))]
        if works:
            want[film] = (works[0], ",".join(map(str, works)))
    got = catalogue.QUERIES["fuzzy_title_ranked"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {r.p_partkey: (r.best, r.ranked) for r in got} == want


def test_lists_of_one_title_are_many_tasks(spark, tmp_path, monkeypatch):
    """A title's lists are its number squared: they are dealt out by their bytes, and each is its title's text but for one place."""
    monkeypatch.setattr(resolve, "LIST_BYTES", 50, raising=False)
    keys = [1, 9, 10, 11, 99, 100, 101, 110, 111, 1010, 1111]
    spark.createDataFrame([(k, "red fox", "B", "ODD", float(k % 7)) for k in keys], "p_partkey bigint, p_name string, p_brand string, p_type string, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    got = catalogue.QUERIES["fuzzy_title_ranked"](spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    want = sorted(keys, key=lambda k: (-(k % 7), k))
    rest = {k: [w for w in want if w != k] for k in keys}
    assert len(got) == len(keys) and {r.p_partkey: (r.best, r.ranked) for r in got} == {k: (v[0], ",".join(map(str, v))) for k, v in rest.items()}
    assert len({r.task for r in got}) > 1


def events(spark, folder) -> dict[int, list[tuple[int, str]]]:
    """Writes a table of events; returns each user's (id, type)."""
    kinds = ["click", "view", "purchase", "error"]
    rows = [(k, k % 3, kinds[k % 4], f"1970-01-01 00:00:{k:02d}") for k in range(1, 24)]
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, ts string")
    df.selectExpr("event_id", "user_id", "event_type", "1.0D AS value", "'{}' AS props", "CAST(ts AS timestamp_ntz) AS ts").write.parquet(f"{folder}/events.parquet")
    return {u: [(r[0], r[2]) for r in rows if r[1] == u] for u in range(3)}


def test_markdown_export(spark, tmp_path):
    users = events(spark, tmp_path)
    got = {r.file: (r.n_chars, r.md5) for r in catalogue.QUERIES["markdown_export"](spark, str(tmp_path)).collect()}
    assert set(got) == {str(u) for u in users}
    for user, its in users.items():
        out, before = [f"# {user}"], None
        for n, (k, kind) in enumerate(its, 1):
            image = "a b.jpg" if kind == "view" else None
            if image is None or image != before:
                out.append("## note" if kind == "error" else f"## 00:00:{k:02d}")
            if image and image != before:
                out.append("![](images/a%20b.jpg)")
            before = image
            out += [f"{kind} {k}"] if kind == "click" else [f"{kind} {k}[^{user}-{n}]", f"[^{user}-{n}]: ref {kind}"]
            out.append('<audio controls src="audio/s.mp3"></audio>' if kind == "purchase" else "---")
        text = "\n\n".join(out) + "\n"
        assert got[str(user)] == (len(text), hashlib.md5(text.encode()).hexdigest())


def test_yaml_roundtrip(spark, tmp_path):
    users = events(spark, tmp_path)
    got = {r.file: (r.n_docs, r.md5) for r in catalogue.QUERIES["yaml_roundtrip"](spark, str(tmp_path)).collect()}
    assert set(got) == {str(u) for u in users}
    for user, its in users.items():
        times = {"start": "00:00:01.000", "end": "00:00:02.000"}
        text = "\n".join(json.dumps({"id": str(k), "source": {"timecodes": times, "note": kind}, "chunks": [{"text": f"{kind} {k}"}]}, separators=(",", ":")) for k, kind in its)
        assert got[str(user)] == (len(its), hashlib.md5(text.encode()).hexdigest())


def test_yaml_is_parsed(spark):
    files = spark.createDataFrame([("a", "id: '1'\n---\nid: x # a note\nmore: 2\n---\n---\nid: |\n  ---\n")], "file string, content string")
    assert [tuple(r) for r in blocks.parsed_yaml(files, "id string").selectExpr("file", "pos", "doc.id").orderBy("pos").collect()] == [("a", 0, "1"), ("a", 1, "x"), ("a", 2, "---\n")]


def test_title_normalize(spark, tmp_path):
    long = "Once -- upon a time, " * 10
    texts = {1: long + "THE End!", 2: long + "no end", 3: "...", 4: "", 5: None}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "red fox", "Brand#1")], "p_partkey bigint, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.key: (r.title, r.slug) for r in catalogue.QUERIES["title_normalize"](spark, str(tmp_path)).collect()}
    title = "once upon a time " * 10
    assert got == {
        "p1": ("the red fox brand 1", "the-red-fox-brand-1"), "d1": (title + "the end", (title + "the end").replace(" ", "-")), "d2": (title + "no end", (title + "no end").replace(" ", "-")),
        "d3": ("", "d3"), "d4": (None, "d4"), "d5": (None, "d5"),
    }


def test_script_filter(spark, tmp_path):
    long = "plain Latin text, " * 10
    texts = {1: long, 2: long + "かな", 3: long + "桃", 4: long + "口入人", 5: "ロ", 6: "ロか", 7: "", 8: None}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_upper, r.n_kana, r.japanese, r.kept) for r in catalogue.QUERIES["script_filter"](spark, str(tmp_path)).collect()}
    assert got == {
        1: (10, 0, False, False), 2: (10, 2, True, True), 3: (10, 0, True, True), 4: (10, 0, True, False), 5: (0, 1, True, False), 6: (0, 2, True, True), 7: (0, 0, False, False), 8: (None, 0, False, False),
    }


def test_subtitle_clean(spark, tmp_path):
    long = "some words of a turn " * 5
    texts = [(1, 0, long + "{\\i1}and more{\\i0}\nthe end"), (1, 1, long + "{open"), (1, 2, "{all}"), (1, 3, "not kept: it ends before it starts")]
    spark.createDataFrame(texts, "conv_id bigint, turn bigint, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.ordinal: r.text for r in catalogue.QUERIES["subtitle_clean"](spark, str(tmp_path)).collect()}
    assert got == {1: long + "and more  \nthe end", 2: long.strip()}


def search_tables(spark, folder) -> None:
    item = " ".join(f"w{k}" for k in range(20))
    texts = {1: item, 2: "so " + " ".join(item.split()[:15]) + " ends", 3: "other w18 w19", 4: "nothing", 5: "tail x17 x18 x19", 6: ""}
    spark.createDataFrame([(k, t, f"l{k}") for k, t in texts.items()], "doc_id bigint, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    items = [(7, item), (8, " ".join(f"x{k}" for k in range(20)))]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_phrase_search(spark, tmp_path):
    search_tables(spark, tmp_path)
    # Document 2 has only the phrase's opening, 5 only words of the other item's end.
    assert {(r.item_id, r.doc_id, r.phrase) for r in catalogue.QUERIES["phrase_search"](spark, str(tmp_path)).collect()} == {(7, 1, True), (8, 5, False)}


def test_search_link_top1(spark, tmp_path):
    search_tables(spark, tmp_path)
    assert {tuple(r) for r in catalogue.QUERIES["search_link_top1"](spark, str(tmp_path)).collect()} == {(7, 1, "l1"), (8, 5, "l5")}
