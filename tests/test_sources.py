from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lectern.catalog import Catalog, CatalogError, config_get, config_set
from lectern.cli import run
from lectern.operators import graph, search
from lectern.plans import films, media
from lectern.sources import blocks, markdown, recognition, tabular

CONTENT = """id: a1
source:
  timecodes: {start: '00:00:00.000', end: '00:00:01.5'}
  note: hello
chunks:
- text: |-
    私は学生です
    line two
  references:
    en: {text: I am a student}
---
id: a2
chunks:
- text: 42
- {}
"""


@pytest.fixture
def content(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "ep01.content.yaml").write_text(CONTENT)
    return str(tmp_path / "in")


def test_yaml_typing():
    assert list(blocks.documents("a: 42\nb: '42'\nc: yes\nd: 00:00:01\ne:\nf: {g: true}\n---\n---\n[1, 2.5]\n")) == [{"a": 42, "b": "42", "c": "yes", "d": "00:00:01", "e": None, "f": {"g": True}}, [1, 2.5]]
    with pytest.raises(ValueError, match="bad.yaml"):
        list(blocks.documents("a: [", "bad.yaml"))
    with pytest.raises(ValueError, match="aliases"):
        list(blocks.documents("a: &x 1\nb: *x\n"))


def test_content_round_trip(spark, content, tmp_path):
    df = blocks.read_content(spark, content)
    rows = df.orderBy("pos").collect()
    assert [r.block.id for r in rows] == ["a1", "a2"] and rows[0].block.chunks[0].text == "私は学生です\nline two"
    start, end = blocks.block_times("block")
    assert df.orderBy("pos").select(start, end).first() == (0, 1_500_000)
    text = blocks.yaml_files(df).first().content
    assert list(blocks.documents(text)) == list(blocks.documents(CONTENT.replace("text: 42", "text: '42'")))


def test_transforms_and_search(spark, content):
    df = blocks.read_content(spark, content)
    kept = media.transform_content(df, "remove-non-japanese-text").orderBy("pos").collect()
    assert [len(r.block.chunks) for r in kept] == [1, 1]
    assert media.transform_content(df, "merge-ref-chunks").count() == 2
    assert media.transform_content(df, "remove-low-confidence-text").count() == 2
    index = media.index_content(df)
    assert [r.block.id for r in media.search_content(index, "学生").collect()] == ["a1"]
    assert media.search_content(index, "absent").count() == 0
    linked, totals = media.link_content(df, index, "link")
    assert totals.first().asDict() == {"linked_chunks": 2, "total_chunks": 3}


def test_index_is_replaced(spark, tmp_path):
    df = spark.createDataFrame([(1, "one two three"), (2, "two one"), (3, "")], "id long, text string")
    for _ in range(2):
        search.build(df, "id", "text").save(str(tmp_path / "x"))
    index = search.Index.load(spark, str(tmp_path / "x"))
    q = spark.createDataFrame([(0, "one two"), (1, "three zero"), (2, "nothing")], "q int, text string")
    got = {(r["query"], r.doc, r.phrase) for r in search.search(index, q, "q", "text").collect()}
    assert got == {(0, 1, True), (1, 1, False)}


def test_merge_and_cli(spark, content, tmp_path):
    (tmp_path / "ref").mkdir()
    (tmp_path / "ref" / "ep01.content.yaml").write_text("source:\n  timecodes: {start: '00:00:00.100', end: '00:00:01.000'}\nchunks:\n- text: ref\n---\nsource:\n  timecodes: {start: '00:00:05.000', end: '00:00:06.000'}\nchunks:\n- text: orphan\n")
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "ep01.content.yaml").write_text(CONTENT.split("---")[0])
    out = run(["content", "merge", str(tmp_path / "one"), str(tmp_path / "ref"), str(tmp_path / "out"), "--align", "timecodes", "--ref", "en"])
    text = (tmp_path / "out" / "ep01.content.yaml").read_text()
    docs = list(blocks.documents(text))
    assert out == str(tmp_path / "out") and [d["chunks"][0].get("references") for d in docs] == [{"en": {"text": "ref"}}, {"en": {"text": "orphan"}}]
    assert run(["content", "index", content, "--index-path", str(tmp_path / "idx")])
    assert [x["block"]["id"] for x in run(["content", "search", "学生", "--index-path", str(tmp_path / "idx")])] == ["a1"]


def test_media_list(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("ep|1\tx\t[sound:a.mp3]\t<img src='a.jpg'>\t\t\nep|en|2\tx\t\t\t\t\n")
    rows = tabular.read_media(spark, str(tmp_path / "m.tsv")).orderBy("ordinal").collect()
    assert [tuple(r) for r in rows] == [("ep", None, 1, "a.mp3", "a.jpg"), ("ep", "en", 2, None, None)]
    (tmp_path / "bad.tsv").write_text("ep|1\tx\n")
    with pytest.raises(Exception, match="expected 6 columns"):
        tabular.read_media(spark, str(tmp_path / "bad.tsv")).collect()


def test_tables_and_recognition(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("tconst\taverageRating\tnumVotes\ntt1\t7.5\t\\N\nshort\n")
    assert [tuple(r) for r in tabular.read_titles(spark, str(tmp_path / "t.tsv"), "ratings").collect()] == [("tt1", "7.5", None)]
    (tmp_path / "ocr").mkdir()
    (tmp_path / "ocr" / "p1.acv4.json").write_text(json.dumps({"readResult": {"blocks": [{"lines": [{"text": "ab cd", "words": [{"text": "ab", "confidence": 0.5}]}, {"text": " ", "words": []}]}]}}))
    (tmp_path / "ocr" / "p1.easyocr.json").write_text(json.dumps({"readResult": [{"text": "x", "confident": 0.25}]}))
    assert [(r.file, r.text, r.spans[0].confidence) for r in recognition.read_recognised(spark, str(tmp_path / "ocr"), "acv4").collect()] == [("p1", "ab cd", 0.5)]
    e = recognition.read_recognised(spark, str(tmp_path / "ocr"), "easyocr")
    assert [(r.text, r.spans[0].confidence) for r in e.collect()] == [("x", 0.25)] and recognition.recognised_chunks(e).count() == 1
    (tmp_path / "d.xml").write_text("<d><entry><ent_seq>1</ent_seq><k_ele><keb>音</keb></k_ele><r_ele><reb>おと</reb></r_ele><sense><gloss>sound</gloss><gloss>noise</gloss></sense></entry></d>")
    assert tuple(tabular.read_dictionary(spark, str(tmp_path / "d.xml")).first()) == (1, ["音"], ["おと"], ["sound", "noise"])


def test_markdown():
    assert markdown.to_plain("**a** _b_ [c](d)") == "a b c\n"
    assert markdown.to_html("a *b*\n\nc  \nd") == "<p>a <em>b</em></p>\n<p>c<br />\nd</p>\n"


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("a", "c", 2), ("b", "d", 1), ("c", "d", 1), ("d", "a", 1)], "parent string, child string, child_no int")
    roots = spark.createDataFrame([("a",)], "node string")
    assert sorted((r.node, r.depth, r.parent) for r in graph.breadth_first(edges, roots).collect()) == [("a", 0, None), ("b", 1, "a"), ("c", 1, "a"), ("d", 2, "b")]
    got = {(r.parent, r.child, r.dashed) for r in graph.acyclic_paths(edges, roots).collect()}
    assert ("d", "a", True) in got and ("a", "b", False) in got and len(got) == 5
    edges.createOrReplaceTempView("tree_edges")
    assert graph.mermaid(spark.createDataFrame([("in", "op")], "source string, target string")).first()[0] == '    in["in"] --> op["op"]'


def test_catalog(spark, tmp_path):
    c = Catalog(spark)
    lib = c.init_library(str(tmp_path / "lib"))
    v = c.new_volume(lib, "My: title", "m1", ["b", "a"])
    assert v.endswith("m1-My_ title") and c.info(v)["tags"] == ["a", "b"]
    c.set(v, "title", "Other")
    v = c.rename(v)
    assert v.endswith("m1-Other")
    assert [(r.moniker, r.title, r.tags) for r in c.volumes(lib).collect()] == [("m1", "Other", ["a", "b"])]
    for bad in (lambda: c.set(v, "nope", "x"), lambda: c.init_volume(v), lambda: c.info(str(tmp_path)), lambda: c.info(str(tmp_path / "none"))):
        with pytest.raises(CatalogError):
            bad()
    (tmp_path / "A.txt").write_text("x")
    assert len(c.import_sources(v, [str(tmp_path / "*.txt")])) == 1
    assert config_get(config_set({"a": {"b": 1}}, "a.c.d", 2), "a.c.d") == 2


def test_films(spark):
    f = spark.createDataFrame([], films.FILM)
    members = spark.createDataFrame([("tt1", "One", 1), ("tt2", "Two", 2)], "id string, title string, rank int")
    f = films.import_list(f, members, "top")
    f = films.import_list(f, members.where("rank = 1"), "top")
    rows = {r.imdb.id: r for r in f.collect()}
    assert rows["tt1"].imdb.lists == {"top": 1} and rows["tt1"].origin == ["imdb"] and rows["tt2"].imdb.lists is None and rows["tt2"].origin is None
    w = films.import_watchlist(f, spark.createDataFrame([(7, "Seven")], "id int, title string"), force=True)
    assert {r.netflix.id: r.netflix.watchlist for r in w.where("netflix is not null").collect()} == {7: True}
    ids = spark.createDataFrame([("imdb", "tt1", "Q1"), ("netflix", "7", "Q1"), ("imdb", "tt2", "Q2")], "kind string, id string, entity string")
    m = films.merge_entities(films.resolve_entities(w, ids).withColumn("n", F.coalesce("imdb.id", F.lit("z"))), "n").where("wikidata = 'Q1'").collect()
    assert len(m) == 1 and m[0].imdb.id == "tt1" and m[0].netflix.id == 7 and m[0].origin == ["imdb", "netflix"]
    basics = spark.createDataFrame([("tt1", "movie", "One!", "一", "0", "1999", None, "90", "a,b")], tabular.TITLE_TABLES["basics"])
    ratings = spark.createDataFrame([("tt1", "7.5", "10")], tabular.TITLE_TABLES["ratings"])
    episodes = spark.createDataFrame([("e1", "tt1", "1", "1"), ("e2", "tt1", "1", "2")], tabular.TITLE_TABLES["episode"])
    x = films.enrich_imdb(f, tabular.typed_basics(basics), ratings, episodes).where("imdb.id = 'tt1'").first().imdb
    assert (x.title, x.genres, x.rating, x.episodes, x.seasons) == ("One!", ["a", "b"], 7.5, 2, 1)
    assert films.export_json(f).count() == 2
    akas = spark.createDataFrame([("tt1", "1", "Seven", "JP", "ja", None, None, "0")], tabular.TITLE_TABLES["akas"])
    s = films.suggest_identifiers(w, basics, akas, ratings).first()
    assert s.film == 7 and s.best.work == "tt1"
    levels = spark.createDataFrame([(5, "tv", "t", "u", None, False, "season", 0), (5, "tv", "t", "u", 12, False, "season", 1)], "tmdbId int, tmdbKind string, title string, url string, level int, temporary boolean, source string, pos int")
    t = f.withColumn("tmdb", F.struct(F.lit(5).alias("id"), F.lit("tv").alias("kind")))
    assert films.enrich_levels(t, levels).first().natively.level == 12


def test_streaming(spark, tmp_path, content):
    from lectern.streaming import incremental

    for n in (1, 2):
        if n == 2:
            (tmp_path / "in" / "ep02.content.yaml").write_text(CONTENT)
        q = incremental.process_new_files(spark, content, "*.yaml", lambda d: d.select("file", F.length("content").alias("n")), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == n
