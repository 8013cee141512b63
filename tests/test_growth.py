"""What must not grow with the input: rows held at once, rows shuffled, calls of the driver."""

from __future__ import annotations

import gzip
import re
import time
import unicodedata

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import analysis, resolve, search
from lectern.plans import films
from lectern.sources import blocks, markdown, splits
from lectern.streaming import incremental


def test_words_of_runs_stream_past_the_dictionary(spark, monkeypatch):
    rows = [("ab", "ab", "N", "r1", 0, 0, 100), ("a", None, "N", None, 0, 0, 300), ("b", "b", "V", None, 1, 1, 300), ("ba", "ba", "V", "r2", 1, 0, 90), ("bab", "bab", "N", None, 0, 1, 120)]
    entries = spark.createDataFrame(rows, analysis.ENTRY)
    texts = spark.createDataFrame([(i, "ab" * (i + 1) + "x" * (i % 3) + ". " + "ba" * i) for i in range(8)], "id long, t string")
    runs = analysis.units(texts, "id", "t").select("unit").distinct().withColumn("id", analysis.F.monotonically_increasing_id())
    words = analysis.lattice(runs, analysis.dictionary(entries))
    plan = words._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "SortMergeJoin" not in plan and {"base", "pos", "reading"}.isdisjoint(words.columns)
    joins = {(0, 0): 5, (0, 1): 50, (1, 0): 7}
    shown = lambda: sorted(map(tuple, analysis.analysed(texts, "id", "t", entries, joins, 20).collect()), key=repr)
    one = shown()
    monkeypatch.setattr(analysis, "FEW_ENTRIES", 2)  # three parts
    assert shown() == one and len({r[3] for r in one}) > 3


def test_tasks_name_their_files(spark, tmp_path, monkeypatch):
    rows = lambda word: spark.range(50).selectExpr("concat('a b#', id, '.txt') AS file", f"concat('{word}', id, '\\n') AS content")
    at, elsewhere = f"file://{tmp_path}/one", f"file://{tmp_path}/two"
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(elsewhere).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    text = lambda df: df.withColumn("content", blocks.F.regexp_replace("content", "\n$", ""))
    assert len(blocks._renamed(text(rows("x")), fs, elsewhere)) == 50  # leaves sums, which later files must not fail on
    monkeypatch.setattr(blocks, "_renamed", None)  # the driver touches no file
    assert blocks.write_files(rows("old"), at) == []
    for path in (at, elsewhere):
        assert len(blocks.write_files(rows("new"), path, listed=True)) == 50
        got = spark.read.text(path, wholetext=True).collect()
        assert {r.value for r in got} == {f"new{i}\n" for i in range(50)}


def test_preferred_ids_need_no_lists(spark):
    rows = [(k, i, kind, o) for k in range(5) for i, kind, o in [(7, "tv", 3), (3, "tv", 9 if k % 2 else None), (5, "movie", 1), (9, None, 0)] if (i + k) % 4]
    df = spark.createDataFrame(rows, "k int, id long, kind string, ordinal int")
    kinds = ["tv", "movie"]
    old = df.groupBy("k").agg(resolve.preferred_id(F.collect_list(F.struct("id", "kind", "ordinal")), kinds).alias("id"))
    new = resolve.preferred(df, "k", "id", "kind", "ordinal", kinds)
    assert sorted(map(tuple, new.collect())) == sorted(map(tuple, old.collect()))
    assert "collect_list" not in new._jdf.queryExecution().executedPlan().toString()


def test_films_of_a_title_share_a_list(spark):
    film = [(i, "Same Name") for i in range(40)] + [(40, "Other"), (3, "Other")]
    frame = spark.createDataFrame(film, "id int, title string").selectExpr("struct(id, title) AS netflix", "cast(null as string) AS wikidata")
    basics = spark.createDataFrame([(f"tt{i}", "movie", "same name!" if i % 3 else "other", "山の道") for i in range(30)], "tconst string, titleType string, primaryTitle string, originalTitle string")
    basics = basics.withColumn("startYear", F.lit(1999))
    akas = spark.createDataFrame([], "titleId string, title string, language string, region string")
    ratings = spark.createDataFrame([("tt4", "5", "9")], "tconst string, averageRating string, numVotes string")
    shared, lists = films.suggested_lists(frame, basics, akas, ratings)
    assert shared.count() == 41 and lists.count() == 3
    got = {r.film: [x.work for x in r.ranked] for r in films.suggest_identifiers(frame, basics, akas, ratings).collect()}
    assert len(got) == 41 and got[0][0] == "tt4" and len(got[0]) == 20 and len(got[3]) == 30 and len(got[40]) == 10


def test_markdown_both_ways(spark):
    texts = ["**a _x_ y**\n\n- *b*\n\n> ***x** c*\n\n# d #", "", None, "`x" * 300]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", markdown.markdown_to_both("t").alias("b")).select("t", "b.*")
    for t, plain, html in df.collect():
        assert (plain, html) == ((None, None) if t is None else (markdown.to_plain(t), markdown.to_html(t)))


def test_records_are_given_on_by_characters(spark, monkeypatch):
    monkeypatch.setattr(splits, "MOST_CHARS", 10)
    rows = spark.createDataFrame([("f", 0, False, f"{i:08d}") for i in range(7)], "file string, begin long, more boolean, value string").coalesce(1)
    got = splits.placed(rows, lambda file, value: iter([value, value + "!"]), skip=1).collect()
    assert [r.pos for r in got] == list(range(13)) and got[0].json == "00000000!"


def test_scores_of_any_word_add_up_where_documents_lie(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 7}" for j in range(1, 9))) for i in range(60)], "doc long, text string")
    asked = spark.createDataFrame([(1, "w1 w5 w3 nothing"), (2, "w2 w6 zz"), (3, "w0 w0")], "q int, text string")
    index = search.build(docs, "doc", "text").written()
    shown = lambda: sorted(map(tuple, search.search(index, asked, "q", "text", 5).select("query", "doc", "score", "phrase", "rank").collect()))
    few = shown()
    plan = search._loose(index, search.query_terms(asked, "q", "text").select("query", "term").distinct(), asked.select(F.col("q").alias("query"), F.lit(2).alias("q_terms")), search._frequencies(index), 60)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query" not in plan and "hashpartitioning(doc#" in plan.replace("(doc ", "(doc#")
    monkeypatch.setattr(search, "FEW_TERMS", 0)
    assert shown() == few and len(few) == 15


def test_small_files_of_a_stream_share_tasks(spark, tmp_path):
    texts = {f"f{i}.yaml": f"a: é{i}\r\n" * (1 + i % 5) for i in range(150)}
    folder, packed = tmp_path / "in", tmp_path / "packed"
    folder.mkdir(), packed.mkdir()
    for name, text in texts.items():
        (folder / name).write_bytes(text.encode())
        (packed / f"{name}.gz").write_bytes(gzip.compress(text.encode()))
    tracker, setting = spark.sparkContext.statusTracker(), spark.conf.get("spark.sql.files.openCostInBytes")

    def run(path, glob, name):
        query = incremental.process_new_files(spark, f"file://{path}", glob, lambda d: d, str(tmp_path / f"out-{name}"), str(tmp_path / f"cp-{name}"))
        query.awaitTermination()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(str(query.runId)) for s in tracker.getJobInfo(j).stageIds]
        return max((s.numTasks for s in stages if s), default=0), sorted(map(tuple, spark.read.parquet(str(tmp_path / f"out-{name}")).collect()))

    most, got = run(folder, "*.yaml", "plain")
    assert 0 < most <= 16 and got == sorted(texts.items())  # a file was a task when they were listed
    (folder / "late.yaml").write_text("b")
    most, got = run(folder, "*.yaml", "plain")
    assert 0 < most <= 16 and got == sorted([*texts.items(), ("late.yaml", "b")])
    assert run(packed, "*.gz", "packed")[1] == sorted((f"{name}.gz", text) for name, text in texts.items())
    assert spark.conf.get("spark.sql.files.openCostInBytes") == setting


def test_documents_of_small_files_share_a_batch(spark, monkeypatch):
    files = spark.createDataFrame([("a", "x: 1\n---\nx: 2\n"), ("b", ""), ("c", "x: 3\n")], "file string, content string").coalesce(1)
    batches = lambda df: [r.n for r in df.mapInArrow(lambda it: (blocks.pa.record_batch([blocks.pa.array([b.num_rows])], names=["n"]) for b in it if b.num_rows), "n long").collect()]
    made = blocks.parsed_yaml(files, "x int")
    assert [tuple(r) for r in made.select("file", "pos", "doc.x").collect()] == [("a", 0, 1), ("a", 1, 2), ("c", 0, 3)]
    assert batches(made.select("file")) == [3]
    monkeypatch.setattr(blocks.splits, "MOST_CHARS", 5)
    assert [tuple(r) for r in blocks.parsed_yaml(files, "x int").select("file", "pos", "doc.x").collect()] == [("a", 0, 1), ("a", 1, 2), ("c", 0, 3)]


def test_scripts_are_counted_by_runs(spark):
    odd = ["", None, "Aé ÉΩ\n\x00ǅ", "かナｦㇰーヿ・゠゛", "口人日入桃㐀鿿ロ", "　、。〇々ー", "𠀀𝐀😀か" * 3, "a、" * 200_000 + "か桃Z", "\u3040\u30ff\u4dff\ufdd0\uffff"]
    df = spark.createDataFrame(list(enumerate(odd)), "k int, t string")
    got = df.select(T.upper_count("t"), T.kana_count("t"), T.kana_count("t", T.KANA_LOOKALIKES), T.kanji_count("t"), T.kanji_count("t", T.KANJI_LOOKALIKES), T.has_japanese("t")).collect()
    for text, row in zip(odd, got, strict=True):
        t = text or ""
        kana, kanji = re.findall(f"[{T.KANA}]", t), re.findall(f"[{T.KANJI}]", t)
        upper = None if text is None else sum(unicodedata.category(c) == "Lu" for c in t)
        few = (sum(c not in T.KANA_LOOKALIKES for c in kana), sum(c not in T.KANJI_LOOKALIKES for c in kanji))
        assert tuple(row) == (upper, len(kana), few[0], len(kanji), few[1], bool(re.search("[\u3040-\u30ff\u4e00-\u9fff]", t)))
    long = spark.range(8).select(F.repeat(F.concat(F.lit("Plain words, été. "), F.col("id").cast("string")), 50_000).alias("t"))

    def seconds(count):
        took = []
        for _ in range(3):
            began = time.perf_counter()
            long.select(F.sum(count)).collect()
            took.append(time.perf_counter() - began)
        return min(took)

    for chars, count in ((T.KANA, T.kana_count("t")), (T.KANJI, T.kanji_count("t"))):
        assert seconds(count) < 0.7 * seconds(F.length(F.regexp_replace("t", f"[^{chars}]", "")))
