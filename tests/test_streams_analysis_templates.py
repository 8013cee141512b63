"""Record streams in ranges, found indexes, morphological analysis and templates."""

from __future__ import annotations

import os
import random
import subprocess
import sys
import textwrap

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from lectern.operators import analysis, search, stats
from lectern.sources import blocks, splits, tabular, templates


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_one_stream_is_read_by_many_tasks(spark, tmp_path, small_ranges):
    docs = ["a: %d\ntext: |\n  %s\n" % (k, "word " * (k % 40)) if k % 7 else "# nothing\n" for k in range(600)]
    (tmp_path / "one.yaml").write_text("---\n" + "---\n".join(docs))
    raw = splits.records(spark, str(tmp_path), "*.yaml", blocks.SEPARATOR)
    assert raw.rdd.getNumPartitions() > 8
    got = blocks.read_yaml(spark, str(tmp_path), "a int, text string").orderBy("pos").collect()
    assert [r.doc.a for r in got] == [k for k in range(600) if k % 7] and len({r.pos for r in got}) == len(got)


def test_stream_of_records_comes_back(spark, tmp_path, small_ranges):
    rows = [(k, t) for k, t in enumerate(["---", "\n---\n", "a\n---\nb", "", None, "x: [", "'\"\\", "\u2028 \t", "*alias", "&a\x85\x7f\x90\ufeff\uffff😀"] * 30)]
    blocks.write_stream(spark.createDataFrame(rows, "k int, t string").select(F.struct("k", "t").alias("block")), f"{tmp_path}/s")
    got = blocks.read_yaml(spark, f"{tmp_path}/s", "k int, t string", "*.txt").select("doc.*").collect()
    assert sorted((r.k, r.t) for r in got) == rows


def test_carriage_returns_keep_documents(spark, tmp_path):
    (tmp_path / "w.yaml").write_bytes(b"a: 1\r\n---\r\na: 2\r\n--- # more\r\na: 3\r\n")
    got = blocks.read_yaml(spark, str(tmp_path), "a int").orderBy("pos").collect()
    assert [(r.pos, r.doc.a) for r in got] == [(0, 1), (1, 2), (2, 3)]


def test_delimited_lines_in_ranges(spark, tmp_path, small_ranges):
    for name in ("a", "b"):
        (tmp_path / f"{name}.txt").write_text("# one\n# two\n" + "".join(f"{name}.{k}.x\n" for k in range(900)))
    got = tabular.read_delimited(spark, str(tmp_path), ["f", "k", "x", "none"], sep=".", skip=2)
    rows = got.orderBy("file", "pos").collect()
    assert [(r.f, int(r.k), r.x, r.none) for r in rows] == [(n, k, "x", None) for n in "ab" for k in range(900)]


def test_skipped_lines_beyond_the_first_range(spark, tmp_path, small_ranges):
    (tmp_path / "a.txt").write_text("line\n" * 5000)
    with pytest.raises(PythonException, match="first range"):
        tabular.read_delimited(spark, str(tmp_path), ["x"], skip=4000).count()


def test_index_is_of_all_rows_of_its_files(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    spark.createDataFrame([(k, f"w{k} all") for k in range(20)], "id long, t string").write.parquet(path)
    assert search.opened(spark, path, "id", "t").docs.count() == 20
    found = search.opened(spark, path, "id", "t")
    assert found.docs.count() == 20 and found.postings.select("term").distinct().count() == 21
    spark.createDataFrame([(90, "other")], "id long, t string").write.mode("append").parquet(path)
    assert search.opened(spark, path, "id", "t").docs.count() == 21


def test_shared_folder_without_setting(tmp_path):
    """A plain local session that names no folder gets one of its own, again and again the same."""
    code = """
        from pyspark.sql import SparkSession
        from lectern.operators._store import shared_folder, stored
        spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
        assert spark.conf.get("spark.checkpoint.dir", None) is None
        assert stored(spark.range(3)).count() == 3 and shared_folder(spark) == shared_folder(spark)
        print("fine")
    """
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip() == "fine", done.stderr[-2000:]


# Analysis -------------------------------------------------------------------------------------------

NOUN, PARTICLE, VERB = "名詞-一般", "助詞", "動詞"
ENTRIES = [
    ("すもも", "すもも", NOUN, "スモモ", 0, 0, 300), ("もも", "もも", NOUN, "モモ", 0, 0, 300), ("も", "も", PARTICLE, "モ", 1, 1, 100), ("の", "の", PARTICLE, "ノ", 1, 1, 100), ("うち", "うち", NOUN, "ウチ", 0, 0, 300),
    ("東京", "東京", f"{stats.PROPER}地域", "トウキョウ", 2, 2, 200), ("京都", "京都", f"{stats.PROPER}地域", "キョウト", 2, 2, 200), ("東", "東", NOUN, "ヒガシ", 0, 0, 500), ("都", "都", NOUN, "ト", 0, 0, 400), ("行った", "行く", VERB, "イッタ", 3, 3, 300), ("に", "に", PARTICLE, "ニ", 1, 1, 100),
]
JOINS = {(0, 1): 10, (1, 0): 10, (1, 3): 10, (2, 1): 10, (0, 0): 400, (2, 0): 100, (1, 1): 500}


def test_analysed_japanese(spark):
    entries = spark.createDataFrame(ENTRIES, analysis.ENTRY)
    texts = spark.createDataFrame([(1, "すもももももももものうち"), (2, "東京都に行った。ABCも"), (3, None), (4, ""), (5, "。 "), (1, "も")], "id long, t string")
    got = analysis.analysed(texts, "id", "t", entries, JOINS, 50)
    rows = [tuple(r) for r in got.orderBy("doc", "unit_no", "token_no").select("doc", "unit_no", "term", "base", "pos").collect()]
    assert "".join(r[2] for r in rows if r[0] == 1 and r[1] == 0).startswith("すもも")
    assert [r[2:] for r in rows if r[0] == 2] == [("東京", "東京", f"{stats.PROPER}地域"), ("都", "都", NOUN), ("に", "に", PARTICLE), ("行った", "行く", VERB), ("abc", None, analysis.UNKNOWN), ("も", "も", PARTICLE)]
    assert {r[0] for r in rows} == {1, 2}
    plum = got.where("doc = 1").groupBy("unit_no", "token_no").agg(F.collect_list("term").alias("t")).count()
    assert plum == 7
    keys = {r["k"] for r in got.where(~analysis.is_proper()).select(analysis.term_key().alias("k")).collect()}
    assert f"行く|{VERB}" in keys and not any(k.startswith("東京") for k in keys)
    # Index and queries are cut alike: the base form is found from another form.
    index = search.of_terms(analysis.ordered(got)).written()
    asked = analysis.ordered(analysis.analysed(spark.createDataFrame([(9, "東京都")], "id long, t string"), "id", "t", entries, JOINS, 50))
    assert [(r["doc"], r.phrase) for r in search.search(index, asked, "doc", "terms", 5, None).collect()] == [(2, True)]


def brute_path(words, joins, default, end):
    """All paths, by cost; the least cost is unique or any path of it counts."""
    best = {}

    def walk(at, before, cost, path):
        if at == end:
            best.setdefault(cost + joins.get((before, analysis.EDGE), default), []).append(path)
            return
        for w in words:
            if w["start"] == at:
                walk(w["end"], w["right"], cost + joins.get((before, w["left"]), default) + w["cost"], [*path, (w["start"], w["end"], w["right"])])

    walk(0, analysis.EDGE, 0, [])
    least = min(best)
    return best[least]


def test_best_path():
    rng = random.Random(4)
    for _ in range(150):
        n = rng.randrange(1, 8)
        words = {(s, e, c): {"start": s, "end": e, "left": c, "right": c, "cost": rng.randrange(1, 6)} for s in range(n) for e in range(s + 1, min(n, s + 3) + 1) for c in rng.sample(range(3), 2)}
        joins = {(a, b): rng.randrange(4) for a in range(-1, 3) for b in range(-1, 3)}
        got = [(w["start"], w["end"], w["right"]) for w in analysis.best_path(list(words.values()), joins, 2)]
        ways = brute_path(list(words.values()), joins, 2, n)
        assert got in ways and len(got) == min(map(len, ways))


def test_best_paths_of_many_runs():
    """Runs that go forward together are cut as each is by itself, ties and classes without costs too; costs that are too large for one number as well."""
    rng = random.Random(5)
    for scale in (1, 1, 1, 1, 1 << 40):
        runs, joins = [], {(a, b): rng.randrange(4) for a in range(-2, 3) for b in range(-2, 2) if rng.random() < 0.8}
        for _ in range(60):
            n = rng.randrange(1, 12)
            words = {(s, e, a, b): {"start": s, "end": e, "left": a, "right": b, "cost": rng.randrange(-1, 4) * scale} for s in range(n) for e in range(s + 1, min(n, s + 4) + 1) for a, b in [(rng.randrange(-2, 4), rng.randrange(-2, 4)) for _ in range(2)]}
            runs.append(sorted(words.values(), key=lambda w: (w["start"], w["left"])))
        rows = [(k, w) for k, words in enumerate(runs) for w in words]
        table = {c: np.array([w[c] for _, w in rows]) for c in ("start", "end", "left", "right", "cost")}
        on = analysis.best_paths(np.array([k for k, _ in rows]), table, analysis._Costs(joins, 2))
        got = [[w for (k, w), x in zip(rows, on, strict=True) if x and k == n] for n in range(len(runs))]
        assert got == [analysis.best_path(words, joins, 2) for words in runs]


def test_lattice_in_parts_and_batches(spark, monkeypatch):
    """A dictionary in parts and few words at once give the same words; an entry's length is found by its first characters."""
    known = [("abcd", 300), ("abcdefgh", 10), ("abcdef", 900), ("cd", 40), ("efgh", 300), ("gh", 20), ("x", 5)]
    entries = spark.createDataFrame([(w, w, NOUN, w, k % 2, k % 2, c) for k, (w, c) in enumerate(known)], analysis.ENTRY)
    texts = spark.createDataFrame([(k, t) for k, t in enumerate(["abcdefgh", "abcdef", "xabcdgh", "xxcdefg", "q", "abcdabcdefghx"] * 2)], "id long, t string")
    cut = lambda: sorted((r.doc, r.unit_no, r.token_no, r.term, r.pos) for r in analysis.analysed(texts, "id", "t", entries, JOINS, 50).collect())
    want = cut()
    assert [r[3] for r in want if r[0] == 0] == ["abcdefgh"] and [r[3] for r in want if r[0] == 5] == ["abcd", "abcdefgh", "x"]
    monkeypatch.setattr(analysis, "WORDS_AT_ONCE", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    assert cut() == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(analysis, "FEW_ENTRIES", 2)
    assert cut() == want


def test_unknown_and_long_runs(spark):
    entries = spark.createDataFrame([], analysis.ENTRY)
    texts = spark.createDataFrame([(1, "カタカナ漢字かな12" + "x" * 1000)], "id long, t string")
    got = analysis.analysed(texts, "id", "t", entries, {}, 0).orderBy("unit_no", "token_no").collect()
    assert [r.term for r in got][:4] == ["カタカナ", "漢字", "かな", "12"] and sum(len(r.term) for r in got) == 1010
    assert {r.pos for r in got} == {analysis.UNKNOWN} and max(r.unit_no for r in got) == 2


def test_kinds_from_each_character(spark):
    """A run of one kind needs no pattern at each character; the long mark is of two kinds."""
    units = ["abcé" * 8, "ーアーー", "aーア", "漢々字かな", "12٣a", "ー", "かなx" * 9, "𠀀𠀁a", "ªº½"]
    runs = spark.createDataFrame(list(enumerate(units)), "id long, unit string")
    known = spark.createDataFrame([], "surface string, left int, right int, cost int")
    got = {(r.id, r.start): r.n for r in analysis.lattice(runs, known).groupBy("id", "start").agg(F.max(F.col("end") - F.col("start")).alias("n")).collect()}
    one = runs.select("id", "unit", F.explode(F.sequence(F.lit(0), F.length("unit") - 1)).alias("start")).select("id", "start", F.length(F.regexp_extract(F.substring(F.col("unit"), F.col("start") + 1, F.lit(24)), analysis.KINDS, 0)).alias("n"))
    assert got == {(r.id, r.start): r.n for r in one.collect()}


# Templates ------------------------------------------------------------------------------------------


def test_template(spark):
    rows = spark.createDataFrame(
        [("f", 2, "b", None, ["y"], {"en": "two"}, 61_000_000), ("f", 1, "a", True, [], None, None), ("g", 1, None, False, None, {}, 0)],
        "file string, pos int, name string, flag boolean, tags array<string>, refs map<string,string>, at long",
    )
    t = """{{ file_heading }}:{{ for b in blocks }}
{{ b_index }}{{ b.name }}{{ if b.flag }}!{{ else }}?{{ end }}{{ for t in b.tags }}[{{ t }}{{ b.name }}{{ t_index }}]{{ end }}{{ b.refs.en }}{{ b.refs.de }}{{ b.none.deep }}{{ none }}{{ for x in none }}no{{ end }}
   {{- if b.refs }} refs{{ end }}{{ format_timecode b.at }}{{ double b.name }}{{ double none }}{{ render_image b.name "pics" }}{{ end }}"""
    got = {r.file: r.content for r in templates.rendered(rows, t, functions={"double": lambda c: F.concat(c, c)}).collect()}
    assert got == {"f": "f:\n0a!aa![](pics/a)\n1b?[yb0]two refs00:01:01bb![](pics/b)", "g": "g:\n0?00:00:00"}
    assert templates.rendered(rows.limit(0), t).count() == 0


@pytest.mark.parametrize("bad", ["{{ end }}", "{{ for x in y }}", "{{ if a }}{{ else }}{{ else }}{{ end }}", "{{ for x }}{{ end }}", "{{ else }}"])
def test_bad_templates(bad):
    with pytest.raises(ValueError):
        templates.parsed(bad)
