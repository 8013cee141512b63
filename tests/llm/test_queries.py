"""The queries over the driver's tables against SQL or brute force, and the pipeline against its parts."""

from __future__ import annotations

import math
import re

import numpy as np
import pytest
from differential import duck, same
from pyspark.sql import functions as F
from test_operators import brute_components, brute_substrings, least_distance

import corpus_pipeline
from lectern.llm import common, decontaminate, language, line_dedup, mixing, ngram_join, quality, queries, secrets
from lectern.llm.common import table


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, sf_dir, name):
    same(queries.QUERIES[name](spark, sf_dir), duck(sf_dir), queries.ORACLE[name])


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}


def test_substring_query(spark, sf_dir, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op1_substring_dedup(spark, sf_dir).collect()}
    assert got == brute_substrings([(i, t or "") for i, t in texts.items()])


def statistics_of(text):
    """The statistics of ``quality`` in Python."""
    t = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", t) if w]
    n, chars = max(len(words), 1), max(len(t), 1)
    import unicodedata

    kind = [unicodedata.category(c) for c in t]
    return [
        sum(k[0] == "L" for k in kind) / chars, sum(k == "Lu" for k in kind) / chars, sum("0" <= c <= "9" for c in t) / chars, sum(c in "*%$#&@~^+=_<>" for c in t) / chars,
        sum(c in "|\\/" for c in t) / chars, sum(c in "!?" for c in t) / chars, len(t) / n, math.log1p(len(set(words))) / math.log1p(n), sum(x == y for x, y in zip(words, words[1:], strict=False)) / n,
    ]


def test_quality_query(spark, sf_dir, texts):
    """Scores are the model's weights over statistics made in Python; held-out labels are met."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train_on(docs, labels)
    ids = sorted(texts)
    x = np.array([statistics_of(texts[i]) for i in ids])
    margin = np.full(len(ids), model.intercept)
    for rule, weight in zip(model.rules, model.weights, strict=True):
        holds = np.ones(len(ids), bool)
        for c in rule:
            holds &= (x[:, c.feature] > c.bound) == c.above
        margin += weight * holds
    out = {r.doc_id: r for r in queries.op2_quality_rules(spark, sf_dir).collect()}
    assert np.allclose([out[i].score for i in ids], 1 / (1 + np.exp(-margin)))
    import zlib

    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and out[i].predicted == (out[i].score >= 0.3) for i in ids)
    held = [(out[r.doc_id].predicted, r.quality) for r in labels.collect() if r.doc_id in out and out[r.doc_id].held_out]
    assert sum(p == q for p, q in held) >= 0.8 * len(held)


def test_secret_query(spark, sf_dir, texts):
    for r in queries.op3_secret_scan(spark, sf_dir).collect():
        assert r.base_sha256 == secrets.digest_of(secrets.brute_force(texts[r.doc_id]))


def test_ngram_query(spark, sf_dir, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op5_ngram_join(spark, sf_dir).collect()}
    assert got == brute_components(list(texts.items()))


def subwords(text, n):
    """The n bytes from each position of a text between two spaces, that lie in a word or take a space with it."""
    letters = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in f" {text.lower()} ".encode())
    for p in range(len(letters) - n + 1):
        g = letters[p : p + n]
        if 32 not in g[1:-1] and not (g[0] == 32 and g[1] == 32):
            yield g


def bucket(g):
    code = len(g)
    for j, b in enumerate(g):
        code = (code << 8 | b) & 0xFFFFFFFF if len(g) < 4 or j else b
    code ^= code >> 15
    code = code * 0x2C1B3C6D & 0xFFFFFFFF
    code ^= code >> 12
    return (code * 0x297A2D39 & 0xFFFFFFFF) >> 32 - language.BUCKET_BITS


def test_language_query(spark, sf_dir, texts):
    """Scores are a forward pass over subwords made in Python: mean embedding, linear layer, tempered softmax."""
    model = language.train_on(table(spark, sf_dir, "documents"))
    out = {r.doc_id: r for r in queries.op8_language_id(spark, sf_dir).collect()}
    assert len(out) == len(texts)
    for i in sorted(texts)[::3]:
        text = texts[i] or ""
        if not any(c.isalpha() for c in text):
            assert (out[i].lang_pred, out[i].score) == ("und", 0.0)
            continue
        ids = [bucket(g) for n in language.GRAMS for g in subwords(text, n)]
        z = (model.embeddings[ids].mean(0) @ model.weights + model.bias) / model.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        assert abs(out[i].score - p.max()) < 1e-3 and (out[i].lang_pred == model.langs[int(p.argmax())] or np.sort(p)[-2] > p.max() - 1e-3)


def test_leak_query(spark, sf_dir, texts):
    """Every item that occurs exactly is found, and what is found is within its budget; distances are the least."""
    items = [(r.item_id, decontaminate.item_of(r.item_id, r.text)) for r in table(spark, sf_dir, "benchmark").collect()]
    items = {k: x for k, x in items if x.text}
    folded = {i: decontaminate.folded(t) for i, t in texts.items()}
    got = {(r.doc_id, r.item_id): r.distance for r in queries.op9_decontamination(spark, sf_dir).collect()}
    assert {(i, k) for i, t in folded.items() for k, x in items.items() if x.text in t} <= set(got)
    for (i, k), distance in got.items():
        assert distance <= items[k].budget and distance == least_distance(items[k].text, folded[i])
    # Of pairs that aren't found, those whose texts share a quarter of the item's words are compared whole.
    words = {k: set(x.text.split()) for k, x in items.items()}
    near = [(i, k) for i, t in folded.items() for own in [set(t.split())] for k in items if (i, k) not in got and len(own & words[k]) >= 0.25 * len(words[k]) and len(t) < 3000]
    for i, k in near[:150]:
        assert least_distance(items[k].text, folded[i]) > items[k].budget


def test_pipeline(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir)
        assert after.columns == docs.columns, name
        assert after.count() <= before.count() and after.select("doc_id").distinct().count() == after.count()
        before = after.cache()
    assert decontaminate.leaks(before, table(spark, sf_dir, "benchmark")).count() == 0
    assert ngram_join.jaccard_components(before).where("component_id <> doc_id").count() == 0
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.select("doc_id").distinct().join(before, "doc_id", "left_anti").count() == 0
    assert out.groupBy("doc_id").agg(F.max("replica") == F.count("*")).where("not `(max(replica) = count(1))`").count() == 0


def brute_stages(docs, labels, bench, model):
    """The first four stages over rows {doc_id: (text, source)} in Python."""
    score = lambda t: 1 / (1 + math.exp(-(model.intercept + sum(w for r, w in zip(model.rules, model.weights, strict=True) if all((statistics_of(t)[c.feature] > c.bound) == c.above for c in r)))))
    docs = {i: x for i, x in docs.items() if score(x[0]) >= quality.THRESHOLD}
    yield docs
    trim = lambda x: x.strip(" \t\r")
    sites, first = {}, {}
    for i, (text, source) in sorted(docs.items()):
        for p, x in enumerate((text or "").split("\n")):
            if len(trim(x)) >= line_dedup.MIN_CHARS:
                sites.setdefault(trim(x), set()).update({source} - {None})
                first.setdefault(trim(x), (i, p))
    gone = lambda i, p, x: len(sites.get(trim(x), ())) >= line_dedup.MIN_SITES and first[trim(x)] != (i, p)
    docs = {i: (t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if not gone(i, p, x)), s) for i, (t, s) in docs.items()}
    yield docs
    part = brute_components([(i, t) for i, (t, _) in docs.items()])
    docs = {i: x for i, x in docs.items() if part[i][1] == i}
    yield docs
    items = [decontaminate.item_of(r.item_id, r.text) for r in bench]
    matcher = decontaminate.Matcher(items)
    docs = {i: x for i, x in docs.items() if not matcher.find(decontaminate.folded(x[0]))}
    yield docs


def test_pipeline_against_brute_force(spark, sf_dir):
    before = table(spark, sf_dir, "documents")
    labels, bench = table(spark, sf_dir, "labels"), table(spark, sf_dir, "benchmark").collect()
    want = brute_stages({r.doc_id: (r.text, r.source) for r in before.collect()}, labels, bench, quality.train_on(before, labels))
    for (name, stage), rows in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        before = stage(spark, before, sf_dir).cache()
        assert {r.doc_id: (r.text, r.source) for r in before.collect()} == rows, name
        assert all(r.n_chars == len(r.text) for r in before.collect() if r.text is not None), name
    sizes = {}
    for r in before.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text or "")
    listed = {s: n for s, n in sizes.items() if s in mixing.EQUAL}
    some = sum(1 for n in listed.values() if n)
    import hashlib

    draws = {r.doc_id: int(hashlib.md5(f"7:{r.doc_id}".encode()).hexdigest()[:13], 16) / (1 << 52) for r in before.collect()}
    rate = {s: sum(listed.values()) / some / n if n else 0.0 for s, n in listed.items()}
    count = {r.doc_id: sum(draws[r.doc_id] >= p for p in mixing.poisson_steps(rate.get(r.source, 1.0))) for r in before.collect()}
    out = corpus_pipeline.run(spark, sf_dir)
    assert sorted((r.doc_id, r.replica) for r in out.collect()) == sorted((i, k) for i, n in count.items() for k in range(1, n + 1))


def test_stages_of_awkward_tables(spark, sf_dir):
    """Nulls in any column, empty texts, repeated rows and ids, extra columns of clashing names, empty tables."""
    body = "The same plain words stand in both of these texts, and a few more of them follow here."
    rows = [(1, body, "en", "src1", 5), (1, body, "en", "src1", 5), (2, body + " End", None, None, None), (None, body, "en", "src2", 5), (None, None, None, None, None), (3, None, "en", "src1", 0), (4, "", "en", "src1", 0), (5, "x y z", "en", "src3", 3)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, kind)
    for extra in (docs, docs.withColumns({c: F.lit(1) for c in ("quality_score", "replica", "__row", "__doc", "n_removed", "gone", "a.b")})):
        # A model of the driver's labels would reject such texts; what is tested is that each stage takes any table.
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, extra, sf_dir)
            n = out.count()
            assert n <= len(rows) or name == "source_mix", name
            assert stage(spark, extra.limit(0), sf_dir).count() == 0, name
    assert line_dedup.without_boilerplate(docs).count() == len(rows)
    assert sorted(str(r.doc_id) for r in ngram_join.without_near_copies(docs).collect()) == sorted(["1", "1", "None", "None", "3", "4", "5"])
    bench = spark.createDataFrame([(1, "few more of them follow here")], "item_id long, text string")
    assert sorted(str(r.doc_id) for r in decontaminate.decontaminated(docs.withColumn("a.b", F.lit(1)), bench).collect()) == ["3", "4", "5", "None"]
    more = spark.createDataFrame([(1, "few more of them follow here"), (2, "x y z"), (3, "nothing of the kind")], "item_id long, text string")
    for block in (5, 10**6):
        assert sorted(str(r.doc_id) for r in decontaminate.decontaminated(docs.withColumn("a.b", F.lit(1)), more, block_chars=block).collect()) == ["3", "4", "None"]
        assert decontaminate.leaks(docs, more, block_chars=block).count() == 5
    mixed = mixing.mix(docs.withColumn("a.b", F.lit(1)).withColumn("replica", F.lit("x")), {"src1": 1.0})
    assert mixed.columns == [*docs.columns, "a.b", "replica", "shuffle_key"] and mixed.schema["replica"].dataType.simpleString() == "int"


#: What a worker may use besides a text of 20 MB, as a multiple of it.
MOST = 20


@pytest.mark.parametrize("what", ["prose", "one word", "hex"])
def test_memory_for_a_very_long_text(what):
    import tracemalloc

    import pyarrow as pa

    n = 20_000_000
    text = {"prose": "wort für wort steht hier etwas ", "one word": "wort", "hex": "0123456789abcdef"}[what]
    text = (text * (n // len(text) + 1))[:n]
    array = pa.array([text])
    table_ = np.zeros((language.BUCKETS, 4), np.float32)
    engine = secrets.scanner()
    steps = {
        "gram_sets": lambda: sum(len(g) for g in ngram_join.gram_sets(array)),
        "mean_logits": lambda: language.mean_logits(language.padded(array), table_),
        "secrets": lambda: engine.spans(text.encode()),
    }
    for name, step in steps.items():
        common.POWERS.to(2)
        tracemalloc.start()
        step()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < MOST * n, (name, peak / n)
