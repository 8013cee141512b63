"""Lexical search, toxicity and conversation repair against brute force, and on awkward tables."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import lexical, line_dedup, ngram_join, repair, toxicity
from lectern.llm.common import fold, table

TERM = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_ranks(docs, items, top):
    """docs: {key: terms}; items: {id: terms}; rows of (item, rank, doc, score)."""
    docs = {k: t for k, t in docs.items() if t}
    df = Counter(t for terms in docs.values() for t in set(terms))
    n, total = len(docs), sum(map(len, docs.values()))
    out = []
    for item, asked in items.items():
        scores = []
        for key, terms in docs.items():
            tf, m = Counter(terms), 10 + 90 * len(terms) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in set(asked) if tf[t])
            if s > 0:
                scores.append((-s, key))
        out += [(item, rank, key[0], -s) for rank, (s, key) in enumerate(sorted(scores, key=lambda x: (x[0], x[1][0] is None, x[1][0] or 0, x[1][1]))[:top], 1)]
    return out


def ranks(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_ranked(spark):
    rng = random.Random(5)
    vocabulary = ["the", "The", "été", "ÉTÉ", "x1", "日本", "a", "rare", "İ", "b_c"]
    texts = [(k, " ".join(rng.choices(vocabulary, [20, 9, 5, 4, 3, 3, 5, 1, 1, 2], k=rng.randrange(0, 30)))) for k in range(60)]
    texts += [(3, "rare again"), (3, "rare again"), (None, "the rare"), (None, "the rare"), (None, "x1"), (70, None), (71, ""), (72, " ,; ")]
    items = [(1, "the rare été"), (2, "日本 X1 b"), (2, "c"), (3, "absent"), (4, None), (5, "..."), (None, "The the THE")]
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in texts], "doc_id long, text string, term int, score string")
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")
    by_key, by_item = {}, {}
    for i, t in texts:
        by_key.setdefault((i, "" if i is not None else hashlib.md5((t or "").encode()).hexdigest()), []).extend(terms_of(t))
    for i, t in items:
        by_item.setdefault(i, []).extend(terms_of(t))
    for top in (3, 100):
        assert ranks(lexical.ranked(docs, asked, top)) == sorted(brute_ranks(by_key, by_item, top), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_ranked_without_broadcasts(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"w{k % 3} w{k % 5} all") for k in range(40)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "w1 w2"), (2, "all w4")], "item_id long, text string")
    want = ranks(lexical.ranked(docs, items))
    monkeypatch.setattr(lexical, "BROADCAST_IDS", 0)
    assert ranks(lexical.ranked(docs, items)) == want and len(want) == 20


def test_ranked_empty_and_long(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.ranked(docs.limit(0), items).count() == 0 == lexical.ranked(docs, items.limit(0)).count()
    long = spark.createDataFrame([(k, "word " * 1_000_000 if k == 0 else f"other {k}") for k in range(5)], "doc_id long, text string")
    got = ranks(lexical.ranked(long, spark.createDataFrame([(1, "word")], "item_id long, text string")))
    assert [r[:3] for r in got] == [(1, 1, 0)]


# Toxicity -------------------------------------------------------------------------------------------


def kneser_ney(counts, base, gram):
    """Interpolated probability of a gram's last byte, in one class: counts of each order by gram."""
    n = len(gram)
    if n == toxicity.SHARED:
        return base(gram)
    own = counts[n]
    total = sum(c for g, c in own.items() if g[:-1] == gram[:-1])
    kinds = sum(1 for g, c in own.items() if g[:-1] == gram[:-1] and c)
    below = kneser_ney(counts, base, gram[1:])
    if not total:
        return below
    once, twice = sum(c == 1 for c in own.values()), sum(c == 2 for c in own.values())
    d = min(max(once / (once + 2 * twice), 0.1), 0.95) if once else 0.5
    return (max(own.get(gram, 0) - d, 0) + d * kinds * below) / total


def test_log_ratios(spark):
    rng = np.random.default_rng(2)
    words = ["abra", "cadabra", "brac", "dab", "rad"]
    texts = {y: [" ".join(rng.choice(words, 6)) + (" zzq" if y and k % 2 else "") for k in range(6)] for y in (0, 1)}
    rows = spark.createDataFrame([(t, y, 0) for y in (0, 1) for t in texts[y]], "text string, y int, half int")
    got = toxicity.gram_counts(rows, "text", toxicity.ORDER, ["y", "half"]).collect()
    pack = lambda g: int.from_bytes(g, "big")
    counts = {}
    for y in (0, 1):
        top = Counter()
        for t in texts[y]:
            b = b" " * 40 + t.encode() + b" "
            seen = {b[i - 5 : i + 1] for i in range(5, len(b)) if b[i] != 32 or b[i - 1] != 32}
            top.update(seen)
        assert {r.gram: r.n for r in got if r.y == y} == {pack(g): n for g, n in top.items()}
        counts[y] = {6: top}
        for n in (5, 4):
            counts[y][n] = Counter(g[1:] for g, c in counts[y][n + 1].items() if c)
    four = toxicity.gram_counts(rows.select("text"), "text", toxicity.SHARED + 1).collect()
    three = Counter(r.gram & 0xFFFFFF for r in four)
    keys = np.array(sorted(three), np.uint64)
    model = toxicity.shared_model(keys, np.array([three[int(k)] for k in keys]))
    base = lambda g: float(toxicity._shared(model, np.array([pack(g)], np.uint64))[0])
    some = np.array(sorted({pack(g) for y in (0, 1) for g in counts[y][6]}), np.uint64)
    ratios = toxicity.log_ratios(some, np.array([[counts[1][6].get(int(k).to_bytes(6, "big"), 0), counts[0][6].get(int(k).to_bytes(6, "big"), 0)] for k in some]), model)
    text = b" " * 5 + b"abra zzq new dabrac"
    data = np.frombuffer(text, np.uint8)
    values = ratios.of(data)
    for i in range(5, len(text)):
        gram = text[i - 5 : i + 1]
        want = math.log(kneser_ney(counts[1], base, gram)) - math.log(kneser_ney(counts[0], base, gram)) if text[i] != 32 or text[i - 1] != 32 else 0
        assert values[i] == pytest.approx(want, abs=1e-4), gram


def test_shared_model_sums_to_one():
    grams = np.unique(np.random.default_rng(1).integers(97, 103, (60, 3)) @ np.array([65536, 256, 1])).astype(np.uint64)
    model = toxicity.shared_model(grams, np.arange(1, len(grams) + 1))
    for context in np.unique(grams >> np.uint64(8)):
        every = (int(context) << 8 | np.arange(256)).astype(np.uint64)
        # What no context had backs off with the mass that the seen ones gave up.
        seen = toxicity._shared(model, every)[np.isin(every, grams)]
        assert 0 < seen.sum() < 1.0000001
    last = toxicity._shared(model, np.arange(256).astype(np.uint64))
    assert (last > 0).all()


def test_table():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 1 << 48, 5000).astype(np.uint64))
    values = rng.normal(size=len(keys)).astype(np.float32)
    t = toxicity.Table(keys, values)
    hit, got = t.get(np.concatenate([keys, keys + np.uint64(1 << 50)]))
    assert hit[: len(keys)].all() and not hit[len(keys) :].any() and (got == values).all()
    hit, got = toxicity.Table(keys[:0], values[:0]).get(keys)
    assert not hit.any() and not len(got)


def test_pieces_of_long_texts(monkeypatch):
    rng = np.random.default_rng(6)
    ratios = toxicity.Ratios([(toxicity.Table(k := np.unique(rng.integers(0, 1 << 48, 10).astype(np.uint64)), np.ones(10)), toxicity.Table(k, np.ones(10)))])
    data = "".join(rng.choice(list("abc  ,"), 4000))
    full = toxicity.evidence(pa.array([data]), ratios)
    many = toxicity.evidence(pa.array(["ab", None, "", data, "x"]), ratios)
    assert np.allclose(full[0], many[3]) and (many[[1, 2]] == 0).all()
    monkeypatch.setattr(toxicity, "SLICE_BYTES", 300)
    assert abs(toxicity.evidence(pa.array([data]), ratios)[0, 1] - full[0, 1]) < 1e-3


def test_toxicity_query_on_made_labels(spark):
    """Held-out texts with a word that the training rows' toxic ones have are found, others left alone."""
    rng = random.Random(3)
    filler = ["stone", "river", "cloud", "green", "paper", "light", "seven", "house", "bread", "under"]
    rows = []
    for k in range(600):
        words = rng.choices(filler, k=rng.randrange(20, 120))
        if k % 4 == 0:
            words[rng.randrange(len(words))] = rng.choice(["grobulax", "frobnitz"])
        rows.append((k, " ".join(words), int(k % 4 == 0)))
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(None, "stone"), (900, None), (901, ""), (5, rows[5][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.train_on(docs, labels)
    got = [(r.doc_id, r.score) for r in toxicity.scored(docs, model).collect()]
    assert len(got) == 604 and all(0 <= s <= 1 for _, s in got)
    held = {r[0] for r in docs.where(fold("doc_id", 3) == 1).select("doc_id").collect()}
    wrong = [k for k, s in got if k in held and k < 600 and (s >= toxicity.THRESHOLD) != (k % 4 == 0)]
    assert len(wrong) <= 0.03 * len(held), wrong
    # Without both classes all have the share of toxic labels.
    one = toxicity.train_on(docs, labels.where("toxic = 0"))
    assert len({r.score for r in toxicity.scored(docs, one).collect()}) == 1
    assert toxicity.scored(docs.limit(0), model).count() == 0


def test_toxicity_of_long_text(spark):
    docs = spark.createDataFrame([(k, ("stone river grobulax " if k % 2 else "stone river bread ") * 20) for k in range(40)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS toxic")
    model = toxicity.train_on(docs, labels)
    long = spark.createDataFrame([(1, "stone river bread " * 150_000 + "grobulax grobulax grobulax grobulax"), (2, "stone river bread " * 150_000)], "doc_id long, text string")
    got = {r.doc_id: r.stretch for r in toxicity.scored(long, model).collect()}
    assert got[1] > got[2] + 0.1


# Repair ---------------------------------------------------------------------------------------------


def brute_plan(codes):
    """The least (cost, audit) by dynamic programming over whole audits; up to two inserts before each row and at the end."""
    best = {"": (0, "")}
    allowed = {"": "su", "s": "u", "u": "a", "a": "u"}

    def inserted(states):
        out = dict(states)
        for _ in range(2):
            for q, (c, a) in list(out.items()):
                for r in allowed[q]:
                    if r != "s" and (r not in out or (c + 2, a + "I") < out[r]):
                        out[r] = (c + 2, a + "I")
        return out

    for code in codes:
        after = {}
        for q, (c, a) in inserted(best).items():
            steps = [(q, 3, "D")]
            if code != "x":
                extra = int(code.isupper() or code == "_")
                steps += [(r, (0 if r == code.lower() else 2) + extra, "K" if r == code.lower() else "R") for r in allowed[q] if r == code.lower() or r != "s"]
            for r, price, letter in steps:
                if r not in after or (c + price, a + letter) < after[r]:
                    after[r] = (c + price, a + letter)
        best = after
    ends = inserted(best)
    return min(ends[q] for q in ("", "a") if q in ends)


def test_cheapest_edits():
    for n in range(6):
        for codes in itertools.product("suaUx-", repeat=n) if n < 5 else random.Random(1).sample(list(itertools.product("suaSUA_x-", repeat=5)), 1500):
            assert repair.cheapest("".join(codes)) == brute_plan("".join(codes)), codes


def test_pieces_give_the_same():
    rng = random.Random(2)
    for _ in range(60):
        codes = "".join(rng.choices("suaSUA_x-", k=rng.randrange(1, 40)))
        want = brute_plan(codes)
        assert all(repair.cheapest(codes, piece) == want for piece in (1, 2, 5, 128)), codes


def test_long_conversation():
    began = time.time()
    cost, audit = repair.cheapest("ua" * 20_000 + "u")
    assert cost == 2 and audit == "K" * 40_001 + "I" and time.time() - began < 30


def test_repair(spark):
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (1, 3, "user", "cut off"), (1, 4, "assistant", " \t"),
        (2, None, None, "What?"), (2, None, "assistant", None), (None, 1, "user", "a."), (None, 0, "system", "b!"), (4, 7, "tool", "x."), (5, 1, "", "y."),
    ]
    said = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, audit string")
    every = spark.createDataFrame([(k,) for k in (1, 2, None, 4, 5, 9, 9)], "conv_id long")
    got = {r.conv_id: r for r in repair.repair(said, every=every).collect()}
    assert set(got) == {1, 2, None, 4, 5, 9}
    sha = lambda *lines: hashlib.sha256("\n".join(lines).encode()).hexdigest()
    r = got[1]
    assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal) == (1, 1, 1, 1, 1)
    assert (r.cost, r.audit) == brute_plan("uaxUx")
    assert (got[9].gaps, got[9].cost, got[9].audit, got[9].repaired_sha256) == (0, 0, "", sha())
    assert (got[2].gaps, got[2].blank, got[2].cost, got[2].audit) == (0, 1, *brute_plan("-x"))
    assert got[None].audit == "KKI" and got[None].repaired_sha256 == sha("system:b!", "user:a.", "assistant:")
    assert (got[4].cost, got[4].audit) == brute_plan("-") == (got[5].cost, got[5].audit)
    assert repair.repair(said.limit(0)).count() == 0


def test_repaired_rows(spark):
    said = spark.createDataFrame([(1, k, "user", f"t{k}.") for k in range(3000)], "conv long, turn long, role string, text string")
    marked = repair.faults(said)
    plan = repair.plans(marked)
    out = repair.repaired_rows(marked, plan).orderBy("seq").collect()
    assert [r.role for r in out] == ["user", "assistant"] * (len(out) // 2) and len(out) % 2 == 0
    assert plan.first().cost == brute_plan("u" * 3000)[0]


# Earlier operators ----------------------------------------------------------------------------------


def test_many_boilerplate_lines(spark):
    lines = "\n".join(f"boilerplate line {k}" for k in range(50_000))
    docs = spark.createDataFrame([(k, lines, f"s{k}") for k in range(10)], "doc_id long, text string, source string").repartition(4)
    line_dedup.without_boilerplate(docs.limit(2)).collect()
    began = time.time()
    got = {r.doc_id: (r.n_lines, r.n_removed, len(r.text)) for r in line_dedup.without_boilerplate(docs).collect()}
    assert time.time() - began < 30
    assert got == {k: (50_000, 0, len(lines)) if k == 0 else (50_000, 50_000, 0) for k in range(10)}


def test_repeated_ids_with_other_texts(spark):
    """Rows of one id but unlike texts lose each its own lines."""
    bad = "a line of many sites"
    rows = [(k, bad, f"s{k}") for k in range(12)] + [(3, f"own words here\n{bad}", "s1"), (3, f"{bad}\n{bad}\nown", "s2"), (0, f"first\n{bad}\n{bad}", "s3"), (3, None, "s1")]
    got = sorted((r.doc_id, r.text or "-", r.n_removed) for r in line_dedup.without_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())
    want = [(0, bad, 0), (0, f"first\n{bad}", 1), (3, "own words here", 1), (3, "own", 2), (3, "-", 0), (3, "", 1)] + [(k, "", 1) for k in range(1, 12) if k != 3]
    assert got == sorted((i, t or "-", n) for i, t, n in want)


@pytest.mark.parametrize("step", [1, 7, 64, 100_000])
def test_word_hashes(step):
    text = "a".encode()
    for _ in range(10):
        text += text.translate(bytes.maketrans(b"ab", b"ba"))
    words = [text, text.translate(bytes.maketrans(b"ab", b"ba")), text, b"a", b"b", b"ab", b"ba", b"a"]
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    found = ngram_join.word_hashes(data, starts, ends, step).tolist()
    assert len(set(found)) == len(set(words)) and all((a == b) == (x == y) for a, x in zip(found, words) for b, y in zip(found, words))


def test_thue_morse_texts_are_not_linked(spark):
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, word), (2, word.translate(str.maketrans("ab", "ba")))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs).collect()} == {1: 1, 2: 2}


def test_toxicity_query(spark, sf_dir):
    from lectern.llm import queries

    got = queries.op11_toxicity(spark, sf_dir).collect()
    assert len(got) == table(spark, sf_dir, "documents").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
