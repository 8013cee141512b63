from __future__ import annotations

import random

import pytest

from lectern.operators import intervals
from lectern.operators.intervals import Timed

SCHEMA = "file string, pos long, ordinal int, start_us long, end_us long, text string"


def test_very_long_intervals(spark):
    import random

    from lectern.operators.intervals import Timed, overlapping

    rng = random.Random(1)
    made = lambda n: [("f", k, s, s + rng.choice([1, 50, 700, 10**6, 10**10])) for k in range(n) for s in [rng.randrange(10**7)]]
    a, b = made(60), made(60)
    df = lambda x: spark.createDataFrame(x, "file string, pos long, start_us long, end_us long")
    got = [(r.a_pos, r.b_pos) for r in overlapping(Timed().prefixed(df(a), "a"), Timed().prefixed(df(b), "b"), 10).collect()]
    assert sorted(got) == sorted((x[1], y[1]) for x in a for y in b if x[2] < y[3] and y[2] < x[3])


def rows(*items, file="f"):
    return [(file, k, None, s, e, t) for k, (t, s, e) in enumerate(items)]


def groups(spark, inputs, refs, **more):
    a, b = spark.createDataFrame(inputs, SCHEMA), spark.createDataFrame(refs, SCHEMA)
    out = intervals.merged_refs(intervals.align(a, b, **more), b)
    return sorted((r.in_pos if r.in_pos is not None else 10**6, r.lone_pos, r.n_refs, r.ref_text) for r in out.collect())


@pytest.mark.parametrize("bucket", [None, 700])
def test_alignment_cases(spark, bucket):
    none = groups(spark, rows(("a", None, None), ("b", None, None)), rows(("R", None, None)), bucket_us=bucket)
    assert [g[0] for g in none] == [0, 1, 10**6]
    assert groups(spark, rows(("p", 0, 1000)), rows(("ref", 100, 800)), bucket_us=bucket) == [(0, None, 1, "ref")]
    assert groups(spark, rows(("p", 0, 1000)), rows(("o", 5000, 6000)), bucket_us=bucket) == [(0, None, 0, None), (10**6, 0, 1, "o")]
    assert groups(spark, rows(("p", 0, 2000)), rows(("first", 100, 800), ("second", 900, 1900)), bucket_us=bucket) == [(0, None, 2, "first\n\nsecond")]


def test_threshold_is_strict_and_ties_go_to_the_earlier(spark):
    assert groups(spark, rows(("p", 0, 1000)), rows(("r", 700, 3000))) == [(0, None, 0, None), (10**6, 0, 1, "r")]
    a, b = (spark.createDataFrame(x, SCHEMA) for x in (rows(("p", 0, 1000)), rows(("x", 0, 400), ("y", 600, 1000))))
    assert [r.b_pos for r in intervals.best_match(a, b).collect()] == [0]


def test_one_reference_serves_several_inputs_and_zero_length_matches_nothing(spark):
    got = groups(spark, rows(("a", 0, 500), ("b", 500, 1000), ("z", 300, 300)), rows(("r", 0, 1000)))
    assert got == [(0, None, 1, "r"), (1, None, 1, "r"), (2, None, 0, None)]


def naive(inputs, refs):
    """The definition, row by row."""
    used, out = set(), {}
    order = sorted(range(len(refs)), key=lambda j: (refs[j][3], refs[j][4], j))
    for i, a in enumerate(inputs):
        best, pick = 0.3, None
        for j in order:
            shared = min(a[4], refs[j][4]) - max(a[3], refs[j][3])
            if a[4] > a[3] and shared > 0 and shared * 10 > (a[4] - a[3]) * 3 and (pick is None or shared > best):
                best, pick = shared, j
        out[i] = [] if pick is None else [pick]
        used |= set(out[i])
    for j in set(range(len(refs))) - used:
        best, pick = 0, None
        for i in sorted(range(len(inputs)), key=lambda i: (inputs[i][3], inputs[i][4], i)):
            shared = min(inputs[i][4], refs[j][4]) - max(inputs[i][3], refs[j][3])
            if shared > 0 and shared * 10 > (refs[j][4] - refs[j][3]) * 3 and shared > best:
                best, pick = shared, i
        if pick is None:
            out[-j - 1] = [j]
        else:
            out[pick].append(j)
    return {(k if k >= 0 else None, tuple(sorted(v))) for k, v in out.items()}


@pytest.mark.parametrize("seed", range(3))
def test_alignment_against_definition(spark, seed):
    rng = random.Random(seed)
    make = lambda n: rows(*[(str(k), s := rng.randrange(0, 900) * 10, s + rng.randrange(1, 90) * 10) for k in range(n)])
    inputs, refs = make(40), make(50)
    rng.shuffle(inputs)
    a, b = spark.createDataFrame(inputs, SCHEMA), spark.createDataFrame(refs, SCHEMA)
    links = {}
    for r in intervals.align(a, b, bucket_us=333).collect():
        key = r.in_pos if r.in_pos is not None else ("lone", r.ref_pos)
        links.setdefault(key, set()).update({r.ref_pos} - {None})
    got = {(k if not isinstance(k, tuple) else None, tuple(sorted(v))) for k, v in links.items()}
    assert got == naive(sorted(inputs, key=lambda r: r[1]), refs)


def test_merge_same_text(spark):
    df = spark.createDataFrame(rows(("a", 0, 10), ("a", 10, 20), ("b", 20, 30), ("a", 30, 40), ("a", 50, 60)), SCHEMA)
    got = sorted((r.text, r.start_us, r.end_us, r.n_cues) for r in intervals.merge_same_text(df, Timed()).collect())
    assert got == [("a", 0, 20, 2), ("a", 30, 40, 1), ("a", 50, 60, 1), ("b", 20, 30, 1)]
