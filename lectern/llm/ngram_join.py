"""N-gram Jaccard self-join by rare-first prefix filtering, and the components of its links.

A document's distinct word 5-grams are ordered from rare to frequent by counts over the whole corpus.
Two sets of Jaccard similarity 0.75 share a gram among the first quarter or so of both, so only these
prefixes are joined. A list of all documents with one prefix gram is not expanded into its pairs: each
document is first compared with the list's hub, and what hubs link forms components; then pairs of
different components are compared, as far as the length, positional and suffix filters let them pass.
So every pair that could join two components is verified, and none within a component needs to be.

A list in which many documents are outside the hub's component, as those of a passage that unlike documents
share, would still make a square of pairs. Its gram is no rare one, whatever the counters say: its documents are
joined anew with such grams ranked last, which moves the passage out of their prefixes. Any order of grams
finds all links, so the rank is a matter of speed alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import BROADCAST_IDS, SLICE_BYTES, SPACES, by_group, mixed, restricted, salts, slices, split_plan, stored, text_buffer
from lectern.llm.components import connected

N = 5
#: The threshold as a fraction, so that comparisons stay in integers.
NUM, DEN = 75, 100
#: Counters of the frequency sketch: 4 MB, whatever the size of the corpus. Grams that it takes for rare and that
#: turn out to be frequent are ranked last by their lists.
SKETCH_BITS = 20
SLOTS = 64
#: Documents outside the hub's component that a list's others are compared with at most, before its gram is ranked last.
OUTSIDERS = 1_000
#: Lists of more rows than this, as the planning sample has it, are made in groups.
GROUP_ROWS = 500
#: One document in so many plans which lists are split. It decides the layout only, never a result.
SAMPLE = 64
#: Hash ranges of the suffix filter.
RANGES = 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True


def gram_sets(texts: pa.Array, n: int = N) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's word n-grams; a text of fewer words has the one
    of all its words, a text without words none."""
    data, offsets = text_buffer(texts)
    for a, b in slices(offsets):
        low = _LOWER[data[offsets[a] : offsets[b]]]
        bounds = offsets[a : b + 1] - offsets[a]
        inside = ~_IS_SPACE[low]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edges = bounds[:-1][bounds[:-1] < len(low)]
        begins[edges] = inside[edges]
        finishes = inside.copy()
        finishes[:-1] &= ~inside[1:] | begins[1:]
        starts, ends = np.nonzero(begins)[0], np.nonzero(finishes)[0] + 1
        words = word_hashes(low, starts, ends)
        first = np.searchsorted(starts, bounds)
        grams = np.zeros(max(len(words) - n + 1, 0), np.uint64)
        for j in range(n):
            grams = grams * np.uint64(0xD1342543DE82EF95) + words[j : j + len(grams)]
        grams = mixed(grams, n)
        for i in range(b - a):
            lo, hi = first[i], first[i + 1]
            if hi - lo >= n:
                yield np.unique(grams[lo : hi - n + 1])
            elif hi > lo:
                h = np.zeros(1, np.uint64)
                for w in words[lo:hi]:
                    h = h * np.uint64(0xD1342543DE82EF95) + w
                yield mixed(h, int(hi - lo))
            else:
                yield np.zeros(0, np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = SLICE_BYTES) -> np.ndarray:
    """A hash of each word, ``step`` bytes at a time: the sum of a random number for each pair of a byte and its place in the
    word. Unlike a polynomial modulo 2^64 it has no structure in which long words could collide."""
    first, last = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    carry, seen = np.uint64(0), 0
    known = np.concatenate([[0], starts])
    with np.errstate(over="ignore"):
        for at in range(0, len(data), step):
            part = data[at : at + step]
            i, j = np.searchsorted(starts, [at, at + len(part)])
            begins = np.zeros(len(part), np.int64)
            begins[starts[i:j] - at] = 1
            place = np.arange(at, at + len(part)) - known[np.cumsum(begins) + seen]
            seen += j - i
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(mixed(place.astype(np.uint64) << np.uint64(8) | part, 21), out=sums[1:])
            first[i:j] = carry + sums[starts[i:j] - at]
            i, j = np.searchsorted(ends, [at, at + len(part)], "right")
            last[i:j] = carry + sums[ends[i:j] - at]
            carry += sums[-1]
    return mixed(last - first, 22)


def set_digest(grams: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, whatever their order."""
    return tuple(int(mixed(grams, salt).sum(dtype=np.uint64).astype(np.int64)) for salt in (11, 12))


def prefix_length(n: int, num: int = NUM, den: int = DEN) -> int:
    return n - -(-n * num // den) + 1


@dataclass(frozen=True)
class Late:
    """Grams that are ranked after all others, and among themselves by how many documents have them."""

    grams: np.ndarray
    counts: np.ndarray

    def rank(self, grams: np.ndarray) -> np.ndarray:
        """0 for a gram that isn't late."""
        at = np.minimum(np.searchsorted(self.grams, grams), max(len(self.grams) - 1, 0))
        return np.where(self.grams[at] == grams, self.counts[at], 0) if len(self.grams) else np.zeros(len(grams), np.int64)


NONE = Late(np.zeros(0, np.uint64), np.zeros(0, np.int64))


def rare_first(grams: np.ndarray, counts: np.ndarray, size: int, late: Late = NONE) -> np.ndarray:
    """The ``size`` rarest grams by the corpus counts of their buckets, ties by hash, late ones after all
    others. It is one order for all documents, which is what prefix filtering needs; the rarer its front, the
    fewer candidates."""
    return grams[np.lexsort((grams, counts[(grams >> np.uint64(64 - SKETCH_BITS)).astype(np.intp)], late.rank(grams)))[:size]]


def _profile(docs: DataFrame, n: int) -> tuple[DataFrame, np.ndarray]:
    """A row for each document (doc, n, d1, d2, ranges), and the corpus counts of all grams by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        names = ["doc", "n", "d1", "d2", "ranges", "slot", "counts"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.binary()]
        for batch in batches:
            sizes, d1, d2, ranges = [], [], [], []
            for grams in gram_sets(batch.column(1), n):
                digest = set_digest(grams)
                sizes.append(len(grams))
                d1.append(digest[0])
                d2.append(digest[1])
                ranges.append(np.bincount((grams >> np.uint64(40)).astype(np.intp) % RANGES, minlength=RANGES).astype(np.int32))
                np.add.at(counts, (grams >> np.uint64(64 - SKETCH_BITS)).astype(np.intp), 1)
            none = pa.nulls(len(sizes))
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(ranges, kinds[4]), none.cast(pa.int32()), none.cast(pa.binary())], names=names)
        parts = counts.astype(np.int32).reshape(SLOTS, -1)
        none = pa.nulls(SLOTS)
        yield pa.record_batch([none.cast(k) for k in kinds[:5]] + [pa.array(range(SLOTS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=names)

    both = stored(docs.mapInArrow(run, "doc long, n long, d1 long, d2 long, ranges array<int>, slot int, counts binary"), "gram-profile")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(raw, np.int32).astype(np.int64)
                total[slot] = total[slot] + part if slot in total else part
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["slot", "counts"])

    slots = both.where("slot is not null").select("slot", "counts").repartition("slot").mapInArrow(summed, "slot int, counts binary")
    counts = np.zeros((SLOTS, (1 << SKETCH_BITS) // SLOTS), np.int64)
    for slot, raw in slots.collect():  # SLOTS rows, of a fixed size together
        counts[slot] = np.frombuffer(raw, np.int64)
    return both.where("slot is null").select("doc", "n", "d1", "d2", "ranges"), np.minimum(counts.ravel(), 2**31 - 1).astype(np.int32)


def _postings(docs: DataFrame, counts: np.ndarray, n: int, late: Late, split: np.ndarray, parts: np.ndarray) -> DataFrame:
    """(gram, salt, doc, pos, size) for the prefix of each document; of equal sets in a batch only the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, out = set(), []
            for doc, grams in zip(batch.column(0).to_pylist(), gram_sets(batch.column(1), n), strict=True):
                digest = set_digest(grams)
                if doc is None or not len(grams) or digest in known:
                    continue
                known.add(digest)
                front = rare_first(grams, counts, prefix_length(len(grams)), late)
                out.append((front, np.full(len(front), doc, np.int64), np.arange(len(front), dtype=np.int32), np.full(len(front), len(grams), np.int32)))
            if out:
                gram, doc, pos, size = (np.concatenate(c) for c in zip(*out, strict=True))
                salt = salts(gram, doc, split, parts).astype(np.int32)
                yield pa.record_batch([pa.array(c) for c in (gram.view(np.int64), salt, doc, pos, size)], names=["gram", "salt", "doc", "pos", "size"])

    return docs.mapInArrow(run, "gram long, salt int, doc long, pos int, size int")


def _lists(docs: DataFrame, counts: np.ndarray, n: int, late: Late, group_rows: int, sample: int) -> DataFrame:
    """The lists of at least two documents, (gram, doc, pos, size, own, hub): each row with the hub of its list,
    and its group's own hub if the list is split. A hub is where the gram comes earliest, so that the fewest
    rare grams set it apart."""
    none = np.zeros(0, np.uint64)
    some = docs.where(F.pmod(F.xxhash64("doc"), F.lit(sample)) == 0)
    split, parts = split_plan(_postings(some, counts, n, late, none, none), group_rows, sample)
    group = Window.partitionBy("gram", "salt")
    rows = _postings(docs, counts, n, late, split, parts).withColumns({"own": F.min(F.struct("pos", "doc", "size")).over(group), "n": F.count("*").over(group)})
    rows = stored(rows.where("n > 1 or salt >= 0").drop("n"), "gram-lists")
    whole = rows.where("salt < 0").withColumn("hub", F.col("own"))
    if not (parts > 1).any():
        return whole.drop("salt")
    # At most SPLIT_KEYS lists are split.
    tops = rows.where("salt >= 0").groupBy("gram").agg(F.min("own").alias("hub"))
    return whole.unionByName(rows.where("salt >= 0").join(F.broadcast(tops), "gram")).drop("salt")


def _sets(docs: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            done, part, size = 0, [], 0
            for grams in gram_sets(batch.column(1), n):
                part.append(grams.view(np.int64))
                size += len(grams)
                if size > 500_000:
                    yield pa.record_batch([pa.array(ids[done : done + len(part)], pa.int64()), pa.array(part, pa.list_(pa.int64()))], names=["doc", "grams"])
                    done, part, size = done + len(part), [], 0
            if part:
                yield pa.record_batch([pa.array(ids[done:], pa.int64()), pa.array(part, pa.list_(pa.int64()))], names=["doc", "grams"])

    return docs.mapInArrow(run, "doc long, grams array<long>")


def _needed(x: str, y: str):
    """The least intersection of two sets of these sizes: ceil(NUM * (x + y) / (NUM + DEN))."""
    return F.expr(f"({NUM} * ({x} + {y}) + {NUM + DEN - 1}) div {NUM + DEN}")


def _passes(x: str, y: str, i: str, j: str):
    """Length and positional filter: sizes x and y, a common gram at positions i and j."""
    return F.expr(f"{DEN} * least({x}, {y}) >= {NUM} * greatest({x}, {y})") & (F.expr(f"least({x} - {i}, {y} - {j})") >= _needed(x, y))


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, n: int, name: str) -> DataFrame:
    """The pairs (a, b) of representatives whose sets are similar; each pair is compared once."""
    side = lambda s: reps.select(F.col("doc").alias(s), F.col("rep").alias(f"{s}r"), F.col("n").alias(f"{s}n"), F.col("ranges").alias(f"{s}g"))
    known = pairs.join(side("a"), "a").join(side("b"), "b").where("ar <> br")
    # Suffix filter: sets differ at least by what their counts in fixed hash ranges differ.
    apart = F.aggregate(F.zip_with("ag", "bg", lambda p, q: F.abs(p - q)), F.lit(0), lambda s, x: s + x)
    known = known.where(apart <= F.col("an") + F.col("bn") - 2 * _needed("an", "bn"))
    todo = stored(known.select(F.least("ar", "br").alias("a"), F.greatest("ar", "br").alias("b")).distinct(), f"{name}-pairs")
    ids = stored(todo.select(F.col("a").alias("__need")).union(todo.select("b")).distinct(), f"{name}-ids")
    sets = stored(_sets(restricted(docs, ids, F.col("doc") == F.col("__need"), "left_semi"), n), f"{name}-sets")
    held = todo.join(sets.select(F.col("doc").alias("b"), F.col("grams").alias("bs")), "b").join(sets.select(F.col("doc").alias("a"), F.col("grams").alias("as_")), "a")
    common = F.size(F.array_intersect("as_", "bs"))
    return stored(held.where(DEN * common >= NUM * (F.size("as_") + F.size("bs") - common)).select("a", "b"), f"{name}-links")


def _crossing(part: DataFrame) -> DataFrame:
    """Pairs (a, b) of documents of different components that one of the lists in ``part`` (gram, doc, pos, size,
    component, outside) has and that the length and positional filters let pass: documents outside the hub's
    component meet all others of a fitting size."""
    bucket = lambda size: F.floor(F.log(size) / F.log(F.lit(1.05))).cast("int")
    highest = F.least(F.col("size") * DEN / NUM, (F.col("size") - F.col("pos")) * ((NUM + DEN) / NUM) - F.col("size"))
    left = part.where(F.col("outside") & (highest >= F.col("size") * NUM / DEN)).select(
        "gram", *[F.col(c).alias(f"l_{c}") for c in ("doc", "pos", "size", "component")], F.explode(F.sequence(bucket(F.col("size") * NUM / DEN), bucket(highest + 1e-6))).alias("bucket")
    )
    right = part.withColumn("bucket", bucket(F.col("size")))
    met = left.join(right, ["gram", "bucket"]).where((F.col("component") != F.col("l_component")) & (~F.col("outside") | (F.col("doc") > F.col("l_doc"))) & _passes("size", "l_size", "pos", "l_pos"))
    return met.select(F.least("doc", "l_doc").alias("a"), F.greatest("doc", "l_doc").alias("b"))


def _frequent(docs: DataFrame, n: int, least: int) -> Late:
    """The grams that more than ``least`` of these documents have, the most frequent BROADCAST_IDS of them at
    most: which grams are late affects no result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grams in gram_sets(batch.column(0), n):
                yield pa.record_batch([pa.array(grams.view(np.int64))], names=["gram"])

    counts = docs.select("text").mapInArrow(run, "gram long").groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > least)
    rows = sorted((r["gram"] & (1 << 64) - 1, r["n"]) for r in counts.orderBy(F.col("n").desc(), "gram").limit(BROADCAST_IDS).collect())
    return Late(np.array([g for g, _ in rows], np.uint64), np.array([k for _, k in rows], np.int64))


def _candidates(lists: DataFrame, texts: DataFrame, named: DataFrame, counts: np.ndarray, n: int, outsiders: int, group_rows: int, sample: int) -> DataFrame:
    """Pairs (a, b) that may join components. Lists with more than ``outsiders`` documents outside the hub's
    component aren't joined. Their documents' grams are counted instead, and their lists made anew with grams
    that more than ``outsiders`` of them have ranked last; these lists are joined as they are."""
    of = lambda d, c: named.select(F.col("doc").alias(d), F.col("component").alias(c))

    def parts(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
        part = lists.select("gram", "doc", "pos", "size", F.col("hub.doc").alias("hub")).join(of("doc", "component"), "doc").join(of("hub", "hub_component"), "hub")
        part = stored(part.select("gram", "doc", "pos", "size", "component", (F.col("component") != F.col("hub_component")).alias("outside")), "gram-parts")
        return part, part.groupBy("gram").agg(F.count_if("outside").alias("k")).where("k > 0")

    part, several = parts(lists)
    several = stored(several, "gram-several")
    long = several.where(F.col("k") > outsiders)
    crossed = _crossing(part.join(several.where(F.col("k") <= outsiders).select("gram"), "gram", "left_semi"))
    if not long.isEmpty():
        ids = stored(part.join(long.select("gram"), "gram", "left_semi").select(F.col("doc").alias("__need")).distinct(), "gram-again")
        again = stored(restricted(texts, ids, F.col("doc") == F.col("__need"), "left_semi"), "gram-again-texts")
        part, several = parts(_lists(again, counts, n, _frequent(again, n, outsiders), group_rows, sample))
        crossed = crossed.unionByName(_crossing(part.join(several.select("gram"), "gram", "left_semi")))
    return crossed.distinct()


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, outsiders: int = OUTSIDERS, group_rows: int = GROUP_ROWS, sample: int = SAMPLE
) -> DataFrame:
    """A row per input row: doc_id, n_shingles, component_id (the smallest doc_id that links reach).

    A-Z are lower-cased; words are what spaces, tabs and line ends separate. Texts without words, and
    null texts, have empty sets and link with nothing. Equal sets link without comparison. Rows that
    repeat an id share its links; a row without id links with nothing and has component_id null. An
    empty table gives no rows. Sets are compared as 64-bit hashes of their n-grams. ``outsiders``, ``group_rows``
    and ``sample`` affect speed only.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    profile, counts = _profile(texts, n)
    some = profile.where("n > 0 and doc is not null")
    classes = stored(some.groupBy("d1", "d2").agg(F.min("doc").alias("rep"), F.count("*").alias("copies")), "gram-classes")
    reps = stored(by_group(some, classes, ["d1", "d2"], "copies").select("doc", "n", "ranges", "rep"), "gram-reps")

    lists = _lists(texts, counts, n, NONE, group_rows, sample)
    met = lambda hub: (F.col("doc") != F.col(hub)["doc"]) & _passes("size", f"{hub}.size", "pos", f"{hub}.pos")
    spoke = lambda hub: lists.where(met(hub)).select(F.col(hub)["doc"].alias("a"), F.col("doc").alias("b"))
    # A split list's documents meet their group's hub and the list's: either may be the one that is like them.
    first = connected(_verified(spoke("own").unionByName(spoke("hub")).distinct(), texts, reps, n, "spoke"))
    named = stored(
        reps.select("doc", "rep").distinct().join(first, F.col("rep") == F.col("node"), "left").select("doc", "rep", F.coalesce("component", "rep").alias("component")), "gram-components"
    )

    crossed = _candidates(lists, texts, named.select("doc", "component").distinct(), counts, n, outsiders, group_rows, sample)
    bridges = _verified(crossed, texts, reps, n, "bridge")
    of = lambda s: named.select(F.col("doc").alias(s), F.col("component").alias(f"{s}c")).distinct()
    joined = connected(bridges.join(of("a"), "a").join(of("b"), "b").select(F.col("ac").alias("a"), F.col("bc").alias("b"))).withColumnRenamed("component", "whole")
    final = named.select("rep", "component").distinct().join(joined, F.col("component") == F.col("node"), "left").select("rep", F.coalesce("whole", "component").alias("component_id"))
    per_rep = reps.groupBy("rep").agg(F.count("*").alias("copies")).join(final.groupBy("rep").agg(F.min("component_id").alias("component_id")), "rep")
    linked = by_group(reps.select("doc", "n", "rep"), stored(per_rep, "gram-final"), ["rep"], "copies").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
    alone = profile.where("n = 0 or doc is null").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("doc").alias("component_id"))
    return linked.unionByName(alone)


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns kept, of which each component keeps the one of the smallest id. Rows
    without words or without id stay."""
    found = jaccard_components(docs, id_col, text_col)
    gone = stored(found.where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct(), "near-copies")
    return restricted(docs, gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")


#: All pairs that share a shingle, and what links reach.
ORACLE = f"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < {N} THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + {N - 1}], ' ') END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {N - 1}, 1) + 1)) AS i FROM t WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE {DEN} * c >= {NUM} * (p.n + q.n - c)
), pairs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), walk(doc_id, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT w.doc_id, l.b FROM walk w JOIN pairs l ON l.a = w.node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(w.node) AS component_id FROM documents d JOIN walk w ON w.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""
