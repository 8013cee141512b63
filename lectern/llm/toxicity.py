"""Toxicity by class-conditional Kneser-Ney models of byte n-grams.

Two models, of toxic and of ordinary texts, share what lies below ``SHARED`` bytes: continuation counts of the whole corpus, which
smooth what either class has hardly seen. A text's evidence is log-likelihood per byte, the toxic model's less the
ordinary one's: of the whole text, and of its most toxic stretch, as a long text may hold a few words only. Logistic weights
for the two are fitted on texts that the models which score them have not seen.

N-grams of up to 8 bytes are integers, so no two share a count. Spark counts them: those of the classes over labelled rows,
those of the corpus over all documents. What the two models disagree on is compiled into tables of log ratios, one for
n-grams and one for contexts of each order; texts are scored by looking these up, long ones in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import SLICE_BYTES, fold, mixed, stored, text_buffer

#: Bytes of the longest n-grams, and of the longest that both classes share.
ORDER = 6
SHARED = 3
#: Bytes of the stretches that are compared, and of blanks between texts, which keep stretches apart.
STRETCH = 40
#: At most so many labelled documents of each class train the models, those of the smallest hashes.
MAX_PER_CLASS = 2_000
THRESHOLD = 0.7
_U = np.uint64

# Letters count, in lower case, and all bytes beyond ASCII; whatever else there is, is a blank.
_CODES = np.full(256, 0x20, np.uint8)
_CODES[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_CODES[128:] = np.arange(128, 256)


def folded(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces (first text, last text, bytes, start of each text): lower-cased texts without other signs, each after
    STRETCH blanks. Runs of blanks are one blank. A longer text than a slice is several pieces, which overlap by
    STRETCH bytes; its row comes again with each."""
    data, offsets = text_buffer(pc.utf8_lower(pc.fill_null(texts, "")))
    first, n = 0, len(texts)
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1)
        if offsets[last] - offsets[first] > 2 * SLICE_BYTES:
            for at in range(int(offsets[first]), int(offsets[last]), SLICE_BYTES):
                early = max(at - STRETCH, int(offsets[first]))
                yield first, last, *_spaced(data[early : min(at + SLICE_BYTES, int(offsets[last]))], np.array([0]))
        else:
            yield first, last, *_spaced(data[offsets[first] : offsets[last]], offsets[first:last] - offsets[first])
        first = last


def _spaced(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = _CODES[data]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0x20) | (codes[:-1] != 0x20)
    keep[starts[starts < len(codes)]] = True
    before = np.concatenate([[0], np.cumsum(keep)])[starts]
    places = before + STRETCH * (1 + np.arange(len(starts)))
    out = np.full(int(keep.sum()) + STRETCH * (len(starts) + 1), 0x20, np.uint8)
    kept = np.nonzero(keep)[0]
    # Each text's bytes move right by the blanks before it.
    which = np.searchsorted(starts, kept, "right")
    out[np.arange(len(kept)) + STRETCH * which] = codes[kept]
    return out, places


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """The n bytes that end at each position, as integers; blanks stand before the first."""
    wide = np.concatenate([np.full(n - 1, 0x20, np.uint8), data]).astype(_U)
    out = np.zeros(len(data), _U)
    for k in range(n):
        out = out << _U(8) | wide[k : k + len(data)]
    return out


def _mask(n: int) -> np.uint64:
    return _U((1 << 8 * n) - 1)


def gram_counts(rows: DataFrame, text_col: str, n: int, keys: list[str] = ()) -> DataFrame:
    """(keys.., gram, n): how often each n-gram of bytes ends in a letter or after one, over whole texts; with keys, how many
    texts have it, those of over a MB counting once for each, so that a text that repeats itself weighs no more than others. A
    task sums up what it has read before anything is shuffled, a few MB at a time."""
    names = [*keys, "gram", "n"]
    types = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        size = 0

        def emptied() -> Iterator[pa.RecordBatch]:
            for key, parts in held.items():
                found, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                total = np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)
                yield pa.record_batch([*[pa.array([k] * len(found), pa.int32()) for k in key], pa.array(found.view(np.int64)), pa.array(total)], names=names)
            held.clear()

        for batch in batches:
            labels = list(zip(*(batch.column(k + 1).to_pylist() for k in range(len(keys))))) if keys else [()] * batch.num_rows
            order = sorted(range(batch.num_rows), key=lambda i: labels[i])
            texts = batch.column(0).take(pa.array(order, pa.int32()))
            edges = [0, *[i for i in range(1, len(order)) if labels[order[i]] != labels[order[i - 1]]], len(order)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                for _, _, data, starts in folded(texts.slice(a, b - a)):
                    seen = (data != 0x20) | np.concatenate([[False], data[:-1] != 0x20])
                    found = grams(data, n)
                    if keys:  # the text's number, of which a piece of a MB has far fewer than 2^16, stands before its n-grams
                        found |= (np.searchsorted(starts, np.arange(len(data)), "right").astype(_U)) << _U(48)
                        found = np.unique(found[seen]) & _mask(6)
                    else:
                        found = found[seen]
                    found, count = np.unique(found, return_counts=True)
                    held.setdefault(labels[order[a]], []).append((found, count))
                    size += len(found)
                if size > 2_000_000:
                    yield from emptied()
                    size = 0
        yield from emptied()

    counted = rows.select(text_col, *keys).mapInArrow(run, ", ".join([*[f"{k} {types[k]}" for k in keys], "gram long", "n long"]))
    return counted.groupBy(*keys, "gram").agg(F.sum("n").alias("n"))


class Table:
    """Numbers by integer keys: keys lie by the top bits of a hash, where a lookup goes on from."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        hashes = mixed(keys)
        order = np.argsort(hashes, kind="stable")
        bits = max(1, int(np.ceil(np.log2(max(len(keys), 1)))) + 2)
        self.shift, self.keys, self.values = _U(64 - bits), keys[order], values[order].astype(np.float32)
        self.first = np.searchsorted(hashes[order] >> self.shift, np.arange((1 << bits) + 1, dtype=_U)).astype(np.int32)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are there, and the values of those."""
        slot = (mixed(keys) >> self.shift).astype(np.intp)
        place, end = self.first[slot], self.first[slot + 1]
        found = np.full(len(keys), -1, np.int32)
        left = np.nonzero(place < end)[0]
        place, end, wanted = place[left], end[left], keys[left]
        while len(left):
            same = self.keys[place] == wanted
            found[left[same]] = place[same]
            place = place + 1
            go = ~same & (place < end)
            left, place, end, wanted = left[go], place[go], end[go], wanted[go]
        hit = found >= 0
        return hit, self.values[found[hit]]


@dataclass(frozen=True)
class Ratios:
    """Log ratios of the classes: of each n-gram, and of what backing off from each context adds, by order, the longest first."""

    levels: list[tuple[Table, Table]]

    def of(self, data: np.ndarray) -> np.ndarray:
        """The log ratio at each position whose byte ends an n-gram; blanks after blanks have 0."""
        out = np.zeros(len(data), np.float32)
        seen = (data != 0x20) | np.concatenate([[False], data[:-1] != 0x20])
        left, whole = np.nonzero(seen)[0], grams(data, ORDER)[seen]
        for k, (ngrams, contexts) in enumerate(self.levels):
            own = whole & _mask(ORDER - k)
            hit, values = ngrams.get(own)
            out[left[hit]] += values
            left, whole, own = left[~hit], whole[~hit], own[~hit]
            hit, values = contexts.get(own >> _U(8))
            out[left[hit]] += values
        return out


def _discount(counts: np.ndarray) -> float:
    once, twice = float((counts == 1).sum()), float((counts == 2).sum())
    return min(max(once / (once + 2 * twice), 0.1), 0.95) if once else 0.5


def _by(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found, at = np.unique(values, return_inverse=True)
    return found, at, np.bincount(at, weights, len(found))


def shared_model(keys: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Probabilities of the shared orders 1 to SHARED, from the number of bytes that stand before each gram of SHARED
    bytes in the corpus: interpolated Kneser-Ney down to a uniform byte."""
    levels: list[tuple[np.ndarray, np.ndarray]] = [(keys, counts.astype(float))]
    for n in range(SHARED - 1, 0, -1):
        found, _, size = _by(levels[0][0] & _mask(n), np.ones(len(levels[0][0])))
        levels.insert(0, (found, size))
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for n, (grams_n, size) in enumerate(levels, 1):
        below = out[-1][1][np.searchsorted(out[-1][0], grams_n & _mask(n - 1))] if out else np.full(len(grams_n), 1 / 256)
        _, at, total = _by(grams_n >> _U(8), size)
        kinds = np.bincount(at, minlength=len(total))
        d = _discount(size)
        out.append((grams_n, (size - d + d * kinds[at] * below) / total[at] if len(size) else size))
    return out


def _shared(model: list[tuple[np.ndarray, np.ndarray]], wanted: np.ndarray) -> np.ndarray:
    """Shared probabilities of grams of SHARED bytes, of which the corpus has all that a class has."""
    out, left = np.full(len(wanted), 1 / 256), np.ones(len(wanted), bool)
    for n in range(SHARED, 0, -1):
        keys, p = model[n - 1]
        if not len(keys):
            continue
        own = wanted & _mask(n)
        place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        hit = left & (keys[place] == own)
        out[hit] = p[place[hit]]
        left &= ~hit
    return out


def log_ratios(keys: np.ndarray, counts: np.ndarray, base: list[tuple[np.ndarray, np.ndarray]]) -> Ratios:
    """Both classes' interpolated Kneser-Ney models, toxic over ordinary: ``counts`` are two columns of the n-grams ``keys``
    (sorted) of ORDER bytes. Lower orders of a class count what stands before an n-gram in its texts."""
    tables = {ORDER: (keys, counts.astype(float))}
    for n in range(ORDER - 1, SHARED, -1):
        above, size = tables[n + 1]
        found, at = np.unique(above & _mask(n), return_inverse=True)
        tables[n] = (found, np.stack([np.bincount(at, size[:, c] > 0, len(found)) for c in (0, 1)], 1))
    levels: list[tuple[Table, Table]] = []
    lower: tuple[np.ndarray, np.ndarray] | None = None
    for n in range(SHARED + 1, ORDER + 1):
        own, size = tables[n]
        if lower is None:
            p = _shared(base, own & _mask(SHARED))
            below = np.stack([p, p], 1)
        else:
            below = lower[1][np.searchsorted(lower[0], own & _mask(n - 1))]
        contexts, at = np.unique(own >> _U(8), return_inverse=True)
        p, bow = np.zeros_like(size), np.zeros((len(contexts), 2))
        for c in (0, 1):
            total, kinds = np.bincount(at, size[:, c], len(contexts)), np.bincount(at, size[:, c] > 0, len(contexts))
            d = _discount(size[:, c])
            share = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
            p[:, c] = np.maximum(size[:, c] - d, 0) / np.maximum(total[at], 1) + share[at] * below[:, c]
            bow[:, c] = np.log(share)
        lower = (own, p)
        logs = np.log(p)
        levels.insert(0, (Table(own, logs[:, 0] - logs[:, 1]), Table(contexts, bow[:, 0] - bow[:, 1])))
    return Ratios(levels)


def evidence(texts: pa.Array, ratios: Ratios) -> np.ndarray:
    """Two numbers for each text: the mean log ratio of its bytes, and that of its STRETCH bytes with the highest."""
    total, size, best = (np.zeros(len(texts)) for _ in range(3))
    best[:] = -np.inf
    again = -1
    for first, last, data, starts in folded(texts):
        values = ratios.of(data)
        if first == again:  # a further piece begins with bytes that the one before had
            head = int(np.searchsorted(np.cumsum(data != 0x20), STRETCH // 2))
            size_from, sum_from = head, head
        else:
            size_from = sum_from = 0
        again = first if last == first + 1 else -1
        sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        stretch = sums[STRETCH:] - sums[:-STRETCH]
        here = slice(first, last)
        if len(starts) == 1:
            total[first] += sums[-1] - sums[sum_from]
            size[first] += len(values) - STRETCH * 2 - max(size_from - STRETCH, 0)
            best[first] = max(best[first], float(stretch.max()))
        else:
            total[here] += np.add.reduceat(values.astype(np.float64), starts)
            size[here] += np.diff(np.append(starts, len(data))) - STRETCH
            best[here] = np.maximum(best[here], np.maximum.reduceat(stretch, np.minimum(starts - STRETCH // 2, len(stretch) - 1)))
    best[~np.isfinite(best)] = 0.0
    return np.stack([total / np.maximum(size, 1), best / np.clip(size, STRETCH / 2, STRETCH)], 1)


@dataclass(frozen=True)
class Model:
    ratios: Ratios | None
    weights: tuple[float, float]
    intercept: float

    def predict(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ np.array(self.weights) + self.intercept, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.0005, steps: int = 30) -> tuple[tuple[float, float], float]:
    """Weighted logistic regression by Newton steps, with a small penalty on the weights of scaled features."""
    scale = np.maximum(x.std(0), 1e-6)
    a = np.column_stack([x / scale, np.ones(len(x))])
    w = np.zeros(3)
    penalty = np.diag([ridge, ridge, 1e-6]) * weight.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ a + penalty
        w = w - np.linalg.solve(h, a.T @ (weight * (p - y)) + penalty @ w)
    return (float(w[0] / scale[0]), float(w[1] / scale[1])), float(w[2])


def train_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_fold: tuple[int, int] = (3, 1), max_per_class: int = MAX_PER_CLASS) -> Model:
    """A model of the labelled rows outside the held-out fold, and of all documents' texts.

    Of either class the ids of the smallest hashes, ``max_per_class`` at most, are the sample. Ids with null or contradicting
    labels are left out; all rows of an id are read. To the driver come the sample's distinct n-grams, two numbers for each of its
    rows, and at most 2^24 grams of the corpus. Without both classes every text's score is the share of toxic labels.
    """
    known = (
        labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y"))
        .where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & (fold("id", held_fold[0]) != held_fold[1]))
        .groupBy("id")
        .agg(F.min("y").alias("y"), F.max("y").alias("top"))
        .where("y = top")
    )
    share = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = [(r["id"], r["y"]) for y in (0, 1) for r in known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(max_per_class).collect()]
    prior = (share.get(1, 0) + 1) / (sum(share.values()) + 2)
    flat = Model(None, (0.0, 0.0), float(np.log(prior / (1 - prior))))
    if len({y for _, y in picked}) < 2:
        return flat
    spark = docs.sparkSession
    chosen = F.broadcast(spark.createDataFrame(picked, "id long, y int"))
    text = F.col(f"`{text_col}`").alias("text")
    sample = stored(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text).join(chosen, "id").withColumn("half", (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2))).cast("int")), "labelled")
    wide = gram_counts(sample, "text", ORDER, ["y", "half"]).groupBy("gram").agg(*[F.sum(F.when((F.col("y") == y) & (F.col("half") == h), F.col("n")).otherwise(0)).alias(f"n{y}{h}") for y in (1, 0) for h in (0, 1)])
    got = wide.toArrow()
    # What stands before each gram of SHARED bytes anywhere in the corpus.
    longer = gram_counts(docs.select(text), "text", SHARED + 1)
    base = longer.groupBy((F.col("gram").bitwiseAND(int(_mask(SHARED)))).alias("g")).agg(F.count("*").alias("n")).toArrow()
    order = np.argsort(base["g"].to_numpy())
    common = shared_model(base["g"].to_numpy()[order].astype(_U), base["n"].to_numpy()[order])
    order = np.argsort(got["gram"].to_numpy())
    keys = got["gram"].to_numpy()[order].view(_U)
    n = {(y, h): got[f"n{y}{h}"].to_numpy()[order] for y in (1, 0) for h in (0, 1)}

    def of(halves: tuple[int, ...]) -> Ratios:
        counts = np.stack([sum(n[y, h] for h in halves) for y in (1, 0)], 1)
        some = counts.sum(1) > 0
        return log_ratios(keys[some], counts[some], common)

    # Each half is scored by the model of the other one.
    others = [of((1,)), of((0,))]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half = batch.column(2).to_numpy(zero_copy_only=False)
            features = np.zeros((batch.num_rows, 2))
            for h in (0, 1):
                rows = np.nonzero(half == h)[0]
                if len(rows):
                    features[rows] = evidence(batch.column(1).take(pa.array(rows)), others[h])
            yield pa.record_batch([batch.column(0), batch.column(3), pa.array(features[:, 0]), pa.array(features[:, 1])], names=["id", "y", "a", "b"])

    # Of rows that repeat an id one is enough: no more rows than ids come to the driver.
    seen = sample.select("id", "text", "half", "y").mapInArrow(scored, "id long, y int, a double, b double").groupBy("id").agg(F.min(F.struct("y", "a", "b")).alias("s")).select("id", "s.*").toArrow().sort_by("id")
    y = seen["y"].to_numpy().astype(float)
    if y.min() == y.max():
        return flat
    # Both classes weigh what they do among all labels.
    weight = np.where(y == 1, share[1] / max(y.sum(), 1), share[0] / max((1 - y).sum(), 1)) / (share[0] + share[1]) * len(y)
    weights, intercept = logistic(np.column_stack([seen["a"].to_numpy(), seen["b"].to_numpy()]), y, weight)
    return Model(of((0, 1)), weights, intercept)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: doc_id, score (0 to 1, higher: likelier toxic), whole and stretch (log-likelihood ratios per
    byte of the whole text and of its most toxic stretch).

    A null, empty or letterless text has ratios of 0 and a score like others. Repeated rows get the same answer; an empty
    table gives no rows; other columns are ignored. Whole texts are read, long ones in pieces.
    """
    ratios = model.ratios

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = evidence(batch.column(1), ratios) if ratios is not None else np.zeros((batch.num_rows, 2))
            yield pa.record_batch([batch.column(0), pa.array(model.predict(features)), pa.array(features[:, 0]), pa.array(features[:, 1])], names=["doc_id", "score", "whole", "stretch"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "doc_id long, score double, whole double, stretch double")
