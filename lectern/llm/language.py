"""Language identification by averaged hashed subword embeddings and a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import SLICE_BYTES, fold, slices, text_buffer

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
GRAMS = (2, 3, 4)
#: At most this many labelled documents train a model, those of the smallest hashes.
MAX_TRAIN = 2_000
#: Steps of descent at least; few samples are gone through more often.
MIN_STEPS = 6_000
UNKNOWN = "und"

# Bytes that end a word: all of ASCII but the letters.
_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTERS[128:] = np.arange(128, 256)


def grams(data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the n bytes from each position, and whether they are a subword: inside one word, or
    with the space before or after it."""
    wide = data.astype(np.uint32)
    pad = np.concatenate([wide, np.full(n, 0x20, np.uint32)])
    m = len(wide)
    code = np.full(m, n, np.uint32)
    inner = np.ones(m, bool)
    for j in range(n):
        part = pad[j : j + m]
        code = code << np.uint32(8) | part if n < 4 or j else part.copy()
        if 0 < j < n - 1:
            inner &= part != 0x20
    inner &= (pad[:m] != 0x20) | (pad[1 : 1 + m] != 0x20)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x2C1B3C6D)
    code ^= code >> np.uint32(12)
    code *= np.uint32(0x297A2D39)
    return code >> np.uint32(32 - BUCKET_BITS), inner


def padded(texts: pa.Array) -> pa.Array:
    """Lower-cased texts, each between two spaces."""
    return pc.binary_join_element_wise("", pc.utf8_lower(pc.fill_null(texts, "")), "", " ")


def pieces(letters: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``grams`` of a long buffer, SLICE_BYTES at a time: the first position, buckets, and which are subwords."""
    for at in range(0, len(letters), SLICE_BYTES):
        ids, ok = grams(letters[at : at + SLICE_BYTES + n - 1], n)
        yield at, ids[:SLICE_BYTES], ok[:SLICE_BYTES]


def feature_counts(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets and their counts of each text."""
    data, offsets = text_buffer(padded(texts))
    out = []
    for i in range(len(texts)):
        letters = _LETTERS[data[offsets[i] : offsets[i + 1]]]
        total = np.zeros(BUCKETS, np.int64)
        for n in GRAMS:
            for _, ids, ok in pieces(letters, n):
                total += np.bincount(ids[ok], minlength=BUCKETS)
        used = np.nonzero(total)[0]
        out.append((used, total[used]))
    return out


@dataclass(frozen=True)
class Model:
    langs: list[str]
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def scores(self) -> np.ndarray:
        """What each bucket adds to each language's logit: embedding times softmax weights."""
        return (self.embeddings @ self.weights).astype(np.float32)


def train(samples: list[tuple[str, np.ndarray, np.ndarray]], dim: int = 16, epochs: int = 6, rate: float = 0.5, seed: int = 1) -> Model:
    """Stochastic gradient descent on three quarters of the samples (language, buckets, counts); the
    rest sets the temperature of the softmax and the score below which a prediction is rejected."""
    langs = sorted({lang for lang, _, _ in samples})
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim))
    wts, bias = np.zeros((dim, len(langs))), np.zeros(len(langs))
    if len(langs) < 2:
        return Model(langs, emb, wts, bias)
    epochs = max(epochs, -(-MIN_STEPS // max(1, len(samples) * 3 // 4)))
    held = [s for k, s in enumerate(samples) if k % 4 == 3]
    kept = [s for k, s in enumerate(samples) if k % 4 != 3] or samples
    steps, done = epochs * len(kept), 0
    for _ in range(epochs):
        for k in rng.permutation(len(kept)):
            lang, ids, counts = kept[k]
            done += 1
            if not len(ids):
                continue
            share = counts / counts.sum()
            hidden = share @ emb[ids]
            p = hidden @ wts + bias
            p = np.exp(p - p.max())
            p /= p.sum()
            p[langs.index(lang)] -= 1
            lr = rate * (1 - done / (steps + 1))
            back = wts @ p
            wts -= lr * np.outer(hidden, p)
            bias -= 0.1 * lr * p
            emb[ids] -= lr * len(ids) ** 0.5 * np.outer(share, back)
    model = Model(langs, emb, wts, bias)
    tested = [(langs.index(lang), (counts / counts.sum()) @ emb[ids] @ wts + bias) for lang, ids, counts in held if len(ids)]
    if not tested:
        return model
    truth, logits = np.array([t for t, _ in tested]), np.array([x for _, x in tested])

    def soft(t: float) -> np.ndarray:
        z = logits / t
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    best = min((2.0**e for e in np.arange(-4, 4.25, 0.25)), key=lambda t: -np.log(soft(t)[np.arange(len(truth)), truth] + 1e-12).mean())
    prob = soft(best)
    top, right = prob.max(1), prob.argmax(1) == truth
    # The lowest score at which the predictions kept are right in 99 of 100 held cases.
    order = np.argsort(-top)
    good = np.cumsum(right[order]) / np.arange(1, len(top) + 1) >= 0.99
    cut = 0.0 if good[-1] else float(top[order][np.nonzero(good)[0].max()]) if good.any() else 1.0
    return Model(langs, emb, wts, bias, float(best), cut)


def train_on(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_fold: tuple[int, int] = (3, 1), max_train: int = MAX_TRAIN) -> Model:
    """A model of the rows with a language that are not in the held-out fold. Their ids of the smallest
    hashes, ``max_train`` at most, are the sample; only bucket counts come to the driver. Rows that repeat an
    id are one sample."""
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", held_fold[0]) != held_fold[1])
    )
    ids = [r[0] for r in known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train).collect()]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = feature_counts(batch.column(1))
            yield pa.record_batch(
                [batch.column(0), batch.column(2), pa.array([f[0].astype(np.int32) for f in found], pa.list_(pa.int32())), pa.array([f[1].astype(np.int32) for f in found], pa.list_(pa.int32()))],
                names=["doc_id", "lang", "ids", "counts"],
            )

    # Of rows that repeat an id, the least by language and text: no more rows than ids come to the driver.
    sample = (known.where(F.col("doc_id").isin(ids)) if ids else known.limit(0)).groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("s")).select("doc_id", "s.text", "s.lang")
    got = sample.mapInArrow(counted, "doc_id long, lang string, ids array<int>, counts array<int>").toArrow().sort_by("doc_id")
    return train([(lang.as_py(), np.asarray(i.values), np.asarray(c.values)) for lang, i, c in zip(got["lang"], got["ids"], got["counts"], strict=True)])


SCHEMA = "doc_id long, lang_pred string, score double, rejected boolean"


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: doc_id, lang_pred, score (the probability of lang_pred) and rejected (the
    score is below the calibrated bound, so that a caller may treat the text as of no known language).

    A text that is null, empty or without a letter has ``und``, score 0 and is rejected; so has every
    text if the model knows no language. Ties go to the language that sorts first. Repeated rows get
    the same answer; an empty table gives no rows; other columns are ignored.
    """
    table, bias, langs, temperature, cut = model.scores(), model.bias, model.langs, model.temperature, model.reject_below

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*langs, UNKNOWN], object)
        for batch in batches:
            texts = batch.column(1)
            lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            pick, score = np.full(len(texts), len(langs)), np.zeros(len(texts))
            if langs and len(texts):
                bounds = text_buffer(texts)[1]
                for a, b in slices(bounds, 1 << 18):
                    logits = mean_logits(padded(texts.slice(a, b - a)), table) + bias
                    z = np.exp((logits - logits.max(1, keepdims=True)) / temperature)
                    z /= z.sum(1, keepdims=True)
                    pick[a:b], score[a:b] = z.argmax(1), z.max(1)
                pick[~lettered], score[~lettered] = len(langs), 0.0
            yield pa.record_batch(
                [batch.column(0), pa.array(names[pick], pa.string()), pa.array(score), pa.array((score < cut) | (pick == len(langs)))], names=["doc_id", "lang_pred", "score", "rejected"]
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(predict, SCHEMA)


def mean_logits(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    """The mean of the buckets' scores over all subwords of each text."""
    data, offsets = text_buffer(texts)
    data = data[offsets[0] : offsets[-1]]
    starts, ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    letters = _LETTERS[data]
    total, count = np.zeros((len(starts), table.shape[1])), np.zeros(len(starts))
    extended = np.concatenate([table, np.zeros((1, table.shape[1]), table.dtype)])
    for n in GRAMS:
        for at, ids, ok in pieces(letters, n):
            end = at + len(ids)
            here = slice(int(np.searchsorted(ends, at, "right")), int(np.searchsorted(starts, end)))
            for j in range(1, n):  # not across two texts
                edge = ends[here] - j - at
                ok[edge[(edge >= 0) & (edge < len(ok))]] = False
            ids = np.where(ok, ids, np.uint32(BUCKETS)).astype(np.intp)
            inner = np.maximum(starts[here] - at, 0)
            total[here] += np.add.reduceat(np.take(extended, ids, axis=0), inner, axis=0)
            count[here] += np.add.reduceat(ok.astype(np.int32), inner)
    return total / np.maximum(count, 1)[:, None]
