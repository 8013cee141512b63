"""Quality classifier: a sparse rule ensemble compiled to Spark column expressions.

Shallow boosted trees over text statistics give candidate rules, the conjunctions on the paths from
their roots; an L1-penalised logistic regression keeps few of them; what is left is one expression.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import fold

#: At most this many labelled documents train a model, those of the smallest hashes.
MAX_TRAIN = 4_000
THRESHOLD = 0.3


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text; null counts as empty. All are doubles without NaN."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n_words = F.size("__words")
    chars = F.greatest(F.length("__text"), F.lit(1)).cast("double")
    share = lambda pattern: F.length(F.regexp_replace("__text", pattern, "")) / chars
    repeats = F.size(F.filter(F.zip_with("__words", F.slice("__words", F.lit(2), F.greatest(n_words, F.lit(1))), lambda a, b: a == b), lambda same: same))
    return {
        "__text": t,
        "__words": words,
        "s_letters": share(r"[^\p{L}]+"),
        "s_upper": share(r"[^\p{Lu}]+"),
        "s_digits": share("[^0-9]+"),
        "s_marks": share(r"[^*%$#&@~^+=_<>]+"),
        "s_bars": share(r"[^|\\/]+"),
        "s_calls": share("[^!?]+"),
        "s_word_length": F.length("__text") / F.greatest(n_words, F.lit(1)).cast("double"),
        # Of logarithms, as the plain share of distinct words falls with a text's length.
        "s_distinct": F.log1p(F.size(F.array_distinct("__words"))) / F.log1p(F.greatest(n_words, F.lit(1))),
        "s_repeats": repeats / F.greatest(n_words, F.lit(1)).cast("double"),
    }


FEATURES = ["s_letters", "s_upper", "s_digits", "s_marks", "s_bars", "s_calls", "s_word_length", "s_distinct", "s_repeats"]


def with_statistics(docs: DataFrame, text_col: str) -> DataFrame:
    stats = statistics(F.col(text_col))
    out = docs.withColumn("__text", stats.pop("__text"))
    out = out.withColumn("__words", stats.pop("__words"))
    return out.withColumns(stats).drop("__text", "__words")


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    bound: float


Rule = tuple[Condition, ...]


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, path: Rule, found: set[Rule], leaf: np.ndarray) -> None:
    """A regression tree by Newton gain; all paths go to ``found`` and leaf values to ``leaf``."""
    g, h = grad[rows].sum(), hess[rows].sum()
    leaf[rows] = g / (h + 1.0)
    if depth == 0 or len(rows) < 10:
        return
    best = (1e-6, None, 0.0)
    for f in range(x.shape[1]):
        order = rows[np.argsort(x[rows, f], kind="stable")]
        v = x[order, f]
        gl, hl = np.cumsum(grad[order])[:-1], np.cumsum(hess[order])[:-1]
        gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
        gain[(v[1:] == v[:-1])] = 0
        gain[:2] = gain[len(gain) - 2 :] = 0
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), f, float((v[k] + v[k + 1]) / 2))
    if best[1] is None:
        return
    for above in (False, True):
        step = (*path, Condition(best[1], above, best[2]))
        found.add(simplified(step))
        _grow(x, grad, hess, rows[(x[rows, best[1]] > best[2]) == above], depth - 1, step, found, leaf)


def simplified(rule: Rule) -> Rule:
    """Of several bounds on one side of a feature the tightest, in a fixed order."""
    tight: dict[tuple[int, bool], float] = {}
    for c in rule:
        key = (c.feature, c.above)
        tight[key] = c.bound if key not in tight else (max if c.above else min)(tight[key], c.bound)
    return tuple(Condition(f, a, b) for (f, a), b in sorted(tight.items()))


def candidate_rules(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, seed: int = 1) -> list[Rule]:
    """The paths of boosted trees, each grown on half of the rows."""
    rng = np.random.default_rng(seed)
    found: set[Rule] = set()
    score = np.zeros(len(y))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        leaf = np.zeros(len(y))
        part = np.sort(rng.permutation(len(y))[: max(20, len(y) // 2)])
        paths: set[Rule] = set()
        _grow(x, y - p, p * (1 - p), part, depth, (), paths, leaf)
        found |= paths
        score += 0.3 * leaf
    return sorted(found, key=lambda r: (len(r), [(c.feature, c.above, c.bound) for c in r]))


def covered(x: np.ndarray, rules: list[Rule]) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for k, rule in enumerate(rules):
        for c in rule:
            out[:, k] *= (x[:, c.feature] > c.bound) == c.above
    return out


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 500) -> tuple[np.ndarray, float]:
    """L1-penalised logistic weights by accelerated proximal gradient; the intercept is free."""
    n, m = a.shape
    wide = np.column_stack([a, np.ones(n)])
    rate = 4 / (np.linalg.norm(wide, 2) ** 2 / n + 1e-9)
    w = z = np.zeros(m + 1)
    t = 1.0
    for _ in range(steps):
        g = wide.T @ (1 / (1 + np.exp(-np.clip(wide @ z, -40, 40))) - y) / n
        new = z - rate * g
        new[:m] = np.sign(new[:m]) * np.maximum(np.abs(new[:m]) - rate * penalty, 0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return w[:m], float(w[m])


@dataclass(frozen=True)
class Model:
    rules: list[Rule]
    weights: list[float]
    intercept: float

    def column(self) -> Column:
        """The score as one expression over the statistics' columns."""
        margin = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            tests = [F.col(FEATURES[c.feature]) > c.bound if c.above else F.col(FEATURES[c.feature]) <= c.bound for c in rule]
            margin = margin + F.when(reduce(Column.__and__, tests), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(covered(x, self.rules) @ np.array(self.weights) + self.intercept)))


def fit(x: np.ndarray, y: np.ndarray, penalties: tuple[float, ...] = (0.02, 0.01, 0.005, 0.002, 0.001)) -> Model:
    """Rules and weights; the penalty is the largest within a hair of the best loss on a third of the rows."""
    if len(y) < 20 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Model([], [], float(np.log(share / (1 - share))))
    test = np.arange(len(y)) % 3 == 0
    rules = candidate_rules(x, y)
    a = covered(x, rules)
    a, keep = np.unique(a, axis=1, return_index=True)
    rules = [rules[k] for k in keep]
    losses = []
    for penalty in penalties:
        w, b = lasso(a[~test], y[~test], penalty)
        p = np.clip(1 / (1 + np.exp(-(a[test] @ w + b))), 1e-6, 1 - 1e-6)
        losses.append(-(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)).mean())
    penalty = next(q for q, loss in zip(penalties, losses, strict=True) if loss <= min(losses) * 1.02 + 1e-4)
    w, b = lasso(a, y, penalty)
    used = [k for k in range(len(rules)) if abs(w[k]) > 1e-6]
    return Model([rules[k] for k in used], [float(w[k]) for k in used], b)


def train_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_fold: tuple[int, int] = (5, 0), max_train: int = MAX_TRAIN) -> Model:
    """A model of the labelled rows outside the held-out fold. Their ids of the smallest hashes,
    ``max_train`` at most, are the sample; only its statistics come to the driver. Ids with null or
    contradicting labels are left out; an id that several documents have is one sample."""
    known = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (fold("doc_id", held_fold[0]) != held_fold[1]))
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"), F.max("y").alias("top"))
        .where("y = top")
    )
    picked = {r[0]: r[1] for r in known.select("doc_id", "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train).collect()}
    if not picked:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__body")).where(F.col("__id").isin(list(picked)))
    # Of rows that repeat an id, the least by their statistics: so no more rows than ids come to the driver.
    got = with_statistics(texts, "__body").groupBy("__id").agg(F.min(F.struct(*FEATURES)).alias("s")).select("__id", "s.*").toArrow().sort_by("__id")
    x = np.column_stack([got[f].to_numpy() for f in FEATURES]) if got.num_rows else np.zeros((0, len(FEATURES)))
    return fit(x, np.array([picked[i] for i in got["__id"].to_pylist()], float))


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The input's columns and quality_score (0 to 1, higher: better); a column of this name is replaced.

    Null texts count as empty, which have a score too; repeated rows get the same; an empty table stays
    empty. Whole texts are read, in built-in expressions.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "quality_score"]
    inner = docs.select(F.struct(*kept).alias("__row"), F.col(text_col).alias("__body"))
    # The row number keeps filters on the score from being pushed below, where each use of a statistic would compute it anew.
    inner = with_statistics(inner, "__body").withColumn("__at", F.monotonically_increasing_id())
    return inner.select("__row.*", model.column().alias("quality_score"), "__at").drop("__at")


def kept_rows(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score ``threshold`` or more, with all columns of the input as they are, one named
    quality_score too. Null and empty texts have a score like any other; repeated rows stay or go together;
    an empty table stays empty."""
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__input"), F.col(f"`{text_col}`").alias("__text_in"))
    return scored(kept, model, "__text_in").where(F.col("quality_score") >= threshold).select("__input.*")
