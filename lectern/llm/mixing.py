"""Mixing sources to target weights by Poisson replication, and a global shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Poisson quantiles are tabulated until the tail is below this.
TAIL = 1e-15
MAX_RATE = 10_000.0
#: Copies of a document are made in runs of so many.
RUN = 10_000


def poisson_steps(rate: float) -> list[float]:
    """P(N <= k) for k = 0, 1, ... as far as a double tells it from 1."""
    if not 0 <= rate <= MAX_RATE:
        raise ValueError(f"a repetition rate of {rate} is outside 0 to {MAX_RATE}")
    total, k, steps = 0.0, 0, []
    while not steps or (1 - total > TAIL and k <= rate + 12 * math.sqrt(rate) + 40):
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) if rate else 1.0
        steps.append(min(total, 1.0))
        k += 1
    return steps


def uniform(seed: int, key: Column) -> Column:
    """A number in [0, 1) that depends on the key and the seed only: 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, weights: dict[str, float], seed: int = 7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Each document as often as a Poisson variable of its source's rate says, in random order.

    The listed sources together keep their characters; each gets the share that its weight asks for, so
    its rate is target over present characters. Documents of other sources, or of none, have rate 1.
    A document's count inverts the Poisson distribution at a hash of its id: it depends on nothing else,
    so lost tasks come out the same when they run again. A rate over MAX_RATE is split evenly: the count is the
    sum of as many independent counts, each of a hash of its own. Rows that repeat an id have one count; rows
    without an id are told apart by their texts, and count as the text "null:" with the text's MD5. A source
    without characters has rate 0. An empty table stays empty.

    Returns the input's columns, whatever their names, replica (1, 2, ...) and shuffle_key; columns of these
    names are replaced. The rows are dealt to partitions by shuffle_key and sorted by it; rows that share one,
    as repeated rows do, are dealt by their place in the input too, so that no partition gets all of them.
    """
    if not weights or any(w < 0 for w in weights.values()) or not sum(weights.values()):
        raise ValueError("weights must be positive")
    source, text, doc = (F.col(f"`{c}`") for c in (source_col, text_col, id_col))
    listed = docs.where(source.isin(list(weights)))
    # At most a row for each listed source: as bounded as the weights themselves.
    sizes = {r[0]: r[1] for r in listed.groupBy(source).agg(F.sum(F.coalesce(F.length(text), F.lit(0)).cast("long"))).collect()}
    total, weight = sum(sizes.values()), sum(weights[s] for s in sizes if sizes[s]) or 1.0
    rates = {s: weights[s] / weight * total / n if n else 0.0 for s, n in sizes.items()}
    parts = {s: math.ceil(r / MAX_RATE) for s, r in rates.items() if r > MAX_RATE}
    steps = F.lit(None).cast("array<double>")
    if rates:
        table = F.create_map(*[x for s in sorted(rates) for x in (F.lit(s), F.array(*[F.lit(p) for p in poisson_steps(rates[s] / parts.get(s, 1))]))])
        steps = F.try_element_at(table, F.col("__source"))
    steps = F.coalesce(steps, F.array(*[F.lit(p) for p in poisson_steps(1.0)]))
    name = F.coalesce(doc.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")))))
    # An array of one holds a value while a lambda uses it: one digest is made for each count, whatever its steps.
    held = lambda value, use: F.transform(F.array(value), use)[0]
    drawn = lambda key: held(uniform(seed, key), lambda u: F.size(F.filter(steps, lambda p: u >= p)))
    count = drawn(F.col("__name"))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("replica", "shuffle_key")]
    named = docs.select(F.struct(*kept).alias("__row"), name.alias("__name"), source.alias("__source"))
    if parts:
        more = F.try_element_at(F.create_map(*[x for s in sorted(parts) for x in (F.lit(s), F.lit(parts[s] - 1))]), F.col("__source"))
        part = lambda k: F.concat(F.col("__name"), F.lit(":part:"), k.cast("string"))
        count = count + F.when(more.isNotNull(), F.aggregate(F.sequence(F.lit(1), more), F.lit(0), lambda n, k: n + drawn(part(k)))).otherwise(0)
    # No filter on the count, which would make it anew: a document without copies has no list to explode. A long list of copies is
    # several of RUN.
    runs = held(count, lambda n: F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / RUN).cast("int")), lambda r: F.struct((r * RUN + 1).alias("first"), F.least(n, r * RUN + RUN).alias("last")))))
    counted = named.select("__row", "__name", F.explode(runs).alias("__run"))
    copies = counted.select("__row", "__name", F.explode(F.sequence("__run.first", "__run.last")).alias("replica"))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(str(seed)), "__name", F.col("replica").cast("string"))))
    dealt = keyed.withColumn("__at", F.monotonically_increasing_id() % 1024).repartition("shuffle_key", "__at").sortWithinPartitions("shuffle_key")
    return dealt.select("__row.*", "replica", "shuffle_key")


#: The query's target: equal shares of the twenty sources.
EQUAL = {f"src{k}": 1.0 for k in range(20)}

_NAMES = ", ".join(f"'{s}'" for s in EQUAL)
COUNTS_SQL = """
sizes AS (
  SELECT source, sum(coalesce(length(text), 0)) AS n FROM docs_in WHERE source IN (%s) GROUP BY source
), rates AS (
  SELECT source, CASE WHEN n > 0 THEN 1.0 / (SELECT count(*) FROM sizes WHERE n > 0) * (SELECT sum(n) FROM sizes) / n ELSE 0 END AS rate FROM sizes
), steps AS (
  SELECT source, [list_sum([exp(-rate) * CASE WHEN i = 0 THEN 1 ELSE pow(rate, i) / factorial(CAST(i AS INTEGER)) END FOR i IN range(k + 1)]) FOR k IN range(33)] AS cdf
  FROM (SELECT * FROM rates UNION ALL SELECT NULL, 1.0)
), drawn AS (
  SELECT d.*, len(list_filter(s.cdf, lambda p: CAST('0x' || substr(md5('7:' || d.doc_id), 1, 13) AS BIGINT) / 4503599627370496.0 >= p)) AS c
  FROM docs_in d JOIN steps s ON s.source IS NOT DISTINCT FROM CASE WHEN d.source IN (SELECT source FROM sizes) THEN d.source END
)
""" % _NAMES
ORACLE = f"""
WITH docs_in AS (SELECT * FROM documents), {COUNTS_SQL}
SELECT doc_id, source, CAST(r AS INTEGER) AS replica, md5('7:' || doc_id || ':' || r) AS shuffle_key
FROM (SELECT doc_id, source, unnest(range(1, c + 1)) AS r FROM drawn)
"""
