"""Term statistics of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROPER = "名詞-固有名詞-"


def words(text: Column | str, pattern: str = r"[\p{L}\p{Nd}]+") -> Column:
    """Lower-cased words: the default tokenizer. Any expression that gives an array of terms can stand for it."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(f"({pattern})"), F.lit(1))


def term_frequency(tokens: DataFrame, keys: list[str], by: list[str] = ()) -> DataFrame:
    """Count of each term; ``keys`` tell terms apart, as base form and part of speech do."""
    return tokens.groupBy(*by, *keys).agg(F.count("*").alias("cnt"))


def document_frequency(counts: DataFrame, term: str = "term", doc: str = "volume", cnt: str = "cnt") -> DataFrame:
    """Total count of each term and the documents that have it."""
    return counts.groupBy(term).agg(F.sum(cnt).alias("cnt"), F.count_distinct(doc).alias("n_docs"))


def utility(counts: DataFrame, corpus: DataFrame, n_docs: Column, term: str = "term", doc: str = "volume", cnt: str = "cnt", proper: Column | None = None) -> DataFrame:
    """For each document, how common its terms are in the corpus: the share of documents that have the term,
    averaged over terms (``mean_df``) and over occurrences (``weighted_df``). Proper nouns are left out;
    a term that the corpus lacks is an error; without terms both are null."""
    met = counts.join(corpus.select(term, F.col("n_docs").alias("__df")), term, "left")
    df = F.when(F.col("__df").isNull(), F.raise_error(F.concat(F.lit("not in the corpus: "), F.col(term))).cast("long")).otherwise(F.col("__df"))
    met = met.withColumn("__share", df / n_docs)
    use = F.lit(True) if proper is None else ~proper
    return met.groupBy(doc).agg(
        F.try_divide(F.sum(F.when(use, F.col("__share") * F.col(cnt))), F.sum(F.when(use, F.col(cnt)))).alias("weighted_df"), F.avg(F.when(use, F.col("__share"))).alias("mean_df"), F.count_if(use).alias("n_terms")
    )


def timed_statistics(blocks: DataFrame, by: str, start: str = "start_us", end: str = "end_us", n: str = "n_tokens", proper: str | None = None) -> DataFrame:
    """Tokens, tokens in timed blocks, the duration of distinct intervals, and the mean and median time per
    token. Blocks without tokens don't count; an interval that several blocks share counts once."""
    used = blocks.where(F.col(n) > 0)
    timed = F.col(start).isNotNull() & F.col(end).isNotNull()
    per = used.groupBy(by, F.when(timed, F.col(start)).alias("__s"), F.when(timed, F.col(end)).alias("__e")).agg(F.sum(n).alias("__n"), F.sum(F.col(proper) if proper else F.lit(0)).alias("__p"))
    has = F.col("__s").isNotNull()
    length = F.col("__e") - F.col("__s")
    out = per.groupBy(by).agg(
        F.sum("__n").alias("tokens"),
        F.coalesce(F.sum(F.when(has, F.col("__n"))), F.lit(0)).alias("timed_tokens"),
        F.coalesce(F.sum(F.when(has, length)), F.lit(0)).alias("duration_us"),
        F.percentile(F.when(has, length / F.col("__n")), F.lit(0.5)).alias("median_us_per_token"),
        F.sum("__p").alias("proper_nouns"),
    )
    return out.withColumn("mean_us_per_token", F.try_divide("duration_us", "timed_tokens"))


def children(rows: DataFrame, parent: str, part: str) -> DataFrame:
    """Rows and distinct non-null parts of each parent."""
    return rows.groupBy(parent).agg(F.count("*").alias("n_rows"), F.count_distinct(part).alias("n_parts"))


def concatenated(rows: DataFrame, key: str, order: list[str], text: str, separator: str = "\n\n", name: str = "texts") -> DataFrame:
    """Texts of each key that aren't blank, in order, joined."""
    from lectern.functions.text import blank

    item = F.when(~blank(text), F.struct(*order, F.col(text).alias("__t")))
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("__all")).select(key, F.array_join(F.transform("__all", lambda x: x["__t"]), separator).alias(name))


def common_affixes(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Longest common prefix and suffix of each key's names. A common prefix of the least and the greatest
    is one of all; so is a common suffix of the least and greatest reversed ones."""
    agg = rows.groupBy(key).agg(F.min(name).alias("a"), F.max(name).alias("b"), F.min(F.reverse(name)).alias("c"), F.max(F.reverse(name)).alias("d"))

    def common(x: str, y: str) -> Column:
        same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.length(x), F.length(y)), F.lit(1))), lambda i: (F.substring(F.col(x), F.lit(1), i) == F.substring(F.col(y), F.lit(1), i)) & (F.length(x) >= i) & (F.length(y) >= i)))
        return F.substring(F.col(x), F.lit(1), same)

    return agg.select(key, common("a", "b").alias("prefix"), F.reverse(common("c", "d")).alias("suffix"))


def summary(rows: DataFrame, by: str, status: str, names: list[str]) -> DataFrame:
    """Rows of each group, those of each status, and the percentage of the first one."""
    counts = [F.count_if(F.col(status) == n).alias(f"n_{n}") for n in names]
    share = F.round(F.try_divide(100.0 * F.count_if(F.col(status) == names[0]), F.count("*")), 6).alias(f"percent_{names[0]}")
    return rows.groupBy(by).agg(F.count("*").alias("n_rows"), *counts, share)


def samples(rows: DataFrame, by: str, value: str, separator: str = ", ") -> DataFrame:
    """One value of each group, the least so that it is always the same, and all distinct ones, joined."""
    return rows.groupBy(by).agg(F.min(value).alias("sample"), F.array_join(F.array_sort(F.collect_set(value)), separator).alias("values"))


def duplicates(rows: DataFrame, key: str, ignore_case: bool = True) -> DataFrame:
    """Keys that occur more than once."""
    k = F.lower(key) if ignore_case else F.col(key)
    return rows.groupBy(k.alias(key)).agg(F.count("*").alias("n")).where("n > 1")


def multimap(rows: DataFrame, entry: str, values: str) -> DataFrame:
    """value -> sorted entries that have it."""
    return rows.select(F.explode(values).alias("value"), entry).groupBy("value").agg(F.array_sort(F.collect_set(entry)).alias("entries"))
