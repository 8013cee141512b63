"""Operators that depend on the order of rows within a stream. ``order`` must be total within ``by``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import natural_key


def _w(by: list[str], order: list):
    return Window.partitionBy(*by).orderBy(*order)


def ordinals(rows: DataFrame, by: list[str], order: list, name: str = "ordinal") -> DataFrame:
    """1, 2, ... in order."""
    return rows.withColumn(name, F.row_number().over(_w(by, order)))


def suppress_repeats(rows: DataFrame, by: list[str], order: list, value: Column, name: str = "hidden") -> DataFrame:
    """Whether the row before has the same value, which isn't null."""
    w = _w(by, order)
    return rows.withColumn(name, F.coalesce(F.lag(value).over(w) == value, F.lit(False)))


def unique_slugs(rows: DataFrame, slug: str, id_col: str, name: str = "unique_slug") -> DataFrame:
    """The k-th row of a slug by id, from the second on, gets -k."""
    k = F.row_number().over(_w([slug], [id_col]))
    return rows.withColumn(name, F.when(k == 1, F.col(slug)).otherwise(F.concat_ws("-", slug, k.cast("string"))))


def sections(rows: DataFrame, by: list[str], order: list, value: str, size: int) -> DataFrame:
    """Numbers of runs of equal values, of rows within a run, and of groups of ``size`` rows within a run."""
    w = _w(by, order)
    new = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)
    out = rows.withColumn("section", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("in_section", F.row_number().over(_w([*by, "section"], order)))
    return out.withColumn("file_no", (F.floor((F.col("in_section") - 1) / size) + 1).cast("long"))


def neighbours(rows: DataFrame, by: list[str], order: list, column: str) -> DataFrame:
    """The column's values in the rows before and after."""
    w = _w(by, order)
    return rows.withColumns({"previous": F.lag(column).over(w), "next": F.lead(column).over(w)})


def periodic_headings(rows: DataFrame, by: list[str], order: list, heading: str, every: int = 50) -> DataFrame:
    """Whether a row gets a made heading: each ``every``-th one that has none."""
    at = F.row_number().over(_w(by, order)) - 1
    return rows.withColumn("made_heading", (at % every == 0) & F.col(heading).isNull())


def out_of_order(rows: DataFrame, by: list[str], order: list, start: str) -> DataFrame:
    """For each stream whether any row starts before the one that precedes it."""
    late = F.col(start) < F.lag(start).over(_w(by, order))
    return rows.withColumn("__late", late).groupBy(*by).agg(F.coalesce(F.bool_or("__late"), F.lit(False)).alias("out_of_order"), F.count_if("__late").alias("n_late"))


def running_notes(rows: DataFrame, by: list[str], order: list, note: Column) -> DataFrame:
    """The number of each row's note, counting only rows that have one."""
    n = F.sum(F.when(note, 1).otherwise(0)).over(_w(by, order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("note_no", F.when(note, n))


def natural_rank(rows: DataFrame, by: list[str], name: str, out: str = "natural_rank") -> DataFrame:
    """Rank by natural order: runs of digits by value; equal keys by the raw text."""
    return rows.withColumn(out, F.row_number().over(_w(by, [natural_key(name), F.col(name)])))


def by_number(ids: Column) -> Column:
    """An array of ids given as text, in the order of their numbers."""
    return F.transform(F.array_sort(F.transform(ids, lambda i: F.struct(i.try_cast("long").alias("n"), i.alias("id")))), lambda x: x["id"])


def capped(rows: DataFrame, by: list[str], order: list, most: int = 10_000) -> DataFrame:
    """The rows, or an error if a stream has more than ``most``."""
    k = F.row_number().over(_w(by, order))
    return rows.withColumn("__k", F.when(k > most, F.raise_error(F.lit(f"more than {most} blocks")).cast("int")).otherwise(k)).where("__k > 0").drop("__k")


def marked_last(chunks: Column | str, reference: str, value: Column) -> Column:
    """An array of chunks (with a map ``references``) in which, if any has references, the last gets one more."""
    from lectern.functions.maps import put

    c = F.col(chunks) if isinstance(chunks, str) else chunks
    some = F.exists(c, lambda x: F.coalesce(F.size(x["references"]), F.lit(0)) > 0)
    return F.when(some, F.transform(c, lambda x, i: F.when(i == F.size(c) - 1, x.withField("references", put(x["references"], F.lit(reference), value))).otherwise(x))).otherwise(c)
