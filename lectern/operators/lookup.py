"""Lookup joins: null-safe keys, fallbacks, existence flags, top-ranked matches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep(df: DataFrame, keys: list[str], order: list[Column], last: bool = False) -> DataFrame:
    """One row for each key: the first by ``order``, or the last. The order must be total."""
    flipped = [o.desc() if last else o for o in order]
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*flipped))).where("__rn = 1").drop("__rn")


def require_unique(df: DataFrame, keys: list[str], ignore_case: bool = False) -> DataFrame:
    """The rows, or an error if a key repeats."""
    cols = [F.lower(F.col(k)) if ignore_case else F.col(k) for k in keys]
    n = F.count("*").over(Window.partitionBy(*cols))
    said = F.raise_error(F.concat(F.lit("duplicate key: "), F.concat_ws("|", *[F.col(k).cast("string") for k in keys])))
    return df.withColumn("__n", F.when(n > 1, said.cast("long")).otherwise(n)).where("__n >= 1").drop("__n")


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], null_safe: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which the ``null_safe`` keys match null with null. The right side's keys are dropped."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in {*on, *null_safe} else F.col(c) for c in right.columns])
    tests = [F.col(c) == F.col(f"__r_{c}") for c in on] + [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in null_safe]
    return left.join(renamed, reduce(Column.__and__, tests), how).drop(*[f"__r_{c}" for c in (*on, *null_safe)])


def import_media(blocks: DataFrame, media: DataFrame, files: DataFrame) -> DataFrame:
    """Blocks (base, ref, ordinal) with the image and audio that a media list (base, ref, ordinal, audio,
    image) gives them: the image if its file exists, the audio only for blocks of their own."""
    met = null_safe_join(blocks, require_unique(media, ["base", "ref", "ordinal"]), ["base", "ordinal"], ["ref"])
    there = files.select(F.col("path").alias("image"), F.lit(True).alias("__there")).distinct()
    met = met.join(there, "image", "left")
    return met.withColumns({"image": F.when(F.col("__there"), F.col("image")), "audio": F.when(F.col("ref").isNull(), F.col("audio"))}).drop("__there")


def exists_flag(left: DataFrame, right: DataFrame, on: dict[str, str], flag: str, value: Column | None = None) -> DataFrame:
    """Left rows with a column that says whether the key is in ``right``: boolean, or ``value`` or null."""
    keys = right.select(*[F.col(r).alias(f"__{r}") for r in on.values()]).distinct().withColumn("__in", F.lit(True))
    met = left.join(keys, reduce(Column.__and__, [F.col(a) == F.col(f"__{b}") for a, b in on.items()]), "left")
    found = F.col("__in").isNotNull()
    return met.withColumn(flag, found if value is None else F.when(found, value)).drop("__in", *[f"__{r}" for r in on.values()])


def fallback(left: DataFrame, tables: list[DataFrame], on: str, columns: list[str]) -> DataFrame:
    """Columns from the first of several tables that has the key; each table has a row for a key at most."""
    out = left
    for k, t in enumerate(tables):
        out = out.join(t.select(F.col(on), *[F.col(c).alias(f"__{k}_{c}") for c in columns], F.lit(k).alias(f"__{k}")), on, "left")
    hit = F.coalesce(*[F.col(f"__{k}") for k in range(len(tables))])
    out = out.withColumns({c: reduce(lambda rest, k: F.when(hit == k, F.col(f"__{k}_{c}")).otherwise(rest), reversed(range(len(tables))), F.lit(None)) for c in columns} | {"found_in": hit})
    return out.drop(*[f"__{k}_{c}" for k in range(len(tables)) for c in columns], *[f"__{k}" for k in range(len(tables))])


def any_of_join(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Inner join on a = x or b = y or ..., as a union of equi-joins: a disjunction alone would compare all
    rows with all. A pair that meets several of the equalities comes out once: each branch leaves out
    what an earlier one has."""
    branches = []
    for k, (a, x) in enumerate(pairs):
        b = left.join(right, F.col(a) == F.col(x))
        for p, q in pairs[:k]:
            b = b.where(~F.coalesce(F.col(p) == F.col(q), F.lit(False)))
        branches.append(b)
    return reduce(DataFrame.unionByName, branches)


def any_of_left_join(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], id_cols: list[str]) -> DataFrame:
    """Left outer variant; ``id_cols`` identify a left row."""
    inner = any_of_join(left, right, pairs)
    missing = left.join(inner.select(*id_cols).distinct(), id_cols, "left_anti")
    return inner.unionByName(missing, allowMissingColumns=True)


def numbered(df: DataFrame, order: list[str], name: str = "rn", pre_sorted_ranges: int | None = None) -> DataFrame:
    """Row numbers over the whole table without sending it to one task: rows are sorted by range, each
    partition counts its own, and the counts before it are added."""
    n = pre_sorted_ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    from lectern.operators._store import stored

    # Sampling for the ranges and the count must see the same rows, so the sorted rows are written once.
    parts = stored(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))
    local = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__size"))
    # One row for each partition: as many as there are tasks.
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__before"))
    return parts.withColumn("__local", local).join(F.broadcast(offsets), "__part").withColumn(name, F.col("__local") + F.col("__before")).drop("__part", "__local", "__before")


def zip_rows(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str], strict: bool = False) -> DataFrame:
    """The i-th row of one table beside the i-th of the other; ``strict``: an error if one is longer."""
    a, b = numbered(left, left_order, "rn"), numbered(right, right_order, "__rn")
    if not strict:
        return a.join(b, F.col("rn") == F.col("__rn")).drop("__rn")
    met = a.join(b, F.col("rn") == F.col("__rn"), "full")
    both = F.when(F.col("rn").isNull() | F.col("__rn").isNull(), F.raise_error(F.lit("the tables differ in length")).cast("long")).otherwise(F.col("rn"))
    return met.withColumn("rn", both).drop("__rn")


def ordered_lookup(left: DataFrame, id_col: str, list_col: str, table: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """The values of a list of keys, in the list's order; unknown keys are left out."""
    items = left.select(id_col, F.posexplode(list_col).alias("__pos", key))
    met = items.join(table.select(key, value), key).groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("__pos", value))).alias("__v"))
    empty = F.array().cast(f"array<{dict(table.dtypes)[value]}>")
    return left.join(met.select(F.col(id_col), F.transform("__v", lambda v: v[value]).alias(name)), id_col, "left").withColumn(name, F.coalesce(name, empty))


def or_default(left: DataFrame, table: DataFrame, key: str, value: str, default) -> DataFrame:
    """Left rows with the table's value for their key, the default where it has none."""
    return left.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def newer(source: DataFrame, target: DataFrame, key: str, mtime: str = "mtime") -> DataFrame:
    """Source rows that the target lacks or has of an earlier time."""
    t = target.select(key, F.col(mtime).alias("__t"))
    return source.join(t, key, "left").where(F.coalesce(F.col("__t") < F.col(mtime), F.lit(True))).drop("__t")


def changed(source: DataFrame, target: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Source rows that differ from the target's in any of the columns; an error where the target lacks the key."""
    t = target.select(key, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__in"))
    met = source.join(t, key, "left").withColumn("__in", F.when(F.col("__in").isNull(), F.raise_error(F.concat(F.lit("missing: "), F.col(key).cast("string"))).cast("boolean")).otherwise(True))
    return met.where(F.col("__in") & reduce(Column.__or__, [~F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns])).drop("__in", *[f"__{c}" for c in columns])


def with_gaps(left: DataFrame, table: DataFrame, key: str, inline: str, value: str, default: str = "") -> tuple[DataFrame, DataFrame]:
    """The inline value, else the table's, else the default; and the table with rows for the missing keys."""
    met = left.join(table.select(key, F.col(value).alias("__v")), key, "left").withColumn(value, F.coalesce(F.nullif(F.col(inline), F.lit("")), "__v", F.lit(default))).drop("__v")
    gaps = left.where(F.coalesce(F.col(inline), F.lit("")) == "").select(key).distinct().join(table, key, "left_anti").withColumn(value, F.lit(default))
    return met, table.select(key, value).unionByName(gaps)


def nearest_ancestor(paths: DataFrame, marked: DataFrame, path: str = "path", directory: str = "directory") -> DataFrame:
    """Each path with the longest marked directory that it is in or is."""
    parts = F.split(F.col(path), "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    met = paths.withColumn("__up", F.explode(ups)).join(marked.select(F.col(directory).alias("__up")).distinct(), "__up")
    best = met.groupBy(path).agg(F.max_by("__up", F.length("__up")).alias(directory))
    return paths.join(best, path, "left")


def resolved_ancestor(paths: DataFrame, entries: DataFrame, marked: DataFrame, path: str = "path", directory: str = "directory", strict: bool = False) -> DataFrame:
    """Each path with ``directory``, the nearest marked one that it is in or is, and ``state``: found, none (an
    existing directory without one), file or missing. ``entries`` has (path, is_dir) of all that exists. With ``strict``
    a file and a missing path are errors, each of its own kind. Repeated rows stay; a null path is missing."""
    known = entries.select(F.col("path").alias(path), F.col("is_dir").alias("__dir")).groupBy(path).agg(F.bool_or("__dir").alias("__dir"))
    met = paths.join(known, path, "left")
    up = nearest_ancestor(met.where("__dir").select(path).distinct(), marked, path, directory)
    state = F.when(F.col("__dir").isNull(), "missing").when(~F.col("__dir"), "file").when(F.col(directory).isNull(), "none").otherwise("found")
    out = met.join(up, path, "left").withColumn("state", state).drop("__dir")
    if not strict:
        return out
    shown = F.coalesce(F.col(path), F.lit("null"))
    wrong = F.when(F.col("state") == "file", F.raise_error(F.concat(F.lit("a file where a directory is expected: "), shown))).when(F.col("state") == "missing", F.raise_error(F.concat(F.lit("no such path: "), shown)))
    return out.withColumn("state", F.coalesce(wrong.cast("string"), "state"))
