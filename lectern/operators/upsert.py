"""Maintenance of a catalogue table: upserts, anti-joins and membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.maps import add_members, put, remove_members


def upsert(target: DataFrame, source: DataFrame, key: str, managed: list[str], insert: bool = True, order: Column | None = None, keep_null: bool = True) -> DataFrame:
    """Rows by key: matched ones take the source's managed columns, unmatched source rows are added if
    ``insert``. A key that the source has twice counts as its last row by ``order``. With ``keep_null`` a
    null in the source doesn't replace a value. Columns that only the target has are kept."""
    if order is not None:
        source = source.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(order.desc()))).where("__rn = 1").drop("__rn")
    s = source.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in managed], F.lit(True).alias("__in"))
    met = target.withColumn("__old", F.lit(True)).join(s, F.col(key) == F.col("__key"), "full" if insert else "left")
    new = {c: F.coalesce(f"__{c}", c) if keep_null else F.when(F.col("__in"), F.col(f"__{c}")).otherwise(F.col(c)) for c in managed}
    status = F.when(F.col("__old").isNull(), "added").when(F.col("__in"), "updated").otherwise("kept")
    return met.select(F.coalesce(key, "__key").alias(key), *[(new[c] if c in new else F.col(c)).alias(c) for c in target.columns if c != key], status.alias("upsert_status"))


def join_list(target: DataFrame, members: DataFrame, key: str, list_name: str, lists: str = "lists", rank: str = "rank", origins: str = "origin", origin: str = "list") -> DataFrame:
    """Sets each member's rank in the map of lists and the origin; members that the target lacks are added."""
    m = members.select(F.col(key).alias("__key"), F.col(rank).cast("int").alias("__rank"))
    met = target.join(m, F.col(key) == F.col("__key"), "full")
    hit = F.col("__key").isNotNull()
    return met.withColumns(
        {
            key: F.coalesce(key, "__key"),
            lists: F.when(hit, put(lists, F.lit(list_name), F.col("__rank"))).otherwise(F.col(lists)),
            origins: F.when(hit, add_members(origins, F.array(F.lit(origin)))).otherwise(F.col(origins)),
        }
    ).drop("__key", "__rank")


def leave_list(target: DataFrame, members: DataFrame, key: str, list_name: str, lists: str = "lists", origins: str = "origin", origin: str = "list") -> DataFrame:
    """Rows that are no longer members lose the list; without lists they lose the origin."""
    m = members.select(F.col(key).alias("__key")).distinct()
    met = target.join(m, F.col(key) == F.col("__key"), "left")
    stale = F.col("__key").isNull() & F.map_contains_key(lists, F.lit(list_name))
    left = F.map_filter(lists, lambda k, _: k != list_name)
    empty = F.size(left) == 0
    return met.withColumns(
        {lists: F.when(~F.coalesce(stale, F.lit(False)), F.col(lists)).when(~empty, left), origins: F.when(F.coalesce(stale, F.lit(False)) & empty, remove_members(origins, F.array(F.lit(origin)))).otherwise(F.col(origins))}
    ).drop("__key")


def unflag(target: DataFrame, members: DataFrame, key: str, flag: str) -> DataFrame:
    """The flag becomes false where it is true and the key is no member."""
    m = members.select(F.col(key).alias("__key")).distinct()
    met = target.join(m, F.col(key) == F.col("__key"), "left")
    return met.withColumn(flag, F.when(F.col(flag) & F.col("__key").isNull(), F.lit(False)).otherwise(F.col(flag))).drop("__key")


def prune(target: DataFrame, origins: str = "origin") -> DataFrame:
    """Rows that still have an origin."""
    return target.where(F.coalesce(F.size(origins), F.lit(0)) > 0)


def enrich(target: DataFrame, key: str, basics: DataFrame, ratings: DataFrame, episodes: DataFrame) -> DataFrame:
    """Basics, ratings and episode counts by id. The wanted ids are joined into each scan first, so that
    only their rows go on."""
    wanted = target.select(key).distinct()
    b = basics.join(wanted, key, "left_semi")
    r = ratings.join(wanted, key, "left_semi")
    e = episodes.join(wanted, key, "left_semi").groupBy(key).agg(F.count("*").alias("episodes"), F.count_distinct("season").alias("seasons"))
    return target.join(b, key, "left").join(r, key, "left").join(e, key, "left")


def migrate(records: DataFrame, renames: dict[str, str]) -> DataFrame:
    """Old columns under their new names; where both are there the new one wins. Running it again changes nothing."""
    out = records
    for old, new in renames.items():
        if old in out.columns:
            out = out.withColumn(new, F.coalesce(new, old) if new in out.columns else F.col(old)).drop(old)
    return out


def canonical(records: DataFrame, order: list[str]) -> DataFrame:
    """Known columns first in their order, then the others."""
    return records.select(*[c for c in order if c in records.columns], *[c for c in records.columns if c not in order])


def scalar_title(records: DataFrame, title: str = "title", language: str = "en") -> DataFrame:
    """A plain title becomes a map by language."""
    if dict(records.dtypes)[title].startswith("map"):
        return records
    return records.withColumn(title, F.when(F.col(title).isNotNull(), F.create_map(F.lit(language), F.col(title))))
