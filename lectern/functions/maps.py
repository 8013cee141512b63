"""Maps and sets of catalogue records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def put(m: Column | str, key: Column, value: Column) -> Column:
    """The map with one entry set."""
    return F.map_concat(F.map_filter(F.coalesce(_c(m), F.map_from_arrays(F.array(key), F.array(value))), lambda k, _: k != key), F.map_from_arrays(F.array(key), F.array(value)))


def fill_missing(primary: Column | str, secondary: Column | str) -> Column:
    """Both maps' entries; the primary one's value wins unless it is null."""
    a, b = _c(primary), _c(secondary)
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, y)))


def replace_scope(old: Column | str, new: Column | str, scope: Column | str) -> Column:
    """Old entries of keys outside ``scope`` stay; inside it only the new ones count. Sorted by key."""
    o, n, s = _c(old), _c(new), _c(scope)
    keep = F.map_filter(o, lambda k, _: ~F.array_contains(s, k))
    both = F.when(o.isNull(), n).when(n.isNull(), keep).otherwise(F.map_concat(keep, F.map_filter(n, lambda k, _: F.array_contains(s, k))))
    return F.map_from_entries(F.array_sort(F.map_entries(both)))


def add_members(members: Column | str, new: Column) -> Column:
    """Sorted union; null counts as empty."""
    return F.array_sort(F.array_union(F.coalesce(_c(members), F.array().cast("array<string>")), new))


def remove_members(members: Column | str, gone: Column) -> Column:
    """Difference; null if nothing is left."""
    left = F.array_except(_c(members), gone)
    return F.when(F.size(left) > 0, left)


def first_value(m: Column | str) -> Column:
    """The value of the least key."""
    return F.get(F.array_sort(F.map_entries(_c(m))), F.lit(0))["value"]


def read_path(json: Column | str, dotted: str) -> Column:
    return F.get_json_object(_c(json), "$." + dotted)


def with_path(record: Column | str, dotted: str, value: Column) -> Column:
    """A struct with the field at a dotted path set."""
    return _c(record).withField(dotted, value)
