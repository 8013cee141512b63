"""Reshaping of records and of transcript lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import blank

#: File extensions by kind of input.
INPUT_KINDS = {"image": ["jpg", "jpeg", "png"], "subtitle": ["ass", "srt", "vtt", "ttml"], "text": ["md", "txt"], "content": ["yaml", "jsonl"]}


def unified(parts: list[tuple[DataFrame, dict[str, Column]]], required: str) -> DataFrame:
    """Tables of different shapes as one: each with the columns that make its records; those without the
    ``required`` column are dropped."""
    return reduce(DataFrame.unionByName, [df.select(*[c.alias(n) for n, c in spec.items()]) for df, spec in parts]).where(F.col(required).isNotNull())


def first_filled(records: list[Column], fields: list[str], tags: str = "tags") -> Column:
    """One struct of several, in order: each field's first value that isn't empty, and the union of the tags."""
    plain = [F.coalesce(*[F.nullif(r[f], F.lit("")) for r in records]).alias(f) for f in fields]
    none = F.array().cast("array<string>")
    return F.struct(*plain, F.array_sort(F.array_distinct(F.concat(*[F.coalesce(r[tags], none) for r in records]))).alias(tags))


def text_only(chunks: Column, fields: tuple[str, ...] = ("text", "role")) -> Column:
    """Copies of chunks with these fields only."""
    return F.transform(chunks, lambda c: F.struct(*[c[f].alias(f) for f in fields]))


def without_offsets(tokens: Column, fields: tuple[str, ...] = ("startOffset", "endOffset", "positionIncrement", "positionLength")) -> Column:
    return F.transform(tokens, lambda t: t.dropFields(*fields))


def shelf(tags: Column, kinds: list[str], plurals: dict[str, str], statuses: list[str], allow_unknown: bool = False) -> Column:
    """A path kind/collection/status from tags: the kind, in the plural, is one of ``kinds``; the collection
    is in a tag ``collection-...``; the status is one of ``statuses``. Null without kind, or ``unknown``."""
    hit = lambda options: F.get(F.filter(F.array_sort(tags), lambda t: t.rlike("^(" + "|".join(options) + ")$")), F.lit(0))
    names = F.create_map(*[F.lit(x) for k in kinds for x in (k, plurals.get(k, k + "s"))])
    kind = F.try_element_at(names, hit(kinds))
    kind = F.coalesce(kind, F.lit("unknown")) if allow_unknown else kind
    collection = F.get(F.filter(F.array_sort(F.transform(tags, lambda t: F.nullif(F.regexp_extract(t, "^collection-(.+)$", 1), F.lit("")))), lambda t: t.isNotNull()), F.lit(0))
    return F.when(kind.isNotNull(), F.concat_ws("/", kind, collection, hit(statuses)))


def address(id_col: Column, prefix: str, missing: str = "notfound") -> Column:
    return F.when(id_col.isNotNull() & (id_col != missing), F.concat(F.lit(prefix), id_col))


def input_kind(files: DataFrame, group: str, name: str) -> DataFrame:
    """The kind of input that all files of a group are, by extension; an error if they differ or are unknown."""
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    known = F.create_map(*[F.lit(x) for kind, exts in INPUT_KINDS.items() for e in exts for x in (e, kind)])
    out = files.groupBy(group).agg(F.collect_set(ext).alias("__e"))
    kind = F.try_element_at(known, F.col("__e")[0])
    said = F.raise_error(F.concat(F.lit("mixed or unknown files: "), F.array_join(F.array_sort("__e"), ", "))).cast("string")
    return out.select(group, F.when((F.size("__e") == 1) & kind.isNotNull(), kind).otherwise(said).alias("kind"))


def leaf_count(nested: Column, *path: str) -> Column:
    """The number of items at the end of a path of arrays."""
    if not path:
        return F.greatest(F.size(nested), F.lit(0)).cast("long")
    return F.aggregate(nested, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(leaf_count(x[path[0]], *path[1:]), F.lit(0)))


#: Lines that only sound, and a name before what is said.
EFFECT, ACTOR = r"^\s*(?:（[^（）]*）|♪～|～♪|♪)\s*$", r"^\s*（([^（）]+)）\s*"


def line_kinds(blocks: DataFrame, file: str = "file", pos: str = "pos", text: str = "text", effect_pattern: str = EFFECT, actor_pattern: str = ACTOR) -> DataFrame:
    """Blocks split where the kind of their lines changes: (file, pos, part, kind, actor, text).

    A line of full-width parentheses only, or between note and wave signs, is a sound effect; a line that
    begins with parentheses and goes on names an actor, who says the lines that follow.
    """
    lines = blocks.select(F.col(file).alias("file"), F.col(pos).alias("pos"), F.posexplode(F.split(text, r"\r?\n")).alias("line_no", "line"))
    effect = F.col("line").rlike(effect_pattern)
    actor = F.nullif(F.regexp_extract("line", actor_pattern + r"\S", 1), F.lit(""))
    w = Window.partitionBy("file", "pos").orderBy("line_no")
    rows = lines.withColumns({"effect": effect, "__actor": F.when(~effect, actor)})
    new = F.when(F.col("__actor").isNotNull() | (F.col("effect") != F.lag("effect", 1).over(w)) | F.lag("effect").over(w).isNull(), 1).otherwise(0)
    rows = rows.withColumn("part", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    said = F.when(F.col("__actor").isNotNull(), F.regexp_replace("line", actor_pattern, "")).otherwise(F.col("line"))
    out = rows.withColumn("said", said).groupBy("file", "pos", "part").agg(
        F.when(F.bool_or("effect"), "SoundEffect").otherwise("Primary").alias("kind"), F.max("__actor").alias("actor"), F.array_sort(F.collect_list(F.struct("line_no", "said"))).alias("l")
    )
    joined = F.array_join(F.transform("l", lambda x: x["said"]), "\n")
    return out.select("file", "pos", F.col("part").cast("long").alias("part"), "kind", "actor", joined.alias("text")).where(~blank("text"))


def json_array(rows: DataFrame) -> DataFrame:
    """The whole table as one JSON array in one row: for a small export; others go by ``write_json_array``."""
    item = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))
    return rows.agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(item)), ","), F.lit("]")).alias("value"))


def write_json_array(rows: DataFrame, path: str, order: list[str], partitions: int | None = None) -> list[str]:
    """Writes the whole table as one JSON array, by ``order``, in fragments: the files below ``path``, in the order of their
    names, are the array. Where the file system can join files (HDFS), they become one.

    Each task sorts and writes a range. A comma goes before each item but the first, which is the first row of its partition
    with the least key, as equal keys lie in one range. Nulls come first and are left out of their items; an empty table is
    an empty array. Returns the files' names.
    """
    spark = rows.sparkSession
    key = F.struct(*[F.col(f"`{c}`") for c in order])
    least = rows.agg(F.min(key).alias("k"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *[F.col(f"`{c}`") for c in order]).sortWithinPartitions(*[F.col(f"`{c}`") for c in order])
    item = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))
    first = F.col("at").bitwiseAND((1 << 33) - 1) == 0
    lines = ranged.select(item.alias("item"), key.alias("key"), F.monotonically_increasing_id().alias("at")).join(F.broadcast(least))  # one row
    lines.select(F.concat(F.when(first & F.col("key").eqNullSafe(F.col("k")), "").otherwise(","), "item").alias("value")).write.text(path)
    jvm = spark.sparkContext._jvm
    place = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join(parts))
    fs = place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name, text in (("part--head.txt", "[\n"), ("part-~tail.txt", "]\n")):
        out = fs.create(place(path, name), True)
        out.write(bytearray(text.encode()))
        out.close()
    names = sorted(s.getPath().getName() for s in fs.listStatus(place(path)) if s.getPath().getName().startswith("part-"))
    if fs.getScheme() == "hdfs":
        others = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(names) - 1)
        for i, name in enumerate(names[1:]):
            others[i] = place(path, name)
        fs.concat(place(path, names[0]), others)
        names = names[:1]
    return names


def update_cache(cache: DataFrame, computed: DataFrame, key: str = "path") -> DataFrame:
    """Cached rows by key, those computed anew in their place."""
    return cache.join(computed.select(key), key, "left_anti").unionByName(computed)


def cache_files(cache: DataFrame, group: str, name: str, value: str) -> DataFrame:
    """(file, content): each group's cache as JSON, its names in order, so that equal caches are equal files."""
    entry = F.concat(F.to_json(F.struct(F.col(name).alias("k"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(name).alias("k")))) - 6), F.lit(':"'), F.col(value), F.lit('"'))
    one = cache.groupBy(F.col(group).alias("file")).agg(F.array_sort(F.collect_list(F.struct(F.col(name).alias("n"), entry.alias("e")))).alias("x"))
    return one.select("file", F.concat(F.lit('{"images":{'), F.array_join(F.transform("x", lambda x: x["e"]), ","), F.lit("}}\n")).alias("content"))


def to_compute(wanted: DataFrame, cache: DataFrame, key: str = "path") -> DataFrame:
    """Keys without a cached row, each once, however many ask for it."""
    return wanted.select(key).distinct().join(cache, key, "left_anti")
