"""Delimited, JSON, XML and key-value sources with fixed schemas."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.sources import splits

#: Leading columns of the public title datasets; later ones are not parsed.
TITLE_TABLES = {
    "basics": "tconst string, titleType string, primaryTitle string, originalTitle string, isAdult string, startYear string, endYear string, runtimeMinutes string, genres string",
    "akas": "titleId string, ordering string, title string, region string, language string, types string, attributes string, isOriginalTitle string",
    "ratings": "tconst string, averageRating string, numVotes string",
    "episode": "tconst string, parentTconst string, seasonNumber string, episodeNumber string",
}


def read_titles(spark: SparkSession, path: str, table: str, columns: list[str] | None = None) -> DataFrame:
    """A tab-separated title table: no quoting, ``\\N`` is null, rows without a second column are dropped.
    Only the asked columns are parsed."""
    schema = TITLE_TABLES[table]
    df = spark.read.csv(path, sep="\t", header=True, schema=schema, quote="", nullValue=r"\N", mode="PERMISSIVE", enforceSchema=True)
    first, second = (x.split()[0] for x in schema.split(", ")[:2])
    return df.where(F.col(first).isNotNull() & F.col(second).isNotNull()).select(*(columns or df.columns))


def typed_basics(basics: DataFrame) -> DataFrame:
    """Title basics with numbers, a boolean and a list of genres."""
    return basics.withColumns(
        {"isAdult": F.col("isAdult") == "1", "genres": T.split_list("genres")} | {c: F.col(c).try_cast("int") for c in ("startYear", "endYear", "runtimeMinutes")}
    )


MEDIA = "key string, c1 string, audio string, image string, c4 string, c5 string"


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """The headerless media list of six columns: (base, ref, ordinal, audio, image). A row of another
    width, or a malformed audio or image, is an error."""
    raw = spark.read.text(path).where("value <> ''").select(F.split("value", "\t", -1).alias("c"))
    checked = raw.withColumn("n", F.when(F.size("c") != 6, F.raise_error(F.concat(F.lit("expected 6 columns, found "), F.size("c").cast("string"))).cast("int")).otherwise(6)).where("n = 6")
    k = T.media_key(F.col("c")[0])
    return checked.select(k["base"].alias("base"), k["ref"].alias("ref"), k["ordinal"].alias("ordinal"), T.sound_file(F.col("c")[2]).alias("audio"), T.image_file(F.col("c")[3]).alias("image"))


def read_lists(spark: SparkSession, paths: list[str], schema: str = "Position int, Const string, Title string") -> DataFrame:
    """List exports with a header, each row with the list's name: the file's without extension."""
    df = spark.read.csv(sorted(set(paths)), header=True, schema=schema)
    return df.select(T.without_extensions(F.col("_metadata.file_name")).alias("list"), *df.columns)


def read_delimited(spark: SparkSession, path: str, columns: list[str], sep: str = "\t", skip: int = 0) -> DataFrame:
    """Lines after the first ``skip`` of each file, split into the columns; missing ones are null. Many tasks read a file; pos ascends
    in it, and is 0, 1, 2, .. in files that one range holds (see ``splits``)."""
    rows = splits.placed(splits.records(spark, path), lambda _, line: iter((line,)), "line", skip)
    parts = F.split("line", re.escape(sep), -1)
    return rows.select("file", "pos", *[F.get(parts, F.lit(k)).alias(c) for k, c in enumerate(columns)])


def write_csv(rows: DataFrame, path: str) -> None:
    """A table with a header line in each file."""
    rows.write.mode("overwrite").csv(path, header=True)


def extracted(spark: SparkSession, source: str, target: str, force: bool = False) -> str:
    """The lines of compressed text at ``target``, once: what is there is used again, unless ``force``. Compressed
    files can't be split, so their lines are dealt out anew."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
    if force or not done.getFileSystem(conf).exists(done):
        spark.read.text(source).write.mode("overwrite").text(target)
    return target


def mapped(rows: DataFrame, spec: list[dict], out: str = "block") -> DataFrame:
    """Columns put into a nested record: ``spec`` lists {target, order, value}, where value is a Column or a
    column's name. Empty values are left out; targets come by order."""
    fields = [(s["target"], F.col(s["value"]) if isinstance(s["value"], str) else s["value"]) for s in sorted(spec, key=lambda s: s.get("order", 0))]
    return rows.withColumn(out, F.struct(*[F.nullif(v, F.lit("")).alias(t) for t, v in fields]))


def read_json_map(spark: SparkSession, path: str, value_schema: str, key: str = "id") -> DataFrame:
    """An object of records by id, as rows."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", f"map<string,{value_schema}>")).alias(key, "record"))


def package_images(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("jpg", "jpeg", "png", "gif", "webp", "svg")) -> DataFrame:
    """(id, name) of the images in packages' media maps, objects of file names by id."""
    names = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("id", "name"))
    return names.where(F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)).isin(*kinds))


def read_key_values(spark: SparkSession, path: str) -> DataFrame:
    """``name: value`` lines."""
    line = r"^\s*([^:#]+?)\s*:\s*(.*?)\s*$"
    return spark.read.text(path).where(F.col("value").rlike(line)).select(F.regexp_extract("value", line, 1).alias("name"), F.regexp_extract("value", line, 2).alias("value"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Entries of an XML dictionary: id, written forms, readings, glosses."""
    schema = "ent_seq bigint, k_ele array<struct<keb:string>>, r_ele array<struct<reb:string>>, sense array<struct<gloss:array<string>>>"
    df = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    return df.select(F.col("ent_seq").alias("id"), F.col("k_ele.keb").alias("kanji"), F.col("r_ele.reb").alias("readings"), F.flatten(F.col("sense.gloss")).alias("glosses"))


def package_metadata(xml: Column) -> dict[str, Column]:
    """Title and product id of an e-book package's metadata."""
    return {"title": F.call_function("xpath_string", xml, F.lit("//*[local-name()='title']")), "asin": F.call_function("xpath_string", xml, F.lit("//*[local-name()='meta'][@name='ASIN']/@content"))}


def page_texts(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of a structured-text XML of pages, by the page's number, their characters joined."""
    schema = "_number int, block array<struct<line:array<struct<font:array<struct<char:array<struct<_c:string>>>>>>>>"
    df = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    line = lambda x: F.array_join(F.flatten(F.transform(x["font"], lambda f: F.transform(f["char"], lambda c: c["_c"]))), "")
    return df.select(F.col("_number").alias("page"), F.posexplode("block").alias("pos", "b")).select("page", "pos", F.array_join(F.transform("b.line", line), "\n").alias("text"))


def embedded_json(html: Column, schema: str, script_id: str = "__NEXT_DATA__") -> Column:
    """The JSON of a page's script element."""
    return F.from_json(F.regexp_extract(html, rf'(?s)<script[^>]*id="{script_id}"[^>]*>(.*?)</script>', 1), schema)


def table_rows(html: Column) -> Column:
    """Cells of all table rows of a page: an array of arrays of text."""
    rows = F.regexp_extract_all(html, F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?s)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), T.html_text))


def links(html: Column) -> Column:
    """(href, text) of all links of a page."""
    found = F.regexp_extract_all(html, F.lit(r'(?s)(<a\s[^>]*href="[^"]*"[^>]*>.*?</a>)'), F.lit(1))
    return F.transform(found, lambda a: F.struct(F.regexp_extract(a, 'href="([^"]*)"', 1).alias("href"), T.html_text(a).alias("text")))


def listing(spark: SparkSession, path: str, glob: str = "*", recursive: bool = False) -> DataFrame:
    """Files below a path: path, name, length and mtime, without their contents."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(path)
    return df.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "length", F.col("modificationTime").alias("mtime"))


def image_groups(files: DataFrame, pattern: str, slug: str, name: str = "name") -> DataFrame:
    """Images with the group that a pattern's first capture, else its match, else the slug names."""
    first = F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")) if "(" in pattern else F.lit(None).cast("string")
    return files.withColumn("grp", F.coalesce(first, F.nullif(F.regexp_extract(name, pattern, 0), F.lit("")), F.lit(slug)))
