"""Results of text recognition in images, as rows of (file, pos, text, spans)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Further providers: their schema, and what makes (file, pos, text, spans) rows of it.
_MORE: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {}


def register(provider: str, schema: str, lines: Callable[[DataFrame], DataFrame]) -> None:
    """Adds a provider of ``*.<provider>.json`` files: ``lines`` gets rows of ``schema`` with a column file."""
    _MORE[provider] = (schema, lines)


def _name() -> Column:
    """The file's name; Spark gives it as a part of an address."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


_WORD = "struct<text:string,confidence:double>"
_SCHEMAS = {
    "acv4": f"readResult struct<blocks:array<struct<lines:array<struct<text:string,words:array<{_WORD}>>>>>>",
    "easyocr": "readResult array<struct<text:string,confident:double>>",
    "acv": "analyzeResult struct<readResults:array<struct<lines:array<struct<text:string,boundingBox:array<int>,words:array<struct<text:string,boundingBox:array<int>,confidence:double>>>>>>>",
    "gcv": "responses array<struct<fullTextAnnotation:struct<pages:array<struct<blocks:array<struct<paragraphs:array<struct<words:array<struct<confidence:double,symbols:array<struct<text:string>>>>>>>>>>>>>",
}


def read_recognised(spark: SparkSession, path: str, provider: str) -> DataFrame:
    """Lines of all ``*.<provider>.json`` files below ``path``; blank ones are dropped."""
    if provider in _MORE:
        schema, lines = _MORE[provider]
        raw = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", f"*.{provider}.json").json(path)
        rows = lines(raw.withColumn("file", F.regexp_replace(_name(), rf"\.{provider}\.json$", "")))
        return rows.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    df = spark.read.schema(_SCHEMAS[provider]).option("multiLine", True).option("pathGlobFilter", f"*.{provider}.json").json(path)
    base = F.regexp_replace(_name(), rf"\.{provider}\.json$", "").alias("file")
    span = lambda w: F.struct(w["text"].alias("text"), w["confidence"].alias("confidence"))
    if provider == "acv4":
        lines = F.flatten(F.transform("readResult.blocks", lambda b: b["lines"]))
        rows = df.select(base, F.posexplode(lines).alias("pos", "x")).select("file", "pos", F.col("x.text").alias("text"), F.transform("x.words", span).alias("spans"))
    elif provider == "easyocr":
        rows = df.select(base, F.posexplode("readResult").alias("pos", "x")).select("file", "pos", F.col("x.text").alias("text"), F.array(F.struct(F.col("x.text").alias("text"), F.col("x.confident").alias("confidence"))).alias("spans"))
    elif provider == "acv":
        lines = F.get("analyzeResult.readResults", F.lit(0))["lines"]
        rows = df.select(base, F.posexplode(lines).alias("pos", "x")).select("file", "pos", F.col("x.text").alias("text"), F.transform("x.words", span).alias("spans"), F.col("x.boundingBox").alias("box"))
    else:
        paragraphs = F.flatten(F.flatten(F.flatten(F.transform("responses", lambda r: F.transform(r["fullTextAnnotation"]["pages"], lambda p: F.transform(p["blocks"], lambda b: b["paragraphs"]))))))
        word = lambda w: F.struct(F.array_join(F.transform(w["symbols"], lambda s: s["text"]), "").alias("text"), w["confidence"].alias("confidence"))
        rows = df.select(base, F.posexplode(paragraphs).alias("pos", "x")).select("file", "pos", F.transform("x.words", word).alias("spans"))
        rows = rows.select("file", "pos", F.array_join(F.transform("spans", lambda s: s["text"]), "").alias("text"), "spans")
    return rows.where(F.trim(F.coalesce("text", F.lit(""))) != "")


def recognised_chunks(lines: DataFrame, role: str | None = None) -> DataFrame:
    """(file, chunks): an image's lines as chunks."""
    chunk = F.struct("text", F.lit(role).cast("string").alias("role"), F.struct(F.col("spans").alias("textSpans")).alias("image"))
    rows = lines.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("pos", F.to_json(chunk).alias("c")))).alias("c"))
    kind = "struct<text:string,role:string,image:struct<textSpans:array<struct<text:string,confidence:double>>>>"
    return rows.select("file", F.transform("c", lambda x: F.from_json(x["c"], kind)).alias("chunks"))
