"""The corpus pipeline: quality, boilerplate, near copies, benchmark leaks, mixture.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the last
return the columns of ``documents``.

Each stage takes any table with these columns. Further columns are left out by all stages but the last, whatever
their names; the last keeps them, but replaces replica and shuffle_key. An empty table stays empty. Rows without an id
are kept or dropped by their texts alone, lose every boilerplate line, are no near copies, and are repeated by their
texts. Rows that repeat an id stay or go together, as far as their texts do. Null and empty texts have a quality
score, no lines, no shingles and no leaks; null sources are no sites, and are mixed at rate 1. Very long texts are
read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, line_dedup, mixing, ngram_join, quality
from lectern.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores at or above its threshold."""
    model = quality.train_on(docs, table(spark, sf_dir, "labels"))
    return quality.kept_rows(docs, model).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate lines, but for their first occurrence."""
    cleaned = line_dedup.without_boilerplate(docs)
    return cleaned.select(*[F.length("text").cast("long").alias("n_chars") if c == "n_chars" else c for c in COLUMNS])


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar ones."""
    return ngram_join.without_near_copies(docs).select(*COLUMNS)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to equal shares of the sources, in random order."""
    return mixing.mix(docs, mixing.EQUAL)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_join", near_copy_stage),
    ("decontamination", leak_stage),
    ("source_mix", mix_stage),
]

#: SQL can express neither the trained rules nor the edit matching.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
