"""Table functions for SQL, as Python generators: what no expression can do row by row."""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType


@udtf(returnType=StructType([StructField("pos", IntegerType()), StructField("json", StringType())]))
class YamlDocuments:
    """The documents of a YAML text, as JSON."""

    def eval(self, text: str):
        from lectern.sources.blocks import documents

        for pos, doc in enumerate(documents(text or "")):
            yield pos, json.dumps(doc, ensure_ascii=False)


@udtf(returnType=StructType([StructField("line_no", IntegerType()), StructField("line", StringType()), StructField("fits", BooleanType())]))
class TextLines:
    """The lines of a text, and whether each fits a pattern."""

    def eval(self, text: str, pattern: str):
        for n, line in enumerate((text or "").split("\n")):
            yield n, line, re.search(pattern, line) is not None


def register(spark: SparkSession) -> None:
    """Makes ``yaml_documents(text)`` and ``text_lines(text, pattern)`` known to SQL."""
    spark.udtf.register("yaml_documents", YamlDocuments)
    spark.udtf.register("text_lines", TextLines)
