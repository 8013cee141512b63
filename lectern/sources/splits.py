"""Streams of records in files that many tasks read: each takes a range of a file's bytes, cut at record boundaries.

Spark's text reader finds the boundaries: it cuts files anywhere and starts each range at the separator after its first byte. A record's
place is the byte at which its range begins plus its number in the range. As a record takes a byte at least, places ascend through
a file, whatever its ranges are, and no range needs to know how many records the ones before it have. Files of one range have the
places 0, 1, 2, ...
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Characters that ``placed`` gives on at once, but for a longest record.
MOST_CHARS = 1 << 20


def records(spark: SparkSession, path: str, glob: str = "*", separator: str | None = None) -> DataFrame:
    """(file, begin, more, value): the records of the files at ``path``, between separators or, without one, lines by any line end.
    ``begin`` is where the record's range begins, ``more`` whether the file goes on behind that range. A compressed file is one range."""
    reader = spark.read.option("pathGlobFilter", glob)
    if separator is not None:
        reader = reader.option("lineSep", separator)
    about = lambda name: F.col(f"_metadata.{name}")
    return reader.text(path).select(about("file_name").alias("file"), about("file_block_start").alias("begin"), (about("file_block_start") + about("file_block_length") < about("file_size")).alias("more"), "value")


def placed(rows: DataFrame, convert: Callable[[str, str], Iterator[str]], column: str = "json", skip: int = 0) -> DataFrame:
    """(file, pos, <column>): what ``convert(file, value)`` makes of each record, with its place. The first ``skip`` of each file are left out;
    they must lie in its first range, else it is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n = None, 0
        for batch in batches:
            files, places, values, size = [], [], [], 0
            for file, begin, more, value in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.columns[3], strict=True):
                if (file, begin, more) != at:
                    _complete(at, n, skip)
                    at, n = (file, begin, more), 0
                for made in convert(file, value.as_py()):
                    if begin or n >= skip:
                        files.append(file)
                        places.append(begin + n - (0 if begin else skip))
                        values.append(made)
                        size += len(made)
                    n += 1
                if size > MOST_CHARS:  # what a task holds at once is bounded by characters too, not by records alone
                    yield pa.record_batch([pa.array(files, pa.string()), pa.array(places, pa.int64()), pa.array(values, pa.string())], names=["file", "pos", column])
                    files, places, values, size = [], [], [], 0
            yield pa.record_batch([pa.array(files, pa.string()), pa.array(places, pa.int64()), pa.array(values, pa.string())], names=["file", "pos", column])
        _complete(at, n, skip)

    return rows.select("file", "begin", "more", "value").mapInArrow(run, f"file string, pos bigint, `{column}` string")


def _complete(at: tuple[str, int, bool] | None, n: int, skip: int) -> None:
    if at is not None and at[1] == 0 and at[2] and n < skip:
        raise ValueError(f"{at[0]}: the {skip} records to skip don't lie in the file's first range, which has {n}")
