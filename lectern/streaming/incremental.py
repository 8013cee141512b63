"""Incremental runs over files that keep arriving, and event-time windows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.operators._store import ROWS_PER_BATCH

#: What opening a file counts as beside its bytes, where files are dealt to tasks. Spark's own 4 MB let a task have 32 files at most.
_OPEN_BYTES = 1 << 16

#: Names of files that the text reader wouldn't unpack. It copies the settings of Hadoop for each file under a lock of the executor, so that tasks
#: over small files wait for each other; the reader of bytes doesn't.
_PLAIN = re.compile(r"\.(?!(?:gz|bz2|deflate|lz4|snappy|zst|passthrough)$)\w+$")


def _session(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark`` for streams of many small files: the number of tasks that list and read them goes by
    the cluster and by bytes, not by files."""
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if session.conf.isModifiable(key):
            session.conf.set(key, value)
    # A batch lists each of its files by name once more, and the last batch's again when a stream starts: by default in a task for each, up to 10,000.
    for key, most in (("spark.sql.sources.parallelPartitionDiscovery.parallelism", 4 * spark.sparkContext.defaultParallelism), ("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)):
        session.conf.set(key, min(most, int(session.conf.get(key)) or most))
    session.conf.set("spark.sql.files.openCostInBytes", _OPEN_BYTES)
    return session


def process_new_files(spark: SparkSession, path: str, glob: str, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Whole text files (file, content) that earlier runs have not seen, transformed and appended as
    Parquet. The checkpoint remembers them; a file is processed once, also after a failure."""
    stream = _session(spark).readStream.option("pathGlobFilter", glob)
    if _PLAIN.search(glob):
        raw, content = stream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path), F.col("content").cast("string")
    else:
        raw, content = stream.format("text").option("wholetext", True).schema("value string").load(path), F.col("value")
    rows = transform(raw.select(F.col("_metadata.file_name").alias("file"), content.alias("content")))
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def budgeted(wanted: DataFrame, done: DataFrame, key: str, budget: int) -> DataFrame:
    """The next ``budget`` keys that no earlier run has done, by their order. Runs that append what they did to
    ``done`` resume where the one before stopped, whether it ended or failed."""
    return wanted.select(key).distinct().join(done.select(key), key, "left_anti").orderBy(key).limit(budget)


def event_windows(events: DataFrame, ts: str, keys: list[str], value: str, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and keys; rows later than ``lateness`` are left out."""
    w = F.window(ts, width)
    agg = events.withWatermark(ts, lateness).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return agg.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def leader_clusters_stream(images: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Leader clustering of (file, pos, name, signature) rows as they arrive; the state of a file is its
    leader. Within a batch rows are taken by position; between batches, as they came."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        leader = state.get if state.exists else None
        rows = pd.concat(list(frames)).sort_values("pos")
        out = []
        for pos, name, sig in zip(rows["pos"], rows["name"], rows["signature"], strict=True):
            grp = candidate = sim = None
            if name is not None and not pd.isna(sig):
                if leader is not None:
                    sim = 1 - ((int(leader[1]) ^ int(sig)) & (1 << 64) - 1).bit_count() / 64
                if leader is not None and sim >= threshold:
                    grp = leader[0]
                else:
                    candidate, leader = (leader[0] if leader else None), (name, int(sig))
            out.append((key[0], int(pos), name, grp, candidate, sim))
        if leader is not None:
            state.update(leader)
        yield pd.DataFrame(out, columns=["file", "pos", "name", "grp", "candidate", "similarity"]).astype({"similarity": "float64"})

    return images.groupBy("file").applyInPandasWithState(step, "file string, pos bigint, name string, grp string, candidate string, similarity double", "name string, sig bigint", "append", GroupStateTimeout.NoTimeout)
