"""Tables that cut lineage, below the folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows that a Python worker gets at once.
ROWS_PER_BATCH = 1_000


#: The folders of local sessions that name none, by application.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local session gets a temporary one; on a cluster
    that would be a folder of each machine's own, so it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:  # the setting can't be changed while a session runs
            path = tempfile.mkdtemp(prefix="lectern-")
            atexit.register(shutil.rmtree, path, True)
            _OWN[app] = f"file://{path}"
        base = _OWN[app]
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else has."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Deletes what was stored at a path, once nothing reads it any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def moved(spark: SparkSession, source: str, target: str) -> bool:
    """Renames a folder; whether it did. If another was there first, that one stays and ``source`` is deleted."""
    old, new = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = not fs.exists(new) and fs.rename(old, new)
    if not done:
        fs.delete(old, True)
    elif fs.exists(nested := spark.sparkContext._jvm.org.apache.hadoop.fs.Path(new, old.getName())):
        fs.delete(nested, True)  # the other one came between: ours went into it
    return done


def stored(df: DataFrame, name: str = "table", path: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet below the shared folder and reads it back: lineage ends here, and the
    table outlives the executors that wrote it."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    # Nothing reads this job's shuffle files after it: they go at once, so steps don't add up on disk. Python workers
    # get whole texts, so few at a time.
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", rows: str(min(ROWS_PER_BATCH, int(spark.conf.get(rows)) or ROWS_PER_BATCH))}
    before = {key: spark.conf.get(key) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)
