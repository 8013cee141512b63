"""Exact deduplication over a persistent digest index."""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import by_group, shared_folder, stored


def normalised(text: Column) -> Column:
    """Whitespace runs become one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


#: Digests that one bucket is meant to hold: about 200 MB, one task's share of a join.
BUCKET_ROWS = 4_000_000

#: Ingests after which an index is written anew, so that a bucket is one sorted file again.
COMPACT_AFTER = 16

_RECORD = "buckets INT, folder STRING, at LONG"


class DigestIndex:
    """A table of the digests seen so far, bucketed and sorted by digest.

    ``ingest`` appends the digests of new rows that a sort-merge anti-join doesn't find in it. As the
    table is bucketed, only the new side of that join is shuffled, however large the index has become.

    With a ``path`` the index outlasts its session: opening the path again finds what is there, with the
    buckets that it was made with. Without one it is below the shared folder, under a name of its own. Each
    ingest writes one file a bucket; ``expected`` digests set the number of buckets of a new index. After COMPACT_AFTER
    ingests ``compact`` writes the index anew, beside the old files, and a record appended at the end tells which are the
    index: a session that fails between leaves the old ones in force. One session at a time may ingest into a path.

    Cases: null texts count as empty and equal each other. Rows that share the smallest doc_id of a
    group are one document and stay together. A row with a null id never stays before one with an id;
    a group of null ids only has keep_id null and kept false. Other columns are ignored. An empty
    table gives no rows and leaves the index as it was. A name that the catalog has for a table elsewhere is an error.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, expected: int = 0):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.path = (path or f"{shared_folder(spark)}/{self.name}").rstrip("/")
        found = self._recorded()
        self.buckets, self.folder = found or (max(8, -(-expected // BUCKET_ROWS)), "digests")
        if spark.catalog.tableExists(self.name):
            self._must_be_here()
        else:
            self._create()

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _files(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _create(self) -> None:
        self.spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{self.folder}'"
        )

    def _must_be_here(self) -> None:
        """An error unless the catalog's table of this name is this index."""
        about = {r["col_name"]: r["data_type"] for r in self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.name}").collect()}
        here = self._files().makeQualified(self._path(self.folder)).toUri().getPath()
        if self.spark.sparkContext._jvm.java.net.URI(about["Location"].replace(" ", "%20")).getPath().rstrip("/") != here:
            raise ValueError(f"{self.name} is a table at {about['Location']}, not the index at {self.path}")

    def _records(self) -> DataFrame:
        return self.spark.read.schema(_RECORD).parquet(f"{self.path}/buckets")

    def _recorded(self) -> tuple[int, str] | None:
        """The number of buckets that the files at the path were made with, and their folder."""
        try:
            last = self._records().orderBy(F.col("at").desc_nulls_last()).first()
        except AnalysisException:  # no index there yet
            return None
        return (last["buckets"], last["folder"] or "digests") if last else None

    def _record(self) -> None:
        row = self.spark.range(1).select(F.lit(self.buckets).alias("buckets"), F.lit(self.folder).alias("folder"), F.lit(time.time_ns()).alias("at"))
        row.write.mode("append").parquet(f"{self.path}/buckets")

    def _write(self, digests: DataFrame, name: str, folder: str) -> None:
        """Dealt as the buckets are, each task writes the one file of its bucket."""
        dealt = digests.select("digest", "keep_id").repartition(self.buckets, "digest")
        dealt.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", f"{self.path}/{folder}").saveAsTable(name)

    def seen(self) -> DataFrame:
        return self.spark.table(self.name)

    def ingests(self) -> int:
        """Ingests since the index was made or compacted: files that a bucket has."""
        if self._recorded() is None:
            return 0
        return self._records().where(F.coalesce("folder", F.lit("digests")) == self.folder).count()

    def compact(self) -> None:
        """Writes each bucket as one sorted file; digests and kept ids stay as they are. A task reads a bucket and writes
        it, without a shuffle: the scan has to stay bucketed, as Spark takes the repartition for done."""
        old, new = self.folder, f"digests-{uuid.uuid4().hex}"
        made = f"{self.name}_{uuid.uuid4().hex}"
        auto = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
        before = self.spark.conf.get(auto)
        try:
            self.spark.conf.set(auto, "false")
            self._write(self.seen(), made, new)
        finally:
            self.spark.conf.set(auto, before)
        self.spark.sql(f"DROP TABLE {made}")
        self.folder = new
        self._record()  # from here on the new files are the index
        self.spark.sql(f"DROP TABLE {self.name}")
        self._create()
        self._files().delete(self._path(old), True)

    def drop(self, files: bool = False) -> None:
        """Takes the index out of the catalog; with ``files`` its digests go too. What ``ingest`` returned stays
        readable: it doesn't read the index."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        if files:
            self._files().delete(self._path(), True)

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """A row per input row: doc_id, keep_id, group_size (equal rows of this batch), kept, text_sha256."""
        rows = stored(
            docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest")),
            "digests",
        )
        groups = stored(rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("group_size")), "groups")
        seen = self.seen().hint("merge")
        fresh = groups.join(seen, "digest", "left_anti").select("digest", F.col("first_id").alias("keep_id"), "group_size", F.lit(True).alias("fresh"))
        hits = groups.join(seen, "digest").select("digest", "keep_id", "group_size", F.lit(False).alias("fresh"))
        known = stored(fresh.unionByName(hits), "known")
        self._write(known.where("fresh"), self.name, self.folder)
        self._record()
        self.spark.catalog.refreshTable(self.name)
        if self.ingests() >= COMPACT_AFTER:
            self.compact()
        return by_group(rows, known.drop("fresh"), ["digest"], "group_size").select(
            "doc_id",
            "keep_id",
            "group_size",
            F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )

    def ingest_in_order(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """As ``ingest``, in two batches, the lower half of the ids' range first: the second meets the index that the first
        has filled, and of equal texts the smallest id stays all the same. group_size counts both batches. Rows
        without an id are of the second."""
        span = docs.agg(F.min(F.col(id_col).cast("long")).alias("a"), F.max(F.col(id_col).cast("long")).alias("b")).first()
        early = F.coalesce(F.col(id_col).cast("long") <= F.lit(None if span["a"] is None else (span["a"] + span["b"]) // 2).cast("long"), F.lit(False))
        rows = stored(self.ingest(docs.where(early), id_col, text_col).unionByName(self.ingest(docs.where(~early), id_col, text_col)), "batches")
        sizes = stored(rows.groupBy("text_sha256").agg(F.count("*").alias("group_size")), "sizes")
        return by_group(rows.drop("group_size"), sizes, ["text_sha256"], "group_size").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
