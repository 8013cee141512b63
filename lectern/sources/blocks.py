"""Content blocks: the schema, and streams of them in multi-document YAML."""

from __future__ import annotations

import contextlib
import json
import os
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any
from urllib.parse import unquote

import pyarrow as pa
import yaml
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.time import format_vtt, vtt_time
from lectern.sources import splits

_GROUP = "struct<name:string,similarity:double>"
_IMAGE = f"struct<name:string,group:{_GROUP},groupCandidate:{_GROUP}>"
_SOURCE = "struct<ordinal:int,timecodes:struct<start:string,end:string>,note:string,resource:string>"
_BLOCK_PART = f"struct<image:{_IMAGE},source:{_SOURCE}>"
_CHUNK_IMAGE = "struct<textSpans:array<struct<text:string,confidence:double>>>"
_CHUNK_PART = f"text:string,actor:string,role:string,image:{_CHUNK_IMAGE}"
#: A content block as its files have it.
BLOCK = f"struct<id:string,image:{_IMAGE},audio:struct<name:string>,source:{_SOURCE},references:map<string,{_BLOCK_PART}>,chunks:array<struct<{_CHUNK_PART},references:map<string,struct<{_CHUNK_PART}>>>>>"


class _Loader(yaml.SafeLoader):
    """YAML whose plain scalars are JSON's: null, true, false and numbers; all else is text."""

    yaml_implicit_resolvers: dict = {}

    def compose_node(self, parent, index):
        if self.check_event(yaml.AliasEvent):
            raise yaml.composer.ComposerError(None, None, "aliases are not supported", self.peek_event().start_mark)
        return super().compose_node(parent, index)


_Loader.add_implicit_resolver("tag:yaml.org,2002:null", yaml.resolver.re.compile(r"^(?:null|)$"), ["n", ""])
_Loader.add_implicit_resolver("tag:yaml.org,2002:bool", yaml.resolver.re.compile(r"^(?:true|false)$"), ["t", "f"])
_Loader.add_implicit_resolver("tag:lectern,number", yaml.resolver.re.compile(r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$"), list("-0123456789"))
_Loader.add_constructor("tag:lectern,number", lambda loader, node: json.loads(loader.construct_scalar(node)))


class _FastLoader(getattr(yaml, "CSafeLoader", _Loader)):
    """The same with the C parser, which can't be made to refuse aliases: for texts without any."""

    yaml_implicit_resolvers = _Loader.yaml_implicit_resolvers


_FastLoader.add_constructor("tag:lectern,number", lambda loader, node: json.loads(loader.construct_scalar(node)))


def documents(text: str, file: str = "") -> Iterator[Any]:
    """The documents of a YAML stream that aren't null; errors name the file."""
    try:
        for doc in yaml.load_all(text, _Loader if "*" in text else _FastLoader):
            if doc is not None:
                yield doc
    except yaml.YAMLError as e:
        raise ValueError(f"{file}: {e}") from e


#: What parts the documents of a stream. A document's own text can't hold it, as a line of it would be indented or quoted.
SEPARATOR = "\n---\n"


def read_yaml(spark: SparkSession, path: str, schema: str, glob: str = "*.yaml", column: str = "doc") -> DataFrame:
    """(file, pos, <column>): each document of each file below ``path``, not recursive, as ``schema`` reads
    it; unknown keys are in ``extra``, as JSON. Null documents are left out. Many tasks read a file, each a range of it, so pos ascends in a
    file and is 0, 1, 2, .. in files of one range (see ``splits``). Documents that are parted otherwise, as by ``---`` with a comment or
    before a carriage return, stay together for one task."""
    made = splits.placed(splits.records(spark, path, glob, SEPARATOR), _jsons)
    return made.select("file", "pos", F.from_json("json", schema).alias(column), F.col("json").alias("extra"))


def _jsons(file: str, text: str) -> Iterator[str]:
    return (json.dumps(d, ensure_ascii=False) for d in documents(text, file))


def write_stream(rows: DataFrame, path: str, record: str = "block") -> None:
    """Records as YAML streams, a file for each task: a document a record, of JSON in one line, which is YAML too. ``read_yaml`` reads them, as
    does any reader of YAML, in as many ranges as their sizes ask for."""
    rows.select(_yaml_safe(F.to_json(record)).alias("value")).write.option("lineSep", SEPARATOR).text(path)


#: Characters that JSON may hold as they are, while YAML takes them for line ends or refuses them.
_UNSAFE = [*range(0x7F, 0xA0), 0x2028, 0x2029, 0xFEFF, 0xFFFE, 0xFFFF]


def _yaml_safe(json_text: Column) -> Column:
    """JSON whose strings have such characters escaped."""
    escaped = json_text
    for code in _UNSAFE:
        escaped = F.replace(escaped, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.when(json_text.rlike(r"[\x7f-\x9f\u2028\u2029\ufeff\ufffe\uffff]"), escaped).otherwise(json_text)


def parsed_yaml(files: DataFrame, schema: str, column: str = "doc") -> DataFrame:
    """The same of rows whose first two columns are a file's name and its text."""

    def rows(records: list[tuple[str, int, str]]) -> pa.RecordBatch:
        names, places, docs = zip(*records, strict=True) if records else ((), (), ())
        return pa.record_batch([pa.array(names, pa.string()), pa.array(places, pa.int64()), pa.array(docs, pa.string())], names=["file", "pos", "json"])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, size = [], 0
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for pos, doc in enumerate(_jsons(file, text.as_py())):
                    made.append((file, pos, doc))
                    size += len(doc)
                    if size > splits.MOST_CHARS:  # of small files many in one batch, of a large one a part
                        yield rows(made)
                        made, size = [], 0
            yield rows(made)

    return files.mapInArrow(parse, "file string, pos bigint, json string").select("file", "pos", F.from_json("json", schema).alias(column), F.col("json").alias("extra"))


def read_optional(spark: SparkSession, path: str, schema: str, glob: str = "*.yaml", column: str = "doc") -> DataFrame:
    """``read_yaml``, without rows where there is no such path or no such file."""
    try:
        return read_yaml(spark, path, schema, glob, column)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"file string, pos bigint, `{column}` {schema if schema.startswith('struct') else f'struct<{schema}>'}, extra string")


def read_block_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of all ``.jsonl`` and ``.yaml`` files below ``path``, by their extension."""
    lines = spark.read.option("pathGlobFilter", "*.jsonl").text(path).select(F.from_json("value", schema).alias("doc"))
    return lines.unionByName(read_yaml(spark, path, schema).select("doc"))


def read_content(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, block) of a directory of ``*.content.yaml`` files."""
    return read_yaml(spark, path, BLOCK, "*.content.yaml", "block").drop("extra")


def block_times(block: Column | str) -> tuple[Column, Column]:
    """Start and end in microseconds; times may have one to seven fraction digits."""
    b = F.col(block) if isinstance(block, str) else block

    def us(x: Column) -> Column:
        padded = F.concat(F.regexp_extract(x, r"^([\d:]+)", 1), F.lit("."), F.rpad(F.substring(F.regexp_extract(x, r"\.(\d+)$", 1), 1, 3), 3, "0"))
        return vtt_time(padded)

    return us(b["source"]["timecodes"]["start"]), us(b["source"]["timecodes"]["end"])


def timecodes(start: Column | str, end: Column | str) -> Column:
    return F.struct(format_vtt(start).alias("start"), format_vtt(end).alias("end"))


# Writing -------------------------------------------------------------------------------------------

#: Keys whose values stand on one line.
_FLOW = {"timecodes", "textSpans", "tags", "linkedVolumes"}


class _Flow(dict):
    pass


class _FlowList(list):
    pass


class _Dumper(getattr(yaml, "CSafeDumper", yaml.SafeDumper)):
    def ignore_aliases(self, data):
        return True


_Dumper.yaml_implicit_resolvers = _Loader.yaml_implicit_resolvers
_Dumper.add_representer(_Flow, lambda d, v: d.represent_mapping("tag:yaml.org,2002:map", v.items(), flow_style=True))
_Dumper.add_representer(_FlowList, lambda d, v: d.represent_sequence("tag:yaml.org,2002:seq", v, flow_style=True))
_Dumper.add_representer(str, lambda d, v: d.represent_scalar("tag:yaml.org,2002:str", v, style="|" if "\n" in v else None))


def _slim(value: Any, key: str = "") -> Any:
    """Without nulls, empty collections and default roles; marked keys in flow style."""
    if isinstance(value, dict):
        kept = {k: s for k, v in value.items() if (s := _slim(v, k)) is not None and not (k == "role" and s == "primary")}
        kept = {k: v for k, v in kept.items() if v not in ({}, [])}
        return _Flow(kept) if key in _FLOW else kept
    if isinstance(value, list):
        items = [_slim(v) for v in value]
        return _FlowList([_Flow(i) if isinstance(i, dict) else i for i in items]) if key in _FLOW else items
    return value


def to_yaml(docs: list[Any]) -> str:
    """Documents with ``---`` between them."""
    return "---\n".join(yaml.dump(_slim(d), Dumper=_Dumper, allow_unicode=True, sort_keys=False, width=1 << 20) for d in docs)


def yaml_files(rows: DataFrame, file: str = "file", pos: str = "pos", record: str = "block") -> DataFrame:
    """(file, content): the YAML text of each file's records in order."""
    one = rows.select(F.col(file).alias("file"), F.struct(F.col(pos), F.to_json(record).alias("json")).alias("r")).groupBy("file").agg(F.array_sort(F.collect_list("r")).alias("r"))
    joined = one.select("file", F.transform("r", lambda r: r["json"]).alias("docs"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [to_yaml([json.loads(x) for x in docs]) for docs in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["file", "content"])

    return joined.mapInArrow(write, "file string, content string")


#: Files that the driver renames at once, on file systems which only Spark's writers reach.
_THREADS = 32


def write_files(files: DataFrame, path: str, listed: bool = False) -> list[str]:
    """A text file of its name below ``path`` for each row of (file, content), on any file system that Spark writes
    to; files of these names are replaced. In a folder that all machines mount each task gives its files their names, so that
    the work is dealt out however many files there are; elsewhere executors write the texts and the driver renames them, many at once.
    The names, if they are asked for."""
    spark = files.sparkSession
    rows = files.select(F.coalesce(F.col("file").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")).alias("file"), F.regexp_replace("content", r"\n$", "").alias("content"))
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(base)
    uri = fs.makeQualified(base).toUri()
    if uri.getScheme() != "file":
        names = _renamed(rows, fs, path)
        return sorted(names) if listed else []
    written = rows.mapInArrow(_writer(uri.getPath()), "file string")
    if listed:
        return sorted(r.file for r in written.collect())
    written.write.format("noop").mode("overwrite").save()
    return []


def _writer(at: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = f"{at}/_staging-{uuid.uuid4().hex}"  # of a task that fails, no part of a file stays under its name
                with open(own, "wb") as out:
                    if content.is_valid:
                        out.write(content.as_buffer())
                    out.write(b"\n")
                os.replace(own, f"{at}/{name}")
                with contextlib.suppress(FileNotFoundError):  # the sum that Hadoop keeps of the file before
                    os.remove(f"{at}/.{name}.crc")
            yield pa.record_batch([batch.column(0)], names=["file"])

    return run


def _renamed(rows: DataFrame, fs, path: str) -> list[str]:
    jvm = rows.sparkSession.sparkContext._jvm
    place = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join(parts))
    staging = f"{path.rstrip('/')}/_staging-{uuid.uuid4().hex}"
    rows.select("file", F.col("content").alias("value")).write.partitionBy("file").text(staging)

    def give(folder) -> str:
        name = unquote(folder.getPath().getName().removeprefix("file="))
        for part in fs.listStatus(folder.getPath()):
            fs.delete(place(path, name), False)
            fs.rename(part.getPath(), place(path, name))
        return name

    with ThreadPoolExecutor(_THREADS) as pool:
        names = list(pool.map(give, [f for f in fs.listStatus(place(staging)) if f.isDirectory()]))
    fs.delete(place(staging), True)
    return names
