"""Folds whose state depends on earlier decisions, as aggregates over ordered arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import blank

CHUNK = "struct<text:string,actor:string,role:string,references:map<string,struct<text:string,actor:string,role:string>>>"


def map_chunks(chunks: Column | str, f: Callable[[Column], Column]) -> Column:
    """Each chunk mapped; null results are dropped. A block stays even without chunks."""
    c = F.col(chunks) if isinstance(chunks, str) else chunks
    return F.filter(F.transform(c, f), lambda x: x.isNotNull())


def base_record(block: Column) -> Column:
    """A block without its chunks: image and source."""
    return F.struct(block["image"].alias("image"), block["source"].alias("source"))


def single(chunks: Column | str) -> Column:
    """The only chunk, null if none, an error if several."""
    c = F.col(chunks) if isinstance(chunks, str) else chunks
    at = F.when(F.size(c) > 1, F.raise_error(F.lit("more than one chunk")).cast("int")).otherwise(F.lit(0))
    return F.get(c, at)


def references_only(chunk: Column) -> Column:
    """References, but no text: an empty text is a text."""
    return (F.coalesce(F.size(chunk["references"]), F.lit(0)) > 0) & chunk["text"].isNull()


def merge_reference_chunks(chunks: Column | str) -> Column:
    """A chunk of references only goes into the next chunk if that has none; else both stay."""
    c = (F.col(chunks) if isinstance(chunks, str) else chunks).cast(f"array<{CHUNK}>")
    zero = F.struct(F.array().cast(f"array<{CHUNK}>").alias("out"), F.lit(None).cast(CHUNK).alias("held"))

    def step(state: Column, x: Column) -> Column:
        held, out = state["held"], state["out"]
        flushed = F.when(held.isNotNull(), F.concat(out, F.array(held))).otherwise(out)
        takes = held.isNotNull() & ~references_only(x) & (F.coalesce(F.size(x["references"]), F.lit(0)) <= 0)
        joined = F.concat(out, F.array(x.withField("references", held["references"])))
        return F.struct(
            F.when(references_only(x), flushed).when(takes, joined).otherwise(F.concat(flushed, F.array(x))).alias("out"),
            F.when(references_only(x), x).otherwise(F.lit(None).cast(CHUNK)).alias("held"),
        )

    return F.aggregate(c, zero, step, lambda s: F.when(s["held"].isNotNull(), F.concat(s["out"], F.array(s["held"]))).otherwise(s["out"]))


def confident_text(text: Column | str, spans: Column | str, threshold: float = 0.8) -> Column:
    """The text with weak spans (text, confidence) cut out, if the first span is weak. Spans are found one
    after the other; what lies between them stays, a weak one leaves a space, what follows the last one
    goes, and the result is trimmed. Null if no span is strong; an error if a span isn't in the text."""
    t, s = (F.col(x) if isinstance(x, str) else x for x in (text, spans))
    zero = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"), F.lit(False).alias("strong"))

    def step(state: Column, span: Column) -> Column:
        found = F.call_function("locate", span["text"], t, state["at"])
        found = F.when(found == 0, F.raise_error(F.concat(F.lit("span not in text: "), span["text"])).cast("int")).otherwise(found)
        gap = F.substring(t, state["at"], found - state["at"])
        strong = span["confidence"] >= threshold
        return F.struct((found + F.length(span["text"])).alias("at"), F.concat(state["out"], gap, F.when(strong, span["text"]).otherwise(F.lit(" "))).alias("out"), (state["strong"] | strong).alias("strong"))

    cleaned = F.aggregate(s, zero, step, lambda x: F.when(x["strong"], F.trim(x["out"])))
    return F.when(F.get(s, F.lit(0))["confidence"] < threshold, cleaned).otherwise(t)


def japanese_chunks(chunks: Column | str, role: str | None = None) -> Column:
    """Chunks that are Japanese, blank, or of another role than the one to be filtered."""
    from lectern.functions.text import is_japanese_text

    c = F.col(chunks) if isinstance(chunks, str) else chunks
    other = (lambda x: F.coalesce(x["role"], F.lit("primary")) != role) if role else (lambda _: F.lit(False))
    return F.filter(c, lambda x: other(x) | blank(x["text"]) | is_japanese_text(x["text"]))


def leader_clusters(images: DataFrame, file: str, pos: str, name: str, signature: str, threshold: float = 0.9) -> DataFrame:
    """Sequential leader clustering of image signatures in each file.

    An image at least ``threshold`` alike the leader joins its group and the leader stays; else the leader
    is noted as candidate and the image leads from now on. The first image only leads. Rows without a
    signature pass and change nothing. The fold holds one array of (pos, name, signature) for each file.
    """
    item = F.struct(F.col(pos).cast("bigint").alias("pos"), F.col(name).cast("string").alias("name"), F.col(signature).cast("bigint").alias("sig"))
    rows = images.groupBy(file).agg(F.array_sort(F.collect_list(item)).alias("__rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = [], []
            for n, items in enumerate(batch.column(1).to_pylist()):
                leader = None
                for x in items:
                    grp = candidate = sim = None
                    if x["name"] is not None and x["sig"] is not None:
                        mine = (x["name"], x["sig"] & (1 << 64) - 1)
                        if leader is None:
                            leader = mine
                        else:
                            sim = 1 - (leader[1] ^ mine[1]).bit_count() / 64
                            if sim >= threshold:
                                grp = leader[0]
                            else:
                                candidate, leader = leader[0], mine
                    keys.append(n)
                    out.append((x["pos"], x["name"], grp, candidate, sim))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64()]
            yield pa.record_batch([batch.column(0).take(pa.array(keys, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=[file, "pos", "name", "grp", "candidate", "similarity"])

    kind = dict(images.dtypes)[file]
    return rows.mapInArrow(run, f"`{file}` {kind}, pos bigint, name string, grp string, candidate string, similarity double")
