"""Pipelines over content streams: merge, transforms, index, link, export."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import folds, intervals, lookup, search, stats
from lectern.sources import blocks as B
from lectern.sources import markdown


def flat_blocks(content: DataFrame) -> DataFrame:
    """Blocks as rows of a timed stream, with the block beside."""
    start, end = B.block_times("block")
    return content.select("file", "pos", F.col("block.source.ordinal").alias("ordinal"), start.alias("start_us"), end.alias("end_us"), F.array_join(F.transform("block.chunks", lambda c: F.coalesce(c["text"], F.lit(""))), "\n\n").alias("text"), "block")


def merge_streams(content: DataFrame, refs: DataFrame, ref_name: str, bucket_us: int | None = None, aligner: Callable[..., DataFrame] = intervals.align) -> DataFrame:
    """(file, pos, start_us, end_us, text, ref_name, ref_text, ref_start_us, ref_end_us): two streams of the
    same files aligned by their times. Files that only the references have are left out; a file without
    references is an error. Both streams' blocks have one chunk at most. ``aligner`` takes the two streams and
    gives what ``intervals.align`` does: rows (file, in_pos, ref_pos, g_s, g_e, g_ord)."""
    a, b = flat_blocks(content), flat_blocks(refs)
    for side, what in ((a, "input"), (b, "reference")):
        pass_ = F.when(F.size("block.chunks") > 1, F.raise_error(F.lit(f"several chunks in a block of the {what}")).cast("boolean")).otherwise(F.lit(True))
        if what == "input":
            a = side.where(pass_)
        else:
            b = side.where(pass_)
    files = a.select("file").distinct()
    missing = files.join(b.select("file").distinct().withColumn("__in", F.lit(True)), "file", "left")
    checked = missing.withColumn("__in", F.when(F.col("__in").isNull(), F.raise_error(F.concat(F.lit("no reference file "), F.col("file"))).cast("boolean")).otherwise(True)).where("__in").select("file")
    b = b.join(checked, "file", "left_semi")
    merged = intervals.merged_refs(aligner(a, b, bucket_us=bucket_us), b)
    own = a.select("file", F.col("pos").alias("in_pos"), "text", "block", F.lit(True).alias("__own"))
    out = merged.join(own, ["file", "in_pos"], "left")
    return out.select(
        "file", "in_pos", "lone_pos", F.when(F.col("__own"), F.col("g_s")).alias("start_us"), F.when(F.col("__own"), F.col("g_e")).alias("end_us"), F.col("g_s").alias("sort_s"), F.col("g_e").alias("sort_e"), F.col("g_ord").alias("sort_ord"), "text", "block",
        F.lit(ref_name).alias("ref_name"), F.nullif("ref_text", F.lit("")).alias("ref_text"), F.col("ref_start").alias("ref_start_us"), F.col("ref_end").alias("ref_end_us"), "ref_ordinal",
    )


def transform_content(content: DataFrame, name: str, **options) -> DataFrame:
    """A named transform of blocks: remove-non-japanese-text (role), remove-low-confidence-text (threshold)
    or merge-ref-chunks."""
    b = F.col("block")
    if name == "remove-non-japanese-text":
        chunks = folds.japanese_chunks(b["chunks"], options.get("role"))
    elif name == "remove-low-confidence-text":
        t = options.get("threshold", 0.8)

        def confident(c):
            spans = c["image"]["textSpans"]
            cleaned = folds.confident_text(c["text"], spans, t)
            return F.when(spans.isNull() | (F.size(spans) == 0), c).when(cleaned.isNotNull(), c.withField("text", cleaned))

        chunks = folds.map_chunks(b["chunks"], confident)
    elif name == "merge-ref-chunks":
        chunks = folds.merge_reference_chunks(F.transform(b["chunks"], lambda c: F.struct(c["text"].alias("text"), c["actor"].alias("actor"), c["role"].alias("role"), F.transform_values(c["references"], lambda _, v: F.struct(v["text"].alias("text"), v["actor"].alias("actor"), v["role"].alias("role"))).alias("references"))))
    else:
        raise ValueError(f"unknown transform {name}")
    return content.withColumn("block", b.withField("chunks", chunks))


def markdown_rows(content: DataFrame) -> DataFrame:
    """Blocks as ``markdown.render`` takes them."""
    b, start = F.col("block"), B.block_times("block")[0]
    timed = F.filter(F.array_sort(F.map_entries(b["references"])), lambda e: e["value"]["source"]["timecodes"]["start"].isNotNull())
    first = F.get(timed, F.lit(0))["value"]
    chunk = lambda c: F.struct(c["text"].alias("text"), F.map_filter(F.transform_values(c["references"], lambda _, v: v["text"]), lambda _, v: v.isNotNull()).alias("references"))
    return content.select(
        T.base_name("file").alias("file"), "pos", b["source"]["note"].alias("note"), b["source"]["resource"].alias("resource"), start.alias("start_us"), F.col("pos").alias("__pos"), first.alias("__first"), b["image"]["name"].alias("image"), b["image"]["group"]["name"].alias("image_group"),
        b["audio"]["name"].alias("audio"), F.transform(b["chunks"], chunk).alias("chunks"),
    ).withColumn("ref_start_us", B.block_times("__first")[0]).drop("__pos", "__first")


def subtitle_cues(content: DataFrame, include_ref: str | None = None, extend_ms: int = 0, extraction: bool = False) -> DataFrame:
    """Cues (file, cue_start, cue_end, cue_text) of blocks. With ``extraction`` a cue's text is its media key,
    base|ordinal or base|reference|ordinal, else it is the plain text of the chunks."""
    b, base = F.col("block"), T.base_name("file")
    start, end = B.block_times("block")
    joined = lambda texts: T.combined(texts, "  \n")
    rows = content.select("file", "pos", start.alias("start_us"), end.alias("end_us"), joined(F.transform(b["chunks"], lambda c: c["text"])).alias("text"), b["source"]["ordinal"].alias("own"), b["chunks"].alias("chunks"), F.try_element_at(b["references"], F.lit(include_ref or "")).alias("ref"))
    ref_start, ref_end = B.block_times("ref")
    rows = rows.withColumns({"ref_start_us": ref_start, "ref_end_us": ref_end, "ref_text": joined(F.transform("chunks", lambda c: F.try_element_at(c["references"], F.lit(include_ref or ""))["text"])), "base": base})
    if extraction:
        key = lambda *parts: F.concat_ws("|", "base", *parts)
        rows = rows.withColumns({"text": F.when(F.trim("text") != "", key(F.col("own").cast("string"))), "ref_text": F.when(F.trim("ref_text") != "", key(F.lit(include_ref), F.col("ref.source.ordinal").cast("string")))})
    cues = intervals.cues_of_blocks(rows, include_ref=include_ref is not None, extend_us=extend_ms * 1000)
    text = F.col("cue_text") if extraction else F.regexp_replace(markdown.markdown_to_plain("cue_text"), r"\n$", "")
    return cues.select(F.concat("base", F.lit(".srt")).alias("file"), "cue_start", "cue_end", text.alias("cue_text"))


def content_tokens(content: DataFrame, tokens=search.cjk_tokens) -> DataFrame:
    """(file, pos, term): the tokens of all chunks."""
    chunks = content.select(T.base_name("file").alias("file"), "pos", F.explode("block.chunks").alias("chunk"))
    return chunks.select("file", "pos", F.explode(tokens(F.col("chunk.text"))).alias("term"))


def content_statistics(content: DataFrame, tokens=search.cjk_tokens) -> DataFrame:
    """For each file its tokens, those of timed blocks, their duration and the time for a token."""
    start, end = B.block_times("block")
    times = content.select(T.base_name("file").alias("file"), "pos", start.alias("start_us"), end.alias("end_us"))
    counts = content_tokens(content, tokens).groupBy("file", "pos").agg(F.count("*").alias("n_tokens"))
    return stats.timed_statistics(times.join(counts, ["file", "pos"]), "file")


def corpus_aggregates(content: DataFrame, tokens=search.cjk_tokens) -> DataFrame:
    """Each term's count and the files that have it."""
    return stats.document_frequency(stats.term_frequency(content_tokens(content, tokens), ["term"], ["file"]), doc="file")


def corpus_analytics(content: DataFrame, tokens=search.cjk_tokens) -> DataFrame:
    """How common each file's terms are in all files."""
    counts = stats.term_frequency(content_tokens(content, tokens), ["term"], ["file"])
    n = content.select("file").distinct().count()
    return stats.utility(counts, stats.document_frequency(counts, doc="file"), F.lit(n), doc="file")


def linked_blocks(content: DataFrame, index: search.Index, name: str, tokens=search.cjk_tokens) -> tuple[DataFrame, DataFrame]:
    """Blocks whose chunks have the text of their best hit as reference ``name``, and the totals of ``link_content``."""
    links, totals = link_content(content, index, name, tokens)
    each = links.groupBy("file", "pos").agg(F.map_from_entries(F.collect_list(F.when(F.col("references").isNotNull(), F.struct("chunk_no", F.try_element_at("references", F.lit(name)))))).alias("__found"))
    met = content.join(each, ["file", "pos"], "left")
    kind = dict(content.select(F.get("block.chunks", F.lit(0))["references"].alias("r")).dtypes)["r"]
    added = lambda i: F.from_json(F.to_json(F.create_map(F.lit(name), F.struct(F.try_element_at("__found", i).alias("text")))), kind)
    none = F.from_json(F.lit("{}"), kind)
    chunk = lambda c, i: F.when(F.try_element_at("__found", i).isNotNull(), c.withField("references", F.map_concat(F.map_filter(F.coalesce(c["references"], none), lambda k, _: k != name), added(i)))).otherwise(c)
    return met.withColumn("block", F.col("block").withField("chunks", F.transform("block.chunks", chunk))).drop("__found"), totals


def import_media(content: DataFrame, media: DataFrame, files: DataFrame, image_prefix: str = "", audio_prefix: str = "") -> DataFrame:
    """Images and audio by the block's ordinal, else by its first reference's; names get a prefix."""
    rows = content.withColumn("base", T.base_name("file"))
    refs = F.array_sort(F.map_entries("block.references"))
    first = F.get(F.filter(refs, lambda e: e["value"]["source"]["ordinal"].isNotNull()), F.lit(0))
    own = F.col("block.source.ordinal")
    rows = rows.withColumns({"ref": F.when(own.isNull(), first["key"]), "ordinal": F.coalesce(own, first["value"]["source"]["ordinal"])})
    met = lookup.import_media(rows, media, files).withColumns({"image": F.concat(F.lit(image_prefix), "image"), "audio": F.concat(F.lit(audio_prefix), "audio")})
    block = F.col("block").withField("image", F.when(F.col("image").isNotNull(), F.struct(F.col("image").alias("name"), F.col("block.image.group").alias("group"), F.col("block.image.groupCandidate").alias("groupCandidate"))).otherwise(F.col("block.image")))
    block = block.withField("audio", F.when(F.col("audio").isNotNull(), F.struct(F.col("audio").alias("name"))).otherwise(F.col("block.audio")))
    return met.select("file", "pos", block.alias("block"))


def import_image_text(content: DataFrame, chunks: DataFrame, role: str | None = None) -> DataFrame:
    """Recognised chunks (file, chunks) appended to the blocks whose image has that base name."""
    found = chunks.select(F.col("file").alias("__base"), F.col("chunks").alias("__chunks"))
    met = content.join(found, T.without_extensions("block.image.name") == F.col("__base"), "left")
    refs = dict(content.select(F.get("block.chunks", F.lit(0))["references"].alias("r")).dtypes)["r"]
    more = F.transform("__chunks", lambda c: F.struct(c["text"].alias("text"), F.lit(None).cast("string").alias("actor"), (F.lit(role).cast("string") if role else c["role"]).alias("role"), c["image"].alias("image"), F.lit(None).cast(refs).alias("references")))
    none = F.slice("block.chunks", 1, 0)
    joined = F.when(F.col("__chunks").isNotNull(), F.concat(F.coalesce("block.chunks", none), more)).otherwise(F.col("block.chunks"))
    return met.withColumn("block", F.col("block").withField("chunks", joined)).drop("__base", "__chunks")


def group_images(content: DataFrame, signatures: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Blocks with the leader clusters of their images; ``signatures`` has (name, signature)."""
    rows = content.select("file", "pos", F.col("block.image.name").alias("name")).join(signatures, "name", "left")
    c = folds.leader_clusters(rows, "file", "pos", "name", "signature", threshold).select("file", "pos", "grp", "candidate", "similarity")
    met = content.join(c, ["file", "pos"], "left")
    part = lambda n: F.when(F.col(n).isNotNull(), F.struct(F.col(n).alias("name"), F.col("similarity")))
    image = F.when(F.col("block.image").isNotNull(), F.struct(F.col("block.image.name").alias("name"), part("grp").alias("group"), part("candidate").alias("groupCandidate")))
    return met.withColumn("block", F.col("block").withField("image", image)).drop("grp", "candidate", "similarity")


def index_content(content: DataFrame, tokens=search.cjk_tokens) -> search.Index:
    """An index with a document for each chunk that has text; the block is stored with it."""
    chunks = content.select("file", "pos", "block", F.posexplode("block.chunks").alias("chunk_no", "chunk"))
    rows = chunks.select(F.concat_ws("#", "file", F.col("pos").cast("string"), F.col("chunk_no").cast("string")).alias("doc"), "file", F.col("chunk.text").alias("text"), "block")
    return search.build(rows, "doc", "text", ["file", "block"], tokens)


def search_content(index: search.Index, query: str | DataFrame, limit: int = 100, query_col: str = "q", text_col: str = "text", tokens=search.cjk_tokens) -> DataFrame:
    """Blocks with the phrase, else with any of its tokens, best first; a row for each matching chunk. ``query`` is a text, or a table of many, whose
    ids (``query_col``) then lead the rows."""
    one = isinstance(query, str)
    q = index.docs.sparkSession.createDataFrame([(0, query)], "q int, text string") if one else query
    hits = search.search(index, q, query_col, text_col, limit, tokens)
    out = hits.join(index.docs, "doc").select(F.col("query").alias(query_col), "rank", "score", "phrase", "file", "block")
    return out.drop(query_col).orderBy("rank") if one else out


def link_content(content: DataFrame, index: search.Index, name: str, tokens=search.cjk_tokens) -> tuple[DataFrame, DataFrame]:
    """Chunks with the text of their best hit's block as reference ``name``, and (linked, total) chunks."""
    chunks = content.select("file", "pos", F.posexplode("block.chunks").alias("chunk_no", "chunk")).select(F.concat_ws("#", "file", F.col("pos").cast("string"), F.col("chunk_no").cast("string")).alias("id"), "file", "pos", "chunk_no", F.col("chunk.text").alias("text"))
    hit = search.link(index, chunks, "id", "text", ["block"], tokens)
    joined = T.combined(F.transform("linked_block.chunks", lambda c: c["text"]))
    out = hit.select("file", "pos", "chunk_no", "text", F.when(F.col("linked_block").isNotNull(), F.create_map(F.lit(name), joined)).alias("references"))
    return out, out.agg(F.count_if(F.col("references").isNotNull()).alias("linked_chunks"), F.count("*").alias("total_chunks"))
