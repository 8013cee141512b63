"""Command line: python -m lectern.cli <command> ..."""

from __future__ import annotations

import argparse
import json
import os
import sys

from lectern.catalog import LIBRARY, VOLUME, Catalog, CatalogError, config_get, config_set, load_config


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("lectern")
    p.add_argument("--json-output", action="store_true")
    top = p.add_subparsers(dest="group", required=True)
    lib = top.add_parser("library").add_subparsers(dest="action", required=True)
    for name in ("init", "info"):
        a = lib.add_parser(name)
        a.add_argument("path", nargs="?", default=os.environ.get("LECTERN_LIBRARY", "."))
        a.add_argument("--force", action="store_true")
    vol = top.add_parser("volume").add_subparsers(dest="action", required=True)
    for name in ("init", "new", "info", "set", "rename", "list"):
        a = vol.add_parser(name)
        a.add_argument("path")
        a.add_argument("args", nargs="*")
        a.add_argument("--moniker")
        a.add_argument("--tags", default="")
        a.add_argument("--all", action="store_true", help="list all volumes of the library that the path is in")
        a.add_argument("--force", action="store_true")
    src = top.add_parser("source").add_subparsers(dest="action", required=True).add_parser("import")
    src.add_argument("volume")
    src.add_argument("patterns", nargs="+")
    con = top.add_parser("content").add_subparsers(dest="action", required=True)
    a = con.add_parser("index")
    a.add_argument("input")
    a.add_argument("--index-path", required=True)
    a = con.add_parser("search")
    a.add_argument("terms", nargs="+")
    a.add_argument("--index-path", required=True)
    a.add_argument("--max-hits", type=int, default=100)
    a = con.add_parser("merge")
    a.add_argument("input")
    a.add_argument("reference")
    a.add_argument("output")
    a.add_argument("--align", choices=["timecodes"], required=True)
    a.add_argument("--ref", required=True)
    a = con.add_parser("link")
    a.add_argument("input")
    a.add_argument("output")
    a.add_argument("--index-path", required=True)
    a.add_argument("--link-name", required=True)
    a = con.add_parser("transform")
    a.add_argument("name", choices=["remove-non-japanese-text", "remove-low-confidence-text", "merge-ref-chunks", "import-media", "import-image-text", "group-similar-images"])
    a.add_argument("--media-path", help="folder of the media list and its files")
    a.add_argument("--image-prefix", default="")
    a.add_argument("--audio-prefix", default="")
    a.add_argument("--provider", default="acv4", help="whose results of recognition the images have")
    a.add_argument("--images", help="folder of the images or of their recognition results, or a table of their signatures")
    a.add_argument("--similarity-threshold", type=float, default=0.9)
    a.add_argument("input")
    a.add_argument("output")
    a.add_argument("--role")
    a.add_argument("--threshold", type=float, default=0.8)
    subs = top.add_parser("subtitles").add_subparsers(dest="action", required=True)
    for name in ("generate-content", "generate", "ttml-to-webvtt"):
        a = subs.add_parser(name)
        a.add_argument("input")
        a.add_argument("output")
        if name == "generate":
            a.add_argument("--purpose", choices=["default", "media-extraction"], default="default")
            a.add_argument("--include-ref")
            a.add_argument("--extend-audio", type=int, default=0, help="milliseconds")
    a = top.add_parser("markdown").add_subparsers(dest="action", required=True).add_parser("export")
    a.add_argument("input")
    a.add_argument("output")
    a.add_argument("--combine", action="store_true")
    a.add_argument("--no-block-headings", action="store_true")
    a.add_argument("--option", action="append", default=[], help="key=value for the template")
    a.add_argument("--ruby", choices=["none", "html", "blur-html", "remove"], default="none")
    a.add_argument("--ref-behavior", choices=["none", "footnotes", "blur-html"], default="none")
    a.add_argument("--ref-labels", choices=["default", "all", "none"], default="default")
    a.add_argument("--quirks", choices=["none", "ky-book3"], default="none")
    a.add_argument("--template", help="a Python file that defines template(file, rows, options) -> text")
    a.add_argument("--block-limit", type=int, default=10_000)
    st = top.add_parser("stats").add_subparsers(dest="action", required=True)
    for name in ("content", "aggregates", "analytics"):
        a = st.add_parser(name)
        a.add_argument("input")
        a.add_argument("output", help="folder of JSON lines")
    conf = top.add_parser("config").add_subparsers(dest="action", required=True)
    for name in ("get", "set"):
        a = conf.add_parser(name)
        a.add_argument("path", help="the file of settings")
        a.add_argument("key", nargs="?" if name == "get" else None)
        if name == "set":
            a.add_argument("value")
    return p


def _option(text: str) -> tuple[str, object]:
    """key=value, the value as a boolean, a whole number, a number or a text."""
    key, equals, value = text.partition("=")
    if not equals:
        raise ValueError(f"{text!r} is not key=value")
    if value.lower() in ("true", "false"):
        return key, value.lower() == "true"
    for kind in (int, float):
        try:
            return key, kind(value)
        except ValueError:
            continue
    return key, value


def _configure(o: argparse.Namespace) -> object:
    from pathlib import Path

    from lectern.sources.blocks import to_yaml

    found = load_config(o.path)
    if o.action == "get":
        return config_get(found, o.key) if o.key else found
    Path(o.path).parent.mkdir(parents=True, exist_ok=True)
    Path(o.path).write_text(to_yaml([config_set(found, o.key, _option(f"_={o.value}")[1])]))
    return None


def _markdown(o: argparse.Namespace, content) -> object:
    import runpy

    from lectern.plans import media
    from lectern.sources import blocks, markdown

    options = dict(_option(x) for x in o.option)
    style = markdown.Style(
        headings=not o.no_block_headings, ruby=o.ruby.replace("-", "_"), references={"none": "quote", "footnotes": "footnotes", "blur-html": "blur"}[o.ref_behavior],
        labels={"default": "several", "all": "all", "none": "none"}[o.ref_labels], tight_breaks=o.quirks == "ky-book3",
    )
    rows = media.markdown_rows(content)
    if o.template:
        template = runpy.run_path(o.template)["template"]
        limited = markdown.render(markdown.sequence.capped(rows, ["file"], ["pos"], o.block_limit), style)
        files = markdown.templated(limited, lambda file, rows: template(file, rows, options))
    else:
        files = markdown.markdown_files(rows, style, o.block_limit)
    if o.combine:
        folder, name = os.path.split(o.output)
        return blocks.write_files(markdown.combined_file(files, name), folder, listed=True)
    from pyspark.sql import functions as F

    return blocks.write_files(files.select(F.concat("file", F.lit(".md")).alias("file"), "content"), o.output, listed=True)


def run(argv: list[str]) -> object:
    o = _parser().parse_args(argv)
    tags = lambda: [t for t in o.tags.split(",") if t]
    if o.group == "library":
        return Catalog().init_library(o.path, o.force) if o.action == "init" else Catalog().info(o.path, LIBRARY)
    if o.group == "config":
        return _configure(o)
    if o.group == "source":
        return Catalog().import_sources(o.volume, o.patterns)
    from lectern.session import local_session

    if o.group == "volume":
        c = Catalog()
        if o.action == "init":
            return c.init_volume(o.path, o.args[0] if o.args else None, o.moniker, tags(), o.force)
        if o.action == "new":
            return c.new_volume(o.path, " ".join(o.args), o.moniker, tags(), o.force)
        if o.action == "info":
            return c.info(o.path, VOLUME)
        if o.action == "set":
            return c.set(o.path, *o.args)
        if o.action == "rename":
            return c.rename(o.path, " ".join(o.args) or None)
        base = Catalog.enclosing(o.path, LIBRARY) if o.all else o.path
        return [r.asDict() for r in Catalog(local_session()).volumes(base).collect()]
    from pyspark.sql import functions as F

    from lectern.operators.search import Index
    from lectern.functions import bits
    from lectern.plans import media
    from lectern.sources import blocks, captions, images, recognition, tabular

    spark = local_session()
    if o.group == "subtitles" and o.action == "ttml-to-webvtt":
        raw = spark.read.option("pathGlobFilter", "*.{ttml,dfxp,xml}").text(o.input, wholetext=True)
        return blocks.write_files(captions.webvtt_files(raw.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("content"))), o.output, listed=True)
    if o.group == "subtitles" and o.action == "generate":
        cues = media.subtitle_cues(blocks.read_content(spark, o.input), o.include_ref, o.extend_audio, o.purpose == "media-extraction")
        return blocks.write_files(captions.caption_files(cues), o.output, listed=True)
    if o.group == "subtitles":
        cues = captions.read_captions(spark, o.input)
        chunk = F.array(F.struct(F.col("markdown").alias("text")))
        source = F.struct("ordinal", blocks.timecodes("start_us", "end_us").alias("timecodes"))
        rows = cues.select(F.concat(F.regexp_replace("file", r"\.[^.]*$", ""), F.lit(".content.yaml")).alias("file"), F.col("ordinal").alias("pos"), F.struct(source.alias("source"), chunk.alias("chunks")).alias("block"))
        blocks.write_files(blocks.yaml_files(rows), o.output)
        return o.output
    if o.action == "search":
        found = media.search_content(Index.load(spark, o.index_path), " ".join(o.terms), o.max_hits)
        return [json.loads(x) for x in found.toJSON().collect()]
    content = blocks.read_content(spark, o.input)
    if o.action == "index":
        media.index_content(content).save(o.index_path)
        return o.index_path
    if o.group == "markdown":
        return _markdown(o, content)
    if o.group == "stats":
        made = {"content": media.content_statistics, "aggregates": media.corpus_aggregates, "analytics": media.corpus_analytics}[o.action]
        made(content).write.mode("overwrite").json(o.output)
        return o.output
    if o.action == "link":
        linked, totals = media.linked_blocks(content, Index.load(spark, o.index_path), o.link_name)
        blocks.write_files(blocks.yaml_files(linked), o.output)
        return totals.first().asDict()
    if o.action == "merge":
        m = media.merge_streams(content, blocks.read_content(spark, o.reference), o.ref)
        source = F.when(F.col("start_us").isNotNull(), F.struct(blocks.timecodes("start_us", "end_us").alias("timecodes")))
        refs = F.when(F.col("ref_text").isNotNull(), F.create_map(F.lit(o.ref), F.struct(F.col("ref_text").alias("text"))))
        block_refs = F.when(F.col("ref_start_us").isNotNull(), F.create_map(F.lit(o.ref), F.struct(F.struct(F.col("ref_ordinal").alias("ordinal"), blocks.timecodes("ref_start_us", "ref_end_us").alias("timecodes")).alias("source"))))
        order = F.struct(*[F.coalesce(c, F.lit(-1)).alias(c) for c in ("sort_s", "sort_e", "sort_ord")], F.col("in_pos").isNull().alias("lone"), F.coalesce("in_pos", "lone_pos").alias("p"))
        rows = m.select("file", order.alias("pos"), F.struct("block.id", "block.image", "block.audio", source.alias("source"), block_refs.alias("references"), F.array(F.struct(F.nullif("text", F.lit("")).alias("text"), refs.alias("references"))).alias("chunks")).alias("block"))
    elif o.name == "import-media":
        names = tabular.listing(spark, o.media_path).where(~F.col("name").rlike(r"\.tsv$")).select(F.col("name").alias("path"))
        rows = media.import_media(content, tabular.read_media(spark, f"{o.media_path}/*.tsv"), names, o.image_prefix, o.audio_prefix)
    elif o.name == "import-image-text":
        rows = media.import_image_text(content, recognition.recognised_chunks(recognition.read_recognised(spark, o.images, o.provider)), o.role)
    elif o.name == "group-similar-images":
        # Either a table (name, 16 hexadecimal digits), or the images themselves.
        table = o.images.endswith((".csv", ".tsv"))
        found = spark.read.csv(o.images, header=True, schema="name string, signature string").select("name", bits.from_hex("signature").alias("signature")) if table else images.read_signatures(spark, o.images)
        rows = media.group_images(content, found, o.similarity_threshold)
    else:
        options = {"role": o.role} if o.name == "remove-non-japanese-text" else {"threshold": o.threshold} if o.name == "remove-low-confidence-text" else {}
        rows = media.transform_content(content, o.name, **options)
    blocks.write_files(blocks.yaml_files(rows), o.output)
    return o.output


def main() -> int:
    try:
        out = run(sys.argv[1:])
    except (CatalogError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    if out is not None:
        print(json.dumps(out, indent=2, ensure_ascii=False) if "--json-output" in sys.argv or not isinstance(out, str) else out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
