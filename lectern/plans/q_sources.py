"""Queries that write the driver's tables as files of each format and read them again."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import bits, tables
from lectern.functions import text as T
from lectern.operators import folds, graph, intervals, lookup, reshape, resolve, search, sequence, stats, upsert
from lectern.operators._store import shared_folder, stored
from lectern.plans import films, media
from lectern.plans.q_text import _LEADERS, _SCORES
from lectern.plans.tables import EVENTS_SQL, read, timed_events
from lectern.sources import blocks, captions, markdown, recognition, tabular, templates
from lectern.streaming import incremental


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _lines(rows, file, line, order):
    """(file, content): each file's lines in order."""
    one = rows.groupBy(F.col(file).alias("file")).agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("__line")))).alias("l"))
    return one.select("file", F.array_join(F.transform("l", lambda x: x["__line"]), "\n").alias("content"))


def title_tables(spark, d):
    """Compressed title tables, extracted once, then read column by column and typed."""
    p, at = read(spark, d, "part"), _folder(spark)
    columns = [F.concat(F.lit("tt"), F.col("p_partkey").cast("string")), F.col("p_type"), F.col("p_name"), F.when(F.col("p_partkey") % 3 == 0, r"\N").otherwise("original"), (F.col("p_partkey") % 2).cast("string"), (F.col("p_size") + 1900).cast("string"), F.lit(r"\N"), F.lit("90"), F.concat("p_type", F.lit(","), "p_brand")]
    p.select(F.concat_ws("\t", *columns).alias("value")).unionByName(spark.sql("SELECT 'short' AS value")).write.option("compression", "gzip").text(f"{at}/packed")
    for _ in range(2):  # the second run finds what the first has left
        tabular.extracted(spark, f"{at}/packed", f"{at}/basics.tsv")
    header = tabular.TITLE_TABLES["basics"].replace(" string", "").replace(", ", "\t")
    spark.read.text(f"{at}/basics.tsv").unionByName(spark.createDataFrame([(header,)], "value string")).orderBy(F.col("value") != header).coalesce(1).write.text(f"{at}/one.tsv")
    t = tabular.typed_basics(tabular.read_titles(spark, f"{at}/one.tsv", "basics"))
    return t.select("tconst", "primaryTitle", "originalTitle", "isAdult", F.col("startYear").cast("long").alias("startYear"), "endYear", F.array_join("genres", "|").alias("genres"))


def list_exports(spark, d):
    """Exports with headers, of several lists, each row with its list's name; ids in order."""
    c, at = read(spark, d, "customer"), _folder(spark)
    rows = c.select(F.col("c_mktsegment").alias("list"), F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("c_custkey")).alias("Position"), F.concat(F.lit("tt"), F.col("c_custkey").cast("string")).alias("Const"), F.concat(F.col("c_name"), F.lit(', "x"')).alias("Title"))
    rows.repartition("list").write.partitionBy("list").csv(at, header=True)
    lists = [f"{at}/list={r[0]}" for r in c.select("c_mktsegment").distinct().collect()]
    found = tabular.read_lists(spark, [*lists, *lists])
    return found.select(F.col("list").isNotNull().alias("named"), F.col("Position").cast("long").alias("position"), F.col("Const").alias("const"), F.col("Title").alias("title"))


def delimited_import(spark, d):
    """Delimited files with lines to skip, columns put into records by a mapping."""
    n, at = read(spark, d, "nation"), _folder(spark)
    body = _lines(n, "n_regionkey", F.concat_ws("|", "n_name", F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 2 == 0, "").otherwise("odd")), ["n_nationkey"])
    blocks.write_files(body.select(F.concat(F.col("file").cast("string"), F.lit(".txt")).alias("file"), F.concat(F.lit("# made\nname|key|note\n"), F.col("content")).alias("content")), at)
    rows = tabular.read_delimited(spark, at, ["name", "key", "note", "missing"], sep="|", skip=2)
    spec = [{"target": "note", "order": 2, "value": "note"}, {"target": "title", "order": 1, "value": F.initcap(F.lower("name"))}, {"target": "gone", "order": 3, "value": "missing"}]
    return tabular.mapped(rows, spec).select(F.regexp_replace("file", r"\.txt$", "").alias("region"), F.col("pos").cast("long").alias("pos"), "key", F.to_json("block").alias("block"))


def yaml_stream(spark, d):
    """All documents' texts as streams of YAML, written by all tasks and read again in ranges."""
    at = _folder(spark)
    blocks.write_stream(read(spark, d, "documents").select(F.struct("doc_id", "text", F.struct("lang", "source").alias("origin")).alias("block")), at)
    rows = blocks.read_yaml(spark, at, "doc_id bigint, text string, origin struct<lang:string,source:string>", "*.txt")
    return rows.select("doc.doc_id", "doc.origin.lang", "doc.origin.source", F.length("doc.text").cast("long").alias("n_chars"), F.md5("doc.text").alias("md5"))


def delimited_stream(spark, d):
    """All orders as delimited files below a header, read in ranges: each row, and whether its place is behind that of the order before it in its file."""
    at = _folder(spark)
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.concat(F.lit("a|"), F.lit("b")).alias("x"), "o_orderpriority")
    o.repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey").write.csv(at, sep=";", header=True)
    rows = tabular.read_delimited(spark, at, ["key", "status", "x", "priority", "none"], sep=";", skip=1)
    before = F.lag(F.col("key").cast("long")).over(Window.partitionBy("file").orderBy("pos"))
    return rows.select(F.col("key").cast("long").alias("o_orderkey"), "status", "x", "priority", F.col("none").isNull().alias("missing"), F.coalesce(before < F.col("key").cast("long"), F.lit(True)).alias("ordered"))


def json_sources(spark, d):
    """Records by id in one object, a whole table as one array, name and value lines, streams of records by extension."""
    n, at = read(spark, d, "nation"), _folder(spark)
    record = F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")))
    entries = F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"'), F.col("n_nationkey").cast("string"), F.lit('":'), record))), ",")
    blocks.write_files(n.groupBy(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit(".json")).alias("file")).agg(F.concat(F.lit("{"), entries, F.lit("}")).alias("content")), f"{at}/maps")
    maps = tabular.read_json_map(spark, f"{at}/maps", "struct<name:string,region:bigint>").select(F.lit("map").alias("kind"), F.col("id").alias("key"), F.concat_ws("/", "record.name", F.col("record.region").cast("string")).alias("value"))
    pairs = n.select(F.concat(F.lit("  "), F.col("n_name"), F.lit(" :  "), F.col("n_nationkey").cast("string"), F.lit(": x ")).alias("value")).unionByName(spark.sql("SELECT '# remark: no' AS value"))
    pairs.write.text(f"{at}/pairs")
    lines = tabular.read_key_values(spark, f"{at}/pairs").select(F.lit("line").alias("kind"), F.col("name").alias("key"), "value")
    array = reshape.json_array(read(spark, d, "region").select("r_regionkey", "r_name")).select(F.lit("array").alias("kind"), F.lit("region").alias("key"), "value")
    half = F.col("n_nationkey") % 2 == 0
    json = _lines(n.where(half).withColumn("f", F.lit("a.jsonl")), "f", record, ["n_nationkey"])
    yaml = blocks.yaml_files(n.where(~half).select(F.lit("b.yaml").alias("file"), F.col("n_nationkey").alias("pos"), F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("block")))
    blocks.write_files(json.unionByName(yaml), f"{at}/stream")
    stream = blocks.read_block_stream(spark, f"{at}/stream", "name string, region bigint").select(F.lit("stream").alias("kind"), F.col("doc.name").alias("key"), F.col("doc.region").cast("string").alias("value"))
    return maps.unionByName(lines).unionByName(array).unionByName(stream)


def page_sources(spark, d):
    """Links, table cells and embedded data of web pages."""
    p = read(spark, d, "pages")
    page = F.concat("html", F.lit("<table><tr><th>Id</th><td> "), F.col("page_id").cast("string"), F.lit('</td></tr></table><script type="x" id="__NEXT_DATA__">{"n": '), F.col("page_id").cast("string"), F.lit(', "edges": [{"id": "a"}, {"id": "b"}]}</script>'))
    found = F.transform(tabular.links(page), lambda x: F.concat_ws(" ", x["href"], x["text"]))
    data = tabular.embedded_json(page, "struct<n:bigint,edges:array<struct<id:string>>>")
    rows = tabular.table_rows(page)
    return p.select("page_id", F.md5(F.array_join(found, "|")).alias("links"), data["n"].alias("n"), F.array_join(F.transform(data["edges"], lambda e: e["id"]), ",").alias("edges"), F.array_join(F.element_at(rows, -1), "|").alias("cells"))


def xml_sources(spark, d):
    """Dictionary entries, texts of pages, and metadata of packages in XML."""
    p, at = read(spark, d, "part"), _folder(spark)
    key, word = F.col("p_partkey").cast("string"), lambda x: F.replace(x, F.lit("&"), F.lit("&amp;"))
    entry = F.concat(F.lit("<entry><ent_seq>"), key, F.lit("</ent_seq>"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("<k_ele><keb>"), word(F.col("p_name")), F.lit("</keb></k_ele>"))).otherwise(""), F.lit("<r_ele><reb>"), F.lower("p_type"), F.lit("</reb></r_ele><sense><gloss>"), F.col("p_brand"), F.lit("</gloss><gloss>x &amp; y</gloss></sense><sense><gloss>z</gloss></sense></entry>"))
    rooted = lambda line: _lines(p.withColumn("f", F.concat((F.col("p_partkey") % 4).cast("string"), F.lit(".xml"))), "f", line, ["p_partkey"]).select("file", F.concat(F.lit("<all>\n"), "content", F.lit("\n</all>")).alias("content"))
    blocks.write_files(rooted(entry), f"{at}/words")
    words = tabular.read_dictionary(spark, f"{at}/words").select(F.lit("word").alias("kind"), F.col("id").alias("key"), F.concat_ws("|", F.array_join("kanji", ","), F.array_join("readings", ","), F.array_join("glosses", ",")).alias("value"))
    chars = lambda x: F.array_join(F.transform(F.split(x, ""), lambda c: F.concat(F.lit('<char c="'), c, F.lit('"/>'))), "")
    page = F.concat(F.lit('<page number="'), key, F.lit('"><block><line><font>'), chars(F.lower("p_type")), F.lit("</font><font>"), chars(F.lit("ab")), F.lit("</font></line><line><font>"), chars(F.lit("c")), F.lit("</font></line></block><block><line><font>"), chars(F.lit("d")), F.lit("</font></line></block></page>"))
    blocks.write_files(rooted(page), f"{at}/pages")
    pages = tabular.page_texts(spark, f"{at}/pages").select(F.concat(F.lit("page"), F.col("pos").cast("string")).alias("kind"), F.col("page").cast("long").alias("key"), F.col("text").alias("value"))
    opf = F.concat(F.lit('<package><metadata><dc:title xmlns:dc="x">'), F.col("p_name"), F.lit('</dc:title><meta name="ASIN" content="B'), key, F.lit('"/></metadata></package>'))
    about = tabular.package_metadata(opf)
    packages = p.select(F.lit("package").alias("kind"), F.col("p_partkey").alias("key"), F.concat_ws("|", about["title"], about["asin"]).alias("value"))
    return words.unionByName(pages).unionByName(packages)


def file_listing(spark, d):
    """Files below a folder, the recursive ones too, grouped by a pattern, their kind, and the marked folder above them."""
    n, at = read(spark, d, "nation"), _folder(spark)
    content = F.repeat(F.lit("x"), F.col("n_nationkey").cast("int") + 1)
    blocks.write_files(n.select(F.concat(F.lit("p"), F.col("n_regionkey").cast("string"), F.lit("-"), F.col("n_name"), F.lit(".jpg")).alias("file"), content.alias("content")), f"{at}/a/images")
    blocks.write_files(n.select(F.concat(F.col("n_name"), F.when(F.col("n_nationkey") % 2 == 0, ".srt").otherwise(".VTT")).alias("file"), content.alias("content")), f"{at}/a")
    direct = tabular.listing(spark, f"{at}/a", "*.{srt,VTT}").withColumn("slug", F.lit("direct"))
    deep = tabular.listing(spark, f"{at}/a", "*.jpg", recursive=True).withColumn("slug", F.lit("deep"))
    files = tabular.image_groups(direct.unionByName(deep), r"^p(\d)-|^[A-C]", "rest")
    kinds = reshape.input_kind(files.withColumn("ext", F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))), "ext", "name")
    marks = files.select(F.lit(f"{at}/a").alias("directory")).unionByName(files.select(F.lit(f"{at}/a/images").alias("directory"))).select(F.regexp_replace("directory", "^file:/+", "/").alias("directory")).distinct()
    plain = files.withColumns({"path": F.regexp_replace("path", "^file:/+", "/"), "ext": F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))})
    met = lookup.nearest_ancestor(plain, marks).join(kinds, "ext")
    return met.select("name", "length", "grp", "kind", F.regexp_extract("directory", r"([^/]+)$", 1).alias("marked"))


def recognition_sources(spark, d):
    """Results of four recognition services and of one that is registered, as chunks."""
    r, at = read(spark, d, "region"), _folder(spark)
    name = F.col("r_name")
    word = lambda t, c: F.concat(F.lit('{"text":"'), t, F.lit(f'","confidence":{c}}}'))
    made = {
        "acv4": F.concat(F.lit('{"readResult":{"blocks":[{"lines":[{"text":"'), name, F.lit('","words":['), word(name, 0.5), F.lit(']},{"text":" ","words":[]}]}]}}')),
        "easyocr": F.concat(F.lit('{"readResult":[{"text":"'), name, F.lit('","confident":0.25},{"text":"","confident":1}]}')),
        "acv": F.concat(F.lit('{"analyzeResult":{"readResults":[{"lines":[{"text":"'), name, F.lit('","boundingBox":[0,0,9,0,9,5,0,5],"words":['), word(name, 0.75), F.lit("]}]}]}}")),
        "gcv": F.concat(F.lit('{"responses":[{"fullTextAnnotation":{"pages":[{"blocks":[{"paragraphs":[{"words":[{"confidence":0.125,"symbols":[{"text":"'), name, F.lit('"},{"text":"!"}]}]}]}]}]}}]}')),
        "plain": F.concat(F.lit('{"rows":["'), name, F.lit('",""]}')),
    }
    for provider, content in made.items():
        blocks.write_files(r.select(F.concat(name, F.lit(f".{provider}.json")).alias("file"), content.alias("content")), at)
    recognition.register("plain", "rows array<string>", lambda df: df.select("file", F.posexplode("rows").alias("pos", "text")).withColumn("spans", F.array(F.struct("text", F.lit(1.0).alias("confidence")))))
    parts = []
    for provider in made:
        lines = recognition.read_recognised(spark, at, provider).select("file", "pos", "text", "spans")
        parts.append(recognition.recognised_chunks(lines, "OnScreenText").select(F.lit(provider).alias("provider"), "file", F.to_json("chunks").alias("chunks")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def plain_documents(spark, d):
    """Paragraphs of Markdown texts, their plain and HTML forms, and files by a template."""
    c = read(spark, d, "conversations").withColumn("text", F.md5("text"))
    files = c.groupBy(F.col("conv_id").cast("string").alias("file")).agg(F.concat(F.lit("\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(F.lit("**"), x["role"], F.lit("** *is* `at` [here](x)  \n"), x["text"])), "\n \r\n"), F.lit("\n")).alias("content"))
    rows = markdown.paragraphs(files, "file", "content")
    shown = rows.withColumns({"plain": markdown.markdown_to_plain("text"), "html": markdown.markdown_to_html("text")})
    made = markdown.templated(rows, lambda file, rows: f"{file}: " + ",".join(str(len(r["text"])) for r in rows))
    return shown.join(made, "file").select(F.col("file").cast("long").alias("conv_id"), F.col("pos").cast("long").alias("pos"), "plain", "html", F.col("content").alias("made"))


_TEMPLATE = """# {{ file_heading }} ({{ settings.kind }}{{ settings.none }}{{ nothing.at.all }})
{{ for block in blocks -}}
{{ if block.first }}## {{ format_timecode block.at }} {{ block_index }}
{{ else }}---
{{ end -}}
{{ block.role }}: {{ block.text }}
{{- render_image block.picture }}{{ render_audio block.absent }}{{ if block.absent }}never{{ end }}
{{ end }}"""


def templated_turns(spark, d):
    """All conversations as files of a user's template, with a loop, choices, functions and names that nothing has."""
    c = read(spark, d, "conversations").select("conv_id", "turn", "role", "text", (F.col("role") == "user").alias("first"), (F.col("turn") * 61_000_000).cast("long").alias("at"), F.when(F.col("turn") % 3 == 1, F.concat(F.lit("a b"), "turn", F.lit(".jpg"))).alias("picture"))
    files = templates.rendered(c, _TEMPLATE, "conv_id", "turn", {"kind": "chat"})
    return files.select(F.col("file").alias("conv_id"), F.length("content").cast("long").alias("n_chars"), F.md5("content").alias("md5"))


def yaml_sources(spark, d):
    """Content files of their names, one document, a missing database, and workflow files as a graph of edges."""
    c, at = read(spark, d, "conversations"), _folder(spark)
    block = F.struct(F.col("turn").cast("string").alias("id"), F.array(F.struct("text", "role")).alias("chunks"))
    blocks.write_files(blocks.yaml_files(c.select(F.concat(F.lit("conv"), F.col("conv_id").cast("string"), F.lit(".content.yaml")).alias("file"), F.col("turn").alias("pos"), block.alias("block"))), f"{at}/content")
    content = blocks.read_content(spark, f"{at}/content")
    turns = content.select(T.base_name("file").alias("a"), F.col("block.id").alias("b"), F.md5(F.col("block.chunks")[0]["text"]).alias("c"))
    r, n = read(spark, d, "region"), read(spark, d, "nation")
    ops = r.join(n, F.col("r_regionkey") == F.col("n_regionkey")).groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("inputs"))
    record = F.struct(F.col("r_name").alias("name"), "inputs", F.array(F.concat("r_name", F.lit(" out"))).alias("outputs"))
    blocks.write_files(blocks.yaml_files(ops.select(F.lit("all.workflow.yaml").alias("file"), F.col("r_name").alias("pos"), record.alias("block"))), f"{at}/flows")
    flows = blocks.read_yaml(spark, f"{at}/flows", "name string, inputs array<string>, outputs array<string>", "*.workflow.yaml").select("doc.*")
    edges = graph.workflow_edges(flows)
    drawn = graph.mermaid(edges).select(F.lit("mermaid").alias("a"), F.lit("").alias("b"), F.col("line").alias("c")).unionByName(graph.graphviz(edges, "source", "target", None).select(F.lit("graphviz").alias("a"), F.lit("").alias("b"), F.col("line").alias("c")))
    one = blocks.read_yaml(spark, f"{at}/flows", "name string", "all.workflow.yaml").where("pos = 0").select(F.lit("first").alias("a"), F.lit("").alias("b"), F.col("doc.name").alias("c"))
    none = blocks.read_optional(spark, f"{at}/none", "name string").select(F.lit("none").alias("a"), F.lit("").alias("b"), F.col("doc.name").alias("c"))
    return turns.unionByName(drawn).unionByName(one).unionByName(none)


def caption_sources(spark, d):
    """Captions written as WebVTT files of their names, sorted by time, and read again."""
    e, at = timed_events(spark, d), _folder(spark)
    cues = e.where("start_us < end_us").select(F.concat(F.col("file").cast("string"), F.lit(".vtt")).alias("file"), ((F.col("start_us") / 1_000_000).cast("long") % 90_000 * 1_000_000 + F.col("pos") % 7 * 1000).alias("cue_start"), F.col("event_type").alias("cue_text"), (F.col("end_us") - F.col("start_us")).alias("long"))
    cues = cues.withColumn("cue_end", F.col("cue_start") + F.col("long"))
    blocks.write_files(captions.caption_files(cues, "file", "vtt"), at)
    return captions.read_captions(spark, at).select(F.regexp_replace("file", r"\.vtt$", "").cast("long").alias("user_id"), F.col("ordinal").cast("long").alias("ordinal"), "start_us", "end_us", F.col("markdown").alias("text"))


def media_import(spark, d):
    """Blocks with the images and sounds of a media list, and with the text that was recognised in the images."""
    s, at = read(spark, d, "supplier"), _folder(spark)
    key = F.col("s_suppkey")
    ref = key % 3 == 0
    row = F.concat_ws("\t", F.concat(F.lit("ep"), (key % 5).cast("string"), F.when(ref, "|en|").otherwise("|"), key.cast("string")), F.lit("-"), F.concat(F.lit("[sound:"), F.col("s_name"), F.lit(".mp3]")), F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("<img src='"), F.col("s_name"), F.lit(".jpg'>"))), F.lit(""), F.lit(""))
    blocks.write_files(_lines(s.withColumn("f", F.lit("media.tsv")), "f", row, ["s_suppkey"]), at)
    listed = tabular.read_media(spark, f"{at}/media.tsv")
    source = F.struct(key.cast("int").alias("ordinal"))
    empty = F.array(F.struct(F.struct(F.lit(None).cast("int").alias("ordinal")).alias("source")))
    content = s.where(key % 7 != 0).select(F.concat(F.lit("ep"), (key % 5).cast("string"), F.lit(".content.yaml")).alias("file"), key.alias("pos"), F.from_json(F.to_json(F.struct(F.when(~ref, source).alias("source"), F.when(ref, F.create_map(F.lit("en"), F.struct(source.alias("source")))).alias("references"), F.array(F.struct(F.col("s_name").alias("text"))).alias("chunks"))), blocks.BLOCK).alias("block"), empty.alias("unused")).drop("unused")
    files = s.where(key % 5 != 1).select(F.concat(F.col("s_name"), F.lit(".jpg")).alias("path"))
    met = media.import_media(content, listed, files)
    texts = s.where(key % 2 == 0).select(F.col("s_name").alias("file"), F.array(F.struct(F.concat(F.lit("seen "), F.col("s_name")).alias("text"), F.lit(None).cast("string").alias("role"), F.struct(F.array(F.struct(F.lit("x").alias("text"), F.lit(0.5).alias("confidence"))).alias("textSpans")).alias("image"))).alias("chunks"))
    out = media.import_image_text(met, texts, "OnScreenText")
    tag = markdown.audio_line(F.col("block.audio.name"), "audio")
    return out.select(F.col("pos").alias("s_suppkey"), F.col("block.image.name").alias("image"), tag.alias("audio"), F.array_join(F.transform("block.chunks", lambda c: F.concat_ws("/", c["text"], c["role"])), "|").alias("chunks"))


def _films(spark, d):
    p = read(spark, d, "part")
    k = F.col("p_partkey")
    film = F.struct(
        F.when(k % 10 == 0, F.concat(F.lit("Q"), k.cast("string"))).alias("wikidata"), F.array(F.when(k % 2 == 0, "ja").otherwise("en")).alias("language"), F.when(k % 4 == 1, F.struct(F.concat(F.lit("tt"), k.cast("string")).alias("id"), F.create_map(F.lit("top"), F.lit(9)).alias("lists"))).alias("imdb"),
        F.when(k % 3 == 0, F.struct(k.cast("int").alias("id"), F.col("p_name").alias("title"), (k % 6 == 0).alias("watchlist"))).alias("netflix"), F.when(k % 5 == 0, F.struct(k.cast("int").alias("id"), F.when(k % 2 == 0, "movie").otherwise("tv-series").alias("kind"))).alias("tmdb"),
        F.array_compact(F.array(F.when(k % 4 == 1, F.lit("imdb")), F.when(k % 3 == 0, F.lit("netflix")))).alias("origin"),
    )
    return p.select(F.from_json(F.to_json(film), films.FILM).alias("f")).select("f.*")


def film_pipeline(spark, d):
    """Watch-list, ranked list, difficulty levels, ratings, entities and tidying of a film database, in turn."""
    p, s = read(spark, d, "part"), read(spark, d, "lineitem")
    k = F.col("p_partkey")
    db = _films(spark, d)
    watched = p.where(k % 12 == 0).select(k.cast("int").alias("id"), F.concat(F.lit("new "), "p_name").alias("title"))
    db = films.import_watchlist(db, watched)
    members = p.where((k % 4 == 1) & (k % 8 == 1)).select(F.concat(F.lit("tt"), k.cast("string")).alias("id"), F.col("p_name").alias("title"), F.col("p_size").alias("rank"))
    db = films.import_list(db, members, "top")
    levels = p.where(k % 5 == 0).select(k.cast("int").alias("tmdbId"), F.lit("movie").alias("tmdbKind"), F.col("p_name").alias("title"), F.lit("http://x").alias("url"), F.when(k % 15 != 0, F.col("p_size")).cast("int").alias("level"), F.lit(False).alias("temporary"), F.explode(F.array(F.lit("season"), F.lit("series"))).alias("source"), k.alias("pos"))
    db = films.enrich_levels(db, levels, ["ja"])
    ids = p.where(k % 7 == 0).select(F.lit("netflix").alias("kind"), k.cast("string").alias("id"), F.concat(F.lit("Q9"), k.cast("string")).alias("entity"))
    db = films.resolve_entities(db, ids)
    basics = p.where(k % 8 == 1).select(F.concat(F.lit("tt"), k.cast("string")).alias("tconst"), F.lit("movie").alias("titleType"), F.col("p_name").alias("primaryTitle"), F.col("p_name").alias("originalTitle"), (F.col("p_size") + 1900).cast("int").alias("startYear"), F.lit(None).cast("int").alias("endYear"), F.lit(None).cast("int").alias("runtimeMinutes"), F.array(F.col("p_type")).alias("genres"))
    ratings = basics.select("tconst", F.lit("7.5").alias("averageRating"), F.lit("10").alias("numVotes"))
    episodes = s.select(F.col("l_orderkey").cast("string").alias("tconst"), F.concat(F.lit("tt"), F.col("l_partkey").cast("string")).alias("parentTconst"), F.col("l_linenumber").cast("string").alias("seasonNumber"))
    db = films.enrich_imdb(db, basics, ratings, episodes)
    db = upsert.prune(db)
    old = upsert.migrate(db.withColumnRenamed("language", "lang"), {"lang": "language"})
    return upsert.canonical(old, films.ORDER).select(
        F.coalesce(F.col("netflix.id"), F.regexp_replace("imdb.id", "tt", "").cast("int")).cast("long").alias("p_partkey"), "wikidata", F.col("netflix.watchlist").alias("watchlist"), F.try_element_at("imdb.lists", F.lit("top")).cast("long").alias("rank"),
        F.col("natively.level").cast("long").alias("level"), F.col("imdb.title").alias("title"), F.col("imdb.year").cast("long").alias("year"), F.col("imdb.episodes").alias("episodes"), F.col("imdb.seasons").alias("seasons"), F.array_join("origin", ",").alias("origin"),
    )


def title_suggestions(spark, d):
    """Works that may be the films of a catalogue: by title, type and Japanese signal, best first."""
    p = read(spark, d, "part")
    k = F.col("p_partkey")
    work = F.concat(F.lit("tt"), F.lpad(k.cast("string"), 9, "0"))
    basics = p.select(work.alias("tconst"), F.element_at(F.array(F.lit("movie"), F.lit("tvSeries"), F.lit("videoGame")), (k % 3).cast("int") + 1).alias("titleType"), F.concat(F.upper("p_name"), F.lit("!")).alias("primaryTitle"), F.when(k % 5 == 0, F.lit("山の道")).otherwise(F.col("p_name")).alias("originalTitle"), F.col("p_size").cast("int").alias("startYear"))
    akas = p.where(k % 4 == 0).select(work.alias("titleId"), F.col("p_brand").alias("title"), F.when(k % 8 == 0, "ja").alias("language"), F.when(k % 8 != 0, "JP").alias("region"))
    ratings = p.where(k % 2 == 0).select(work.alias("tconst"), F.lit("5").alias("averageRating"), F.col("p_size").cast("string").alias("numVotes"))
    shared, lists = films.suggested_lists(_films(spark, d), basics, akas, ratings)
    shown = lists.select("titles", F.col("best.work").alias("best"), F.array_join(F.transform("ranked", lambda x: x["work"]), ",").alias("ranked"))
    return shared.join(shown, "titles").select(F.col("film").cast("long").alias("film"), "best", "ranked")


def table_upkeep(spark, d):
    """Changed rows, values with gaps filled and recorded, defaults, repeated keys, preferred ids."""
    c, s = read(spark, d, "customer"), read(spark, d, "supplier")
    target = c.withColumn("c_acctbal", F.when(F.col("c_custkey") % 9 == 0, F.lit(None)).otherwise(F.col("c_acctbal")))
    moved = lookup.changed(c, target, "c_custkey", ["c_acctbal", "c_name"]).select(F.lit("changed").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    inline = c.select((F.col("c_nationkey") * 100).alias("key"), F.when(F.col("c_custkey") % 2 == 0, "").otherwise("own").alias("given"), "c_custkey")
    table = read(spark, d, "nation").where("n_nationkey % 3 > 0").select((F.col("n_nationkey") * 100).alias("key"), F.col("n_name").alias("symbol"))
    filled, grown = lookup.with_gaps(inline, table, "key", "given", "symbol")
    filled = filled.select(F.lit("filled").alias("kind"), F.col("c_custkey").alias("key"), F.col("symbol").alias("value"))
    grown = grown.select(F.lit("table").alias("kind"), "key", F.col("symbol").alias("value"))
    rated = lookup.or_default(s.select(F.col("s_suppkey").alias("key")), c.select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value")).where("key % 2 = 0"), "key", "value", "none").select(F.lit("rated").alias("kind"), "key", "value")
    twice = stats.duplicates(c.select(F.concat(F.col("c_mktsegment"), (F.col("c_custkey") % 40).cast("string")).alias("k")), "k").select(F.lit("twice").alias("kind"), F.col("n").alias("key"), F.col("k").alias("value"))
    ids = c.select("c_nationkey", F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 == 0, "tv").when(F.col("c_custkey") % 5 < 3, "movie").alias("kind"), F.when(F.col("c_nationkey") % 2 == 0, F.col("c_custkey") * 7 % 50).cast("int").alias("ordinal"))
    chosen = resolve.preferred(ids, "c_nationkey", "id", "kind", "ordinal", ["tv", "movie"]).select(F.lit("chosen").alias("kind"), F.col("c_nationkey").alias("key"), F.col("id").cast("string").alias("value"))
    return moved.unionByName(filled).unionByName(grown).unionByName(rated).unionByName(twice).unionByName(chosen)


def graph_paths(spark, d):
    """Decomposition without cycles, edges back to an ancestor marked, and the volumes that volumes link to."""
    s = read(spark, d, "supplier")
    key = F.col("s_suppkey")
    n = s.count()
    edges = s.where(key <= n).select((key % 10).alias("parent"), (key % 7).alias("child")).where("parent <> child").distinct()
    paths = graph.acyclic_paths(edges, spark.range(2).withColumnRenamed("id", "node"), max_depth=4)
    steps = graph.renamed(paths).groupBy("root").agg(F.count("*").alias("n"), F.count_if("dashed").alias("n_dashed"), F.countDistinct("child").alias("n_nodes")).select(F.lit("paths").alias("kind"), F.col("root").alias("key"), F.concat_ws("/", F.when(F.col("n") > 0, "some"), F.when(F.col("n_dashed") <= F.col("n"), "some")).alias("value"))
    volumes = s.select(F.col("s_name").alias("moniker"), F.when(key % 2 == 0, F.array(F.lit("nowhere"), F.format_string("Supplier#%09d", key - 1), F.col("s_name"))).otherwise(F.array().cast("array<string>")).alias("linkedVolumes"))
    links = graph.linked(volumes).select(F.lit("link").alias("kind"), F.col("link_no").cast("long").alias("key"), F.concat_ws(">", "moniker", "linked").alias("value"))
    return steps.unionByName(links)


def content_search(spark, d):
    """An index that grows by appending, opened again and searched for all items: their blocks, best first."""
    docs, at = read(spark, d, "documents"), _folder(spark)
    content = docs.select(F.format_string("%012d", "doc_id").alias("file"), F.lit(0).cast("long").alias("pos"), F.struct(F.col("doc_id").cast("string").alias("id"), F.array(F.struct("text")).alias("chunks")).alias("block"))
    early = F.col("file") < F.format_string("%012d", F.lit(500))
    media.index_content(content.where(early), tokens=stats.words).save(at)
    index = media.index_content(content.where(~early), tokens=stats.words).append(at)
    assert index.docs.count() == docs.where("text <> ''").count()
    hits = media.search_content(search.Index.load(spark, at), read(spark, d, "benchmark"), 10, "item_id", "text", tokens=stats.words)
    return hits.select("item_id", F.col("rank").cast("long").alias("rank"), F.col("block.id").cast("long").alias("doc_id"), "score", "phrase")


def incremental_runs(spark, d):
    """Files that arrive, taken up once each; blocks folded as they come; leaders kept between runs; a budget for each run."""
    c, at = read(spark, d, "conversations"), _folder(spark)
    block = F.struct(F.array(F.struct("text")).alias("chunks"))
    files = blocks.yaml_files(c.select(F.concat(F.lit("conv"), F.col("conv_id").cast("string"), F.lit(".content.yaml")).alias("file"), F.col("turn").alias("pos"), block.alias("block"))).withColumn("half", F.length("file") % 2)
    files = stored(files)
    fold = lambda raw: blocks.parsed_yaml(raw, blocks.BLOCK, "block").withColumn("n", F.size(folds.merge_reference_chunks(F.transform("block.chunks", lambda x: F.struct(x["text"].alias("text"), x["actor"].alias("actor"), x["role"].alias("role"), F.lit(None).cast("map<string,struct<text:string,actor:string,role:string>>").alias("references")))))).select("file", "pos", "n")
    for part in (0, 1):
        blocks.write_files(files.where(F.col("half") == part).select("file", "content"), f"{at}/in")
        for _ in range(2):  # the second run finds nothing new
            incremental.process_new_files(spark, f"{at}/in", "*.content.yaml", fold, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    taken = spark.read.parquet(f"{at}/out").groupBy("file").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).select(F.lit("file").alias("kind"), F.regexp_extract("file", r"(\d+)", 1).cast("long").alias("key"), F.concat_ws("/", F.col("rows").cast("string"), F.col("n").cast("string")).alias("value"))
    wanted, done = c.select(F.col("conv_id").alias("key")), spark.createDataFrame([], "key long")
    for _ in range(3):
        done = stored(done.unionByName(incremental.budgeted(wanted, done, "key", 7)))
    spent = done.select(F.lit("budget").alias("kind"), "key", F.lit("").alias("value"))
    e = read(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    windows = incremental.event_windows(e, "ts", ["event_type"], "value", "1 day").select(F.lit("window").alias("kind"), F.unix_timestamp("start").alias("key"), F.concat_ws("/", "event_type", F.col("n").cast("string")).alias("value"))
    return taken.unionByName(spent).unionByName(windows)


def leader_stream(spark, d):
    """Leader clustering of images as they arrive in files, the leaders kept between the files."""
    e, at = read(spark, d, "embeddings"), _folder(spark)
    rows = e.select(F.col("label").cast("string").alias("file"), F.col("vec_id").alias("pos"), F.col("vec_id").cast("string").alias("name"), bits.average_hash("embedding").alias("signature"))
    rows.coalesce(1).write.parquet(f"{at}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{at}/in")
    incremental.leader_clusters_stream(stream, 0.6).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out").select(F.col("file").cast("int").alias("label"), F.col("pos").alias("vec_id"), "grp", "candidate", F.round("similarity", 6).alias("similarity"))


def table_functions(spark, d):
    """SQL over the registered table functions, caches as files, images of packages, names in natural order of compatible
    characters, and streams aligned by another aligner."""
    tables.register(spark)
    n, at = read(spark, d, "nation"), _folder(spark)
    n.createOrReplaceTempView("lectern_nation")
    docs = spark.sql("SELECT 'yaml' AS kind, t.pos + 10 * n_nationkey AS key, t.json AS value FROM lectern_nation, LATERAL yaml_documents('name: ' || n_name || '\\n---\\nkey: ' || n_nationkey || '\\n') t")
    lines = spark.sql("SELECT 'line' AS kind, line_no + 10 * n_nationkey AS key, line || fits AS value FROM lectern_nation, LATERAL text_lines(n_name || '\\nx', '^A') t")
    blocks.write_files(reshape.cache_files(n.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit(".json")).alias("f"), F.concat("n_name", F.lit('"')).alias("n"), bits.to_hex(F.col("n_nationkey")).alias("h")), "f", "n", "h"), f"{at}/cache")
    cache = spark.read.text(f"{at}/cache").select(F.lit("cache").alias("kind"), F.lit(0).cast("long").alias("key"), "value")
    entries = F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"'), F.col("n_nationkey").cast("string"), F.lit('":"'), "n_name", F.when(F.col("n_nationkey") % 2 == 0, ".JPG").otherwise(".mp3"), F.lit('"')))), ",")
    blocks.write_files(n.groupBy(F.col("n_regionkey").cast("string").alias("file")).agg(F.concat(F.lit("{"), entries, F.lit("}")).alias("content")), f"{at}/media")
    images = tabular.package_images(spark, f"{at}/media").select(F.lit("image").alias("kind"), F.col("id").cast("long").alias("key"), F.col("name").alias("value"))
    wide = F.translate(F.col("n_nationkey").cast("string"), "0123456789", "０１２３４５６７８９")
    ranked = sequence.natural_rank(n.select("n_regionkey", T.nfkc(F.concat(F.lit("Ｆile "), wide)).alias("name")), ["n_regionkey"], "name").select(F.lit("natural").alias("kind"), F.col("natural_rank").cast("long").alias("key"), F.concat_ws("/", F.col("n_regionkey").cast("string"), "name").alias("value"))
    e = timed_events(spark, d)
    pairs = intervals.align_by_order(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"))
    aligned = pairs.select(F.lit("aligned").alias("kind"), F.coalesce("in_pos", "ref_pos").alias("key"), F.concat_ws("/", F.col("in_pos").cast("string"), F.col("ref_pos").cast("string")).alias("value"))
    out = docs
    for part in (lines, cache, images, ranked, aligned):
        out = out.unionByName(part)
    return out


QUERIES = {
    f.__name__: f
    for f in (
        title_tables, list_exports, delimited_import, yaml_stream, delimited_stream, json_sources, page_sources, xml_sources, file_listing, recognition_sources, plain_documents, templated_turns, yaml_sources, caption_sources, media_import, film_pipeline, title_suggestions, table_upkeep, graph_paths,
        content_search, incremental_runs, leader_stream, table_functions,
    )
}

_CHUNK = """'[{{"text":"' || {0} || '","role":"OnScreenText","image":{{"textSpans":[{{"text":"' || {0} || '","confidence":{1}}}]}}}}]'"""
ORACLE: dict[str, str] = {
    "title_tables": r"""SELECT 'tt' || p_partkey AS tconst, p_name AS "primaryTitle", CASE WHEN p_partkey % 3 <> 0 THEN 'original' END AS "originalTitle", p_partkey % 2 = 1 AS "isAdult", (p_size + 1900)::BIGINT AS "startYear", CAST(NULL AS INTEGER) AS "endYear", p_type || '|' || p_brand AS genres FROM part""",
    "list_exports": """SELECT true AS named, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS position, 'tt' || c_custkey AS const, c_name || ', "x"' AS title FROM customer""",
    "delimited_import": """SELECT n_regionkey::VARCHAR AS region, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS pos, n_nationkey::VARCHAR AS key,
          '{"title":"' || array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') || '"' || CASE WHEN n_nationkey % 2 = 1 THEN ',"note":"odd"' ELSE '' END || '}' AS block FROM nation""",
    "yaml_stream": "SELECT doc_id, lang, source, length(text) AS n_chars, md5(text) AS md5 FROM documents",
    "delimited_stream": "SELECT o_orderkey, o_orderstatus AS status, 'a|b' AS x, o_orderpriority AS priority, true AS missing, true AS ordered FROM orders",
    "json_sources": """SELECT 'map' AS kind, n_nationkey::VARCHAR AS key, n_name || '/' || n_regionkey AS value FROM nation UNION ALL SELECT 'line', n_name, n_nationkey || ': x' FROM nation
        UNION ALL SELECT 'array', 'region', '[' || string_agg('{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}', ',' ORDER BY '{"r_regionkey":' || r_regionkey) || ']' FROM region UNION ALL SELECT 'stream', n_name, n_regionkey::VARCHAR FROM nation""",
    "page_sources": r"""WITH x AS (SELECT page_id, regexp_extract_all(html, '(?s)<a\s[^>]*href="[^"]*"[^>]*>.*?</a>') AS l FROM pages),
        y AS (SELECT page_id, list_transform(l, lambda a: regexp_extract(a, 'href="([^"]*)"', 1) || ' ' || trim(replace(replace(replace(replace(replace(replace(regexp_replace(a, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'))) AS t FROM x)
        SELECT page_id, md5(array_to_string(t, '|')) AS links, page_id AS n, 'a,b' AS edges, 'Id|' || page_id AS cells FROM y""",
    "xml_sources": """SELECT 'word' AS kind, p_partkey AS key, CASE WHEN p_partkey % 2 = 0 THEN p_name || '|' ELSE '' END || lower(p_type) || '|' || p_brand || ',x & y,z' AS value FROM part
        UNION ALL SELECT 'page0', p_partkey, lower(p_type) || 'ab' || chr(10) || 'c' FROM part UNION ALL SELECT 'page1', p_partkey, 'd' FROM part UNION ALL SELECT 'package', p_partkey, p_name || '|B' || p_partkey FROM part""",
    "file_listing": """SELECT 'p' || n_regionkey || '-' || n_name || '.jpg' AS name, n_nationkey + 2 AS length, n_regionkey::VARCHAR AS grp, 'image' AS kind, 'images' AS marked FROM nation
        UNION ALL SELECT n_name || CASE WHEN n_nationkey % 2 = 0 THEN '.srt' ELSE '.VTT' END, n_nationkey + 2, CASE WHEN n_name < 'D' THEN n_name[1] ELSE 'rest' END, 'subtitle', 'a' FROM nation""",
    "recognition_sources": " UNION ALL ".join(f"SELECT '{p}' AS provider, r_name AS file, {_CHUNK.format(t, c)} AS chunks FROM region" for p, t, c in (("acv4", "r_name", "0.5"), ("easyocr", "r_name", "0.25"), ("acv", "r_name", "0.75"), ("gcv", "(r_name || '!')", "0.125"), ("plain", "r_name", "1.0"))),
    "plain_documents": """WITH x AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, md5(text)) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) - 1 AS n, role, md5(text) AS t FROM conversations)
        SELECT conv_id, pos, role || ' is at here' || chr(10) || t || chr(10) AS plain, '<p><strong>' || role || '</strong> <em>is</em> <code>at</code> <a href="x">here</a><br />' || chr(10) || t || '</p>' || chr(10) AS html,
          conv_id || ': ' || string_agg(length(role) + 59 + CASE WHEN pos = n THEN 1 ELSE 0 END, ',') OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS made FROM x""",
    "templated_turns": """WITH x AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS k FROM conversations),
        y AS (SELECT conv_id, k, CASE WHEN role = 'user' THEN '## ' || printf('%02d:%02d:%02d', turn * 61 // 3600, turn * 61 // 60 % 60, turn * 61 % 60) || ' ' || k || chr(10) ELSE '---' || chr(10) END || coalesce(role, '') || ': ' || coalesce(text, '') ||
          CASE WHEN turn % 3 = 1 THEN '![](images/a%20b' || turn || '.jpg)' ELSE '' END || chr(10) AS t FROM x), z AS (SELECT conv_id, '# ' || conv_id || ' (chat)' || chr(10) || string_agg(t, '' ORDER BY k) AS c FROM y GROUP BY 1)
        SELECT conv_id, length(c) AS n_chars, md5(c) AS md5 FROM z""",
    "yaml_sources": r"""WITH n AS (SELECT r_name, n_name FROM region JOIN nation ON r_regionkey = n_regionkey), e AS (SELECT n_name AS s, r_name AS t FROM n UNION ALL SELECT DISTINCT r_name, r_name || ' out' FROM n)
        SELECT 'conv' || conv_id AS a, turn::VARCHAR AS b, md5(text) AS c FROM conversations UNION ALL SELECT 'mermaid', '', '    ' || replace(s, ' ', '_') || '["' || s || '"] --> ' || replace(t, ' ', '_') || '["' || t || '"]' FROM e
        UNION ALL SELECT 'graphviz', '', '  "' || s || '" -> "' || t || '";' FROM e UNION ALL SELECT 'first', '', min(r_name) FROM n""",
    "caption_sources": """WITH x AS (SELECT user_id, event_type, epoch_us(ts) AS s0, CAST(round(value * 600) AS BIGINT) * 1000000 AS d, event_id FROM events),
          y AS (SELECT user_id, event_type, s0 // 1000000 % 90000 * 1000000 + event_id % 7 * 1000 AS s, d FROM x WHERE d > 0)
        SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY s, s + d, event_type) AS ordinal, s AS start_us, s + d AS end_us, event_type AS text FROM y""",
    "media_import": """WITH x AS (SELECT s_suppkey, s_name, s_suppkey % 4 <> 0 AND s_suppkey % 5 <> 1 AS seen, s_suppkey % 3 = 0 AS ref FROM supplier WHERE s_suppkey % 7 <> 0)
        SELECT s_suppkey, CASE WHEN seen THEN s_name || '.jpg' END AS image, CASE WHEN NOT ref THEN '<audio controls src="audio/' || replace(s_name, '#', '%23') || '.mp3"></audio>' END AS audio,
          s_name || CASE WHEN seen AND s_suppkey % 2 = 0 THEN '|seen ' || s_name || '/OnScreenText' ELSE '' END AS chunks FROM x""",
    "film_pipeline": """WITH e AS (SELECT l_partkey AS k, count(*) AS n, count(DISTINCT l_linenumber) AS m FROM lineitem GROUP BY 1)
        SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'Q' || p_partkey WHEN p_partkey % 21 = 0 THEN 'Q9' || p_partkey END AS wikidata, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 12 = 0 END AS watchlist,
          CASE WHEN p_partkey % 8 = 1 THEN p_size END AS rank, CASE WHEN p_partkey % 10 = 0 AND p_partkey % 15 <> 0 THEN p_size END AS level, CASE WHEN p_partkey % 8 = 1 THEN p_name END AS title,
          CASE WHEN p_partkey % 8 = 1 THEN p_size + 1900 END AS year, CASE WHEN p_partkey % 8 = 1 THEN n END AS episodes, CASE WHEN p_partkey % 8 = 1 THEN m END AS seasons,
          concat_ws(',', CASE WHEN p_partkey % 8 = 1 THEN 'imdb' END, CASE WHEN p_partkey % 3 = 0 THEN 'netflix' END) AS origin
        FROM part LEFT JOIN e ON k = p_partkey WHERE p_partkey % 3 = 0 OR p_partkey % 8 = 1""",
    "title_suggestions": r"""WITH p AS (SELECT *, trim(regexp_replace(lower(p_name), '[^\p{L}\p{Nd}]+', ' ', 'g')) AS k, trim(regexp_replace(lower(p_brand), '[^\p{L}\p{Nd}]+', ' ', 'g')) AS b, 'tt' || lpad(p_partkey::VARCHAR, 9, '0') AS work FROM part),
          f AS (SELECT p_partkey AS film, k FROM p WHERE p_partkey % 3 = 0 AND p_partkey % 10 <> 0), w AS (SELECT work, unnest([k, CASE WHEN p_partkey % 4 = 0 THEN b END]) AS k, p_partkey % 3 AS r, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE 0 END AS v FROM p WHERE p_partkey % 3 < 2 AND (p_partkey % 4 = 0 OR p_partkey % 5 = 0)),
          c AS (SELECT DISTINCT film, work, r, v FROM f JOIN w USING (k) WHERE k <> '')
        SELECT film, first(work ORDER BY r, v DESC, work) AS best, string_agg(work, ',' ORDER BY r, v DESC, work) AS ranked FROM c GROUP BY 1""",
    "table_upkeep": """WITH t AS (SELECT n_nationkey * 100 AS key, n_name AS symbol FROM nation WHERE n_nationkey % 3 > 0), i AS (SELECT c_nationkey * 100 AS key, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'own' END AS given, c_custkey FROM customer),
          d AS (SELECT *, CASE WHEN c_custkey % 5 = 0 THEN 'tv' WHEN c_custkey % 5 < 3 THEN 'movie' END AS kind, CASE WHEN c_nationkey % 2 = 0 THEN c_custkey * 7 % 50 END AS o FROM customer),
          r AS (SELECT c_nationkey, c_custkey FROM d QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE kind WHEN 'tv' THEN 0 WHEN 'movie' THEN 1 ELSE 2 END, o, c_custkey) = 1 AND kind IS NOT NULL)
        SELECT 'changed' AS kind, c_custkey AS key, c_name AS value FROM customer WHERE c_custkey % 9 = 0 AND c_acctbal IS NOT NULL UNION ALL SELECT 'filled', c_custkey, coalesce(nullif(given, ''), symbol, '') FROM i LEFT JOIN t USING (key)
        UNION ALL SELECT 'table', key, symbol FROM t UNION ALL SELECT DISTINCT 'table', key, '' FROM i WHERE given = '' AND key NOT IN (SELECT key FROM t)
        UNION ALL SELECT 'rated', s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN coalesce(c_mktsegment, 'none') ELSE 'none' END FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey
        UNION ALL SELECT 'twice', count(*), lower(c_mktsegment || (c_custkey % 40)) FROM customer GROUP BY 3 HAVING count(*) > 1
        UNION ALL SELECT 'chosen', k.c_nationkey, r.c_custkey::VARCHAR FROM (SELECT DISTINCT c_nationkey FROM customer) k LEFT JOIN r ON r.c_nationkey = k.c_nationkey""",
    "graph_paths": """WITH s AS (SELECT DISTINCT s_suppkey % 10 AS p, s_suppkey % 7 AS c FROM supplier WHERE s_suppkey % 10 <> s_suppkey % 7)
        SELECT DISTINCT 'paths' AS kind, p AS key, 'some/some' AS value FROM s WHERE p < 2
        UNION ALL SELECT 'link', 1, s_name || '>' || printf('Supplier#%09d', s_suppkey - 1) FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey - 1 IN (SELECT s_suppkey FROM supplier)
        UNION ALL SELECT 'link', 2, s_name || '>' || s_name FROM supplier WHERE s_suppkey % 2 = 0""",
    "table_functions": f"""WITH {EVENTS_SQL}, v AS (SELECT *, row_number() OVER (PARTITION BY file, event_type ORDER BY pos) AS n FROM ev)
        SELECT 'yaml' AS kind, 10 * n_nationkey AS key, '{{"name": "' || n_name || '"}}' AS value FROM nation UNION ALL SELECT 'yaml', 10 * n_nationkey + 1, '{{"key": ' || n_nationkey || '}}' FROM nation
        UNION ALL SELECT 'line', 10 * n_nationkey, n_name || CASE WHEN n_name LIKE 'A%' THEN 'true' ELSE 'false' END FROM nation UNION ALL SELECT 'line', 10 * n_nationkey + 1, 'xfalse' FROM nation
        UNION ALL SELECT 'cache', 0, '{{"images":{{' || string_agg('"' || n_name || '\\"":"' || lpad(lower(to_hex(n_nationkey)), 16, '0') || '"', ',' ORDER BY n_name) || '}}}}' FROM nation GROUP BY n_regionkey
        UNION ALL SELECT 'image', n_nationkey, n_name || '.JPG' FROM nation WHERE n_nationkey % 2 = 0
        UNION ALL SELECT 'natural', row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), n_regionkey || '/File ' || n_nationkey FROM nation
        UNION ALL SELECT 'aligned', coalesce(a.pos, b.pos), concat_ws('/', a.pos::VARCHAR, b.pos::VARCHAR) FROM (SELECT * FROM v WHERE event_type = 'view') a FULL JOIN (SELECT * FROM v WHERE event_type = 'purchase') b ON a.file = b.file AND a.n = b.n""",
    "leader_stream": _LEADERS,
    "content_search": _SCORES + " SELECT item_id, rank, doc_id, score, phrase FROM rk WHERE rank <= 10",
    "incremental_runs": """SELECT 'file' AS kind, conv_id AS key, count(*) || '/' || count(*) AS value FROM conversations GROUP BY 2 UNION ALL SELECT 'budget', conv_id, '' FROM (SELECT DISTINCT conv_id FROM conversations ORDER BY 1 LIMIT 21)
        UNION ALL SELECT 'window', epoch(date_trunc('day', ts))::BIGINT, event_type || '/' || count(*) FROM events GROUP BY 2, event_type""",
}
