"""Scalar functions over whole tables: names, markup, lists, times, options."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import bits, maps
from lectern.functions import text as T
from lectern.functions import time as TM
from lectern.operators import filters, folds, reshape, sequence, stats
from lectern.plans.tables import read


def file_names(spark, d):
    """Base names, bare names, clean names, directories, episode marks, escaped addresses, filled templates."""
    p = read(spark, d, "part")
    key, odd = F.col("p_partkey"), F.col("p_partkey") % 3 != 0
    path = F.concat(F.lit("lib/"), F.col("p_brand"), F.lit("/"), F.col("p_name"), F.lit("."), F.col("p_type"), F.when(odd, ".content.yaml").otherwise(".srt"))
    raw = F.concat(F.lit(" "), F.col("p_name"), F.lit(": <"), F.col("p_type"), F.lit('/>?" '))
    episode = F.concat(F.col("p_name"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" S"), F.col("p_size").cast("string"), F.lit("e"), (key % 100).cast("string"))).otherwise(" S1 E2"))
    return p.select(
        "p_partkey", T.base_name(path).alias("base"), T.without_extensions(path).alias("bare"), T.clean_file_name(raw).alias("clean"), T.volume_directory(F.when(key % 4 == 0, "").otherwise(F.col("p_brand")), raw).alias("directory"),
        T.film_qualifier(episode).alias("episode"), T.uri_escaped(F.concat(path, F.lit(" ~*+é&"))).alias("address"), T.substituted(F.lit("%name%-%size%-%other%"), {"name": F.col("p_name"), "size": F.when(odd, F.col("p_size").cast("string"))}).alias("filled"),
        F.sha2(path, 256).alias("sha256"), F.md5(path).alias("md5"),
    )


def media_fields(spark, d):
    """Sound and image fields of a media list and its keys."""
    c = read(spark, d, "customer")
    n = F.col("c_custkey")
    sound = F.when(n % 5 == 0, "").when(n % 5 != 1, F.concat(F.lit("[sound:"), F.col("c_name"), F.lit(".mp3]")))
    image = F.when(n % 4 == 0, "").otherwise(F.concat(F.lit("<img src='"), F.col("c_name"), F.when(n % 2 == 0, ".png'/>").otherwise(".jpg' />")))
    key = F.concat(F.col("c_mktsegment"), F.when(n % 3 == 0, F.concat(F.lit("|"), F.col("c_nationkey").cast("string"))).otherwise(""), F.lit("|"), n.cast("string"))
    k = T.media_key(key)
    return c.select("c_custkey", T.sound_file(sound).alias("sound"), T.image_file(image).alias("image"), k["base"].alias("base"), k["ref"].alias("ref"), k["ordinal"].cast("long").alias("ordinal"))


#: Names of audio tracks that some catalogue uses, by code.
CODES = {"japanese": "ja", "english": "en", "spanish": "es", "portuguese": "pt"}


def language_lists(spark, d):
    c = read(spark, d, "customer")
    n = F.col("c_custkey") % 5
    tracks = F.when(n == 0, "Japanese [Original], English - Audio Description").when(n == 1, "English, European Spanish (dub),  Latin American Spanish, Klingon").when(n == 2, "Brazilian Portuguese [Original],English").when(n == 3, "")
    return c.select("c_custkey", F.array_join(T.language_codes(tracks, CODES), ",").alias("all"), F.array_join(T.language_codes(tracks, CODES, original_only=True), ",").alias("original"))


def titles_and_ids(spark, d):
    """Titles by language, ids, kebab case, notes, readings, lists."""
    c = read(spark, d, "customer")
    n, name = F.col("c_custkey"), F.col("c_name")
    titles = F.when(n % 4 == 0, F.create_map(F.lit("ja"), F.lit(""), F.lit("fr"), name, F.lit("zz"), F.lit("last"))).when(n % 4 == 1, F.create_map(F.lit("de"), F.lit("ein Name"), F.lit("en"), name)).when(n % 4 == 2, F.create_map(F.lit("en"), F.lit("")))
    genres = F.when(n % 3 == 0, r"\N").when(n % 3 == 1, F.concat(F.col("c_mktsegment"), F.lit(", Other"))).otherwise("")
    lists = F.array_join(T.split_list(genres), "|")
    return c.select(
        "c_custkey", T.display_title(titles).alias("title"), T.entity_id(F.concat(F.lit("http://www.example.org/entity/Q"), n.cast("string"))).alias("entity"), T.without_zero_width(F.concat(F.lit("﻿ "), name, F.lit("​ ‍"))).alias("visible"),
        T.kebab(F.concat(F.lit("RemoveAll"), F.initcap(F.lower("c_mktsegment")), F.lit("Text2Md"))).alias("kebab"), T.note_text(F.concat(name, F.lit("　"), F.col("c_mktsegment"))).alias("note"), T.node_id(F.concat(F.lit("("), F.col("c_mktsegment"), F.lit(") big  one; "), name)).alias("node"),
        T.parenthetical_ruby(F.concat(name, F.lit("（よみ） x(y) (z)"))).alias("readings"), lists.alias("genres"), T.is_word_char(F.substring(F.concat(F.lit("é_-9 "), name), F.pmod(n, F.lit(5)).cast("int") + 1, F.lit(1))).alias("is_word"), T.has_ideograph(F.when(n % 2 == 0, F.concat(name, F.lit("山")))).alias("ideograph"),
        T.without_suffix_notes(F.concat(name, F.lit(" (cf. x) (via y)"))).alias("bare"), T.blank(F.when(n % 3 == 0, "　\t").when(n % 3 == 1, name)).alias("blank"),
    )


def option_values(spark, d):
    """Options given as text, as the narrowest JSON value."""
    c = read(spark, d, "customer")
    n = F.col("c_custkey")
    raw = F.when(n % 5 == 0, "True").when(n % 5 == 1, n.cast("string")).when(n % 5 == 2, F.concat((n % 100).cast("string"), F.lit(".5"))).when(n % 5 == 3, F.concat(F.lit('a "b" '), n.cast("string"))).otherwise("false")
    return c.select("c_custkey", T.coerced(raw).alias("value"))


def text_lines(spark, d):
    """Lines by any line end and without the marks of cues."""
    x = read(spark, d, "documents")
    lines = T.lines("text")
    marked = F.concat(F.lit("<i>"), F.coalesce("text", F.lit("")), F.lit("&lrm;</i>‏"))
    return x.select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.md5(F.array_join(lines, "|")).alias("lines_md5"), F.md5(filters.without_markup(marked)).alias("plain_md5"))


def transcript_lines(spark, d):
    """Lines of a transcript: who speaks, and what only sounds."""
    c = read(spark, d, "conversations")
    text = F.concat(F.lit("（"), F.col("role"), F.lit("） "), F.md5("text"), F.lit("\nand on\n（"), F.lit("noise）\nturn "), F.col("turn").cast("string"))
    return reshape.line_kinds(c.select(F.col("conv_id").alias("file"), F.col("turn").alias("pos"), text.alias("text"))).select(F.col("file").alias("conv_id"), F.col("pos").alias("turn"), "part", "kind", "actor", "text")


def time_expressions(spark, d):
    """Time expressions of four kinds, the years of two dates, and times of a run."""
    e = read(spark, d, "events")
    k = F.col("event_id")
    raw = F.when(k % 5 == 0, F.format_string("%02d:%02d:%02d.5", k % 24, k % 60, k % 59)).when(k % 5 == 1, F.concat((k % 1000).cast("string"), F.lit(".25s"))).when(k % 5 == 2, F.concat((k % 9999).cast("string"), F.lit("ms"))).when(k % 5 == 3, F.concat(k.cast("string"), F.lit("0t"))).otherwise("12:61f")
    vtt = F.when(k % 2 == 0, F.format_string("%02d:%02d.%03d", k % 60, k % 60, k % 1000)).otherwise(F.format_string("%03d:00:%02d.%02d", k, k % 60, k % 100))
    early = F.when(k % 3 == 0, F.col("ts"))
    return e.select(F.col("event_id"), TM.ttml_time(raw).alias("ttml_us"), TM.vtt_time(vtt).alias("vtt_us"), TM.year_of(early, F.col("ts") + F.expr("interval 1 year")).cast("long").alias("year"), TM.iso_utc("ts").alias("run_at"))


def signature_text(spark, d):
    """Signatures as hexadecimal digits and back."""
    e = read(spark, d, "embeddings").select("vec_id", bits.average_hash("embedding").alias("sig"))
    box = F.array(*[F.col("vec_id") % F.lit(m) for m in (7, 11, 13, 17, 19, 23, 29, 31)])
    return e.select("vec_id", bits.to_hex("sig").alias("hex"), (bits.from_hex(bits.to_hex("sig")) == F.col("sig")).alias("same"), bits.from_hex(F.lit("xyz")).isNull().alias("refused"), bits.box_height(box).alias("height"))


def recognised_filter(spark, d):
    """Recognised lines: sure enough, of the script that is wanted, no reading aids."""
    e = read(spark, d, "events")
    k = F.col("event_id")
    text = F.when(k % 4 == 0, "よみ").when(k % 4 == 1, "山の本").when(k % 4 == 2, "latin").otherwise("カナ と")
    h = (F.when(k % 4 == 0, 10).otherwise(k % 21)).cast("int")
    words = F.array(F.struct(F.lit("a").alias("text"), F.when(k % 7 != 0, F.lit(0.3)).alias("confidence")), F.struct(F.lit("b").alias("text"), (k % 10 / 10).alias("confidence")))
    lines = e.select(F.col("user_id").alias("image"), "event_id", text.alias("text"), words.alias("words"), F.array(*[F.lit(0)] * 5, h, F.lit(0), h).alias("box"))
    return filters.recognised_lines(lines, "image", "text", "words", "box").select("image", "event_id", "text")


def catalogue_filters(spark, d):
    """Predicates on catalogue records: original audio, languages, tags, titles, edges, kinds, what still needs work."""
    c = read(spark, d, "customer")
    n = F.col("c_custkey")
    details = F.create_map(F.lit("JP"), F.struct(F.when(n % 2 == 0, F.array(F.lit("ja"))).otherwise(F.array(F.lit("en"))).alias("originalAudio")), F.lit("US"), F.struct(F.array(F.lit("ja"), F.lit("en")).alias("originalAudio")))
    languages = F.when(n % 3 != 0, F.array(F.lit("ja"), F.col("c_mktsegment")))
    chunks = F.when(n % 3 == 0, F.array(F.struct(F.lit("").alias("text")))).when(n % 3 == 1, F.array(F.struct(F.col("c_name").alias("text"))))
    edges = F.array(
        F.struct(F.lit("LIST").alias("type"), F.when(n % 2 == 0, F.lit("READY")).alias("status"), F.lit("TITLES").alias("listType"), F.when(n % 5 != 0, F.col("c_name")).alias("url")),
        F.struct(F.lit("LIST").alias("type"), F.lit("PENDING").alias("status"), F.lit("TITLES").alias("listType"), F.lit("u").alias("url")),
        F.struct(F.lit("LIST").alias("type"), F.lit("READY").alias("status"), F.when(n % 3 == 0, F.lit("PEOPLE")).otherwise(F.lit("TITLES")).alias("listType"), F.lit("v").alias("url")),
    )
    rows = c.withColumns({"tags": F.array(F.lower("c_mktsegment"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))), "wikidata": F.when(n % 4 == 0, F.lit("Q1")), "netflix": F.when(n % 2 == 0, n), "kind": F.when(n % 6 == 0, F.lit("SoundEffect")).when(n % 6 != 1, F.lit("Primary"))})
    tagged = filters.with_tags(rows, "customer#*" + "1?", ["building"], moniker="c_name").select("c_custkey", F.lit(True).alias("tagged"))
    named = filters.title_matches(rows, "R#0+1\\d*$", "c_name").select("c_custkey", F.lit(True).alias("titled"))
    alone = filters.title_matches(rows, "2$", "c_name", without=filters.title_matches(rows, "12$", "c_name"), key="c_custkey").select("c_custkey", F.lit(True).alias("alone"))
    flags = rows.select(
        "c_custkey", filters.original_audio(details, ["JP"], "ja").alias("audio_jp"), filters.original_audio(details, ["US", "JP"], "en").alias("audio_any"), filters.languages_wanted(languages, ["ja"]).alias("wanted"), filters.languages_wanted(languages, []).alias("unfiltered"),
        filters.needs_recognition(F.when(n % 4 != 0, F.col("c_name")), chunks).alias("needs_text"), F.array_join(F.transform(filters.export_edges(edges), lambda e: e["url"]), ",").alias("edges"), filters.primary(F.col("kind")).alias("counted"), filters.unresolved(F.col("netflix"), F.col("wikidata")).alias("open"),
    )
    out = flags.join(tagged, "c_custkey", "left").join(named, "c_custkey", "left").join(alone, "c_custkey", "left")
    return out.withColumns({k: F.coalesce(k, F.lit(False)) for k in ("tagged", "titled", "alone")})


def block_fields(spark, d):
    """Operations on blocks: mapping and dropping chunks, the only chunk, narrower records, overridden roles, a note in
    the last chunk, paths, nested records, counted leaves, scrubbed tokens, first filled fields."""
    c = read(spark, d, "conversations")
    per = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.md5("text").alias("text")))).alias("t"))
    none = F.lit(None).cast("map<string,string>")
    refs = F.transform("t", lambda x, i: x.withField("references", F.when(x["role"] == "user", F.create_map(F.lit("en"), x["text"])).otherwise(none)))
    dropped = folds.map_chunks("t", lambda x: F.when(x["role"] != "system", x.withField("role", F.coalesce(F.nullif(x["role"], F.lit("assistant")), F.lit("Primary")))))
    one = F.slice("t", F.lit(1), F.when(F.col("conv_id") % 2 == 0, 1).otherwise(0))
    marked = sequence.marked_last(refs, "time", F.lit("00:01"))
    tokens = F.transform("t", lambda x: F.struct(x["text"].alias("term"), x["turn"].alias("startOffset"), x["turn"].alias("endOffset"), F.lit(1).alias("positionIncrement"), F.lit(1).alias("positionLength")))
    block = F.struct(F.struct(F.col("conv_id").alias("name")).alias("image"), F.struct(F.size("t").alias("ordinal")).alias("source"), F.col("t").alias("chunks"))
    records = [F.struct(F.when(F.col("conv_id") % 3 == 0, "").otherwise("a").alias("title"), F.array(F.lit("x")).alias("tags")), F.struct(F.lit("b").alias("title"), F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("y"), F.lit("x"))).alias("tags"))]
    first = reshape.first_filled(records, ["title"])
    with_path = maps.with_path(F.struct(F.struct(F.lit(1).alias("b")).alias("a")), "a.b", F.size("t"))
    return per.select(
        "conv_id", F.size(dropped).cast("long").alias("kept"), F.array_join(F.transform(dropped, lambda x: x["role"]), ",").alias("roles"), folds.single(one)["text"].alias("only"),
        F.to_json(folds.base_record(block)).alias("base"), F.array_join(F.transform(marked, lambda x: F.array_join(F.array_sort(F.map_keys(x["references"])), "+")), ",", "-").alias("marks"), F.to_json(with_path).alias("path"), maps.read_path(F.to_json(with_path), "a.b").alias("read"),
        reshape.leaf_count(F.array(F.struct(F.col("t").alias("lines")), F.struct(F.slice("t", 1, 1).alias("lines"))), "lines").alias("leaves"), F.to_json(F.slice(reshape.without_offsets(tokens), 1, 1)).alias("tokens"), first["title"].alias("title"), F.array_join(first["tags"], ",").alias("tags"),
        F.to_json(F.transform(reshape.text_only(F.transform("t", lambda x: x.withField("tokens", F.lit(1)))), lambda x: x.dropFields("text"))).alias("subset"),
    )


def summaries(spark, d):
    """Counts of what an import did, a sample and all values of each group, ids in the order of their numbers."""
    o = read(spark, d, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "F", "added").when(F.col("o_orderstatus") == "O", "updated").otherwise("skipped"))
    counts = stats.summary(o, "o_orderpriority", "status", ["added", "updated", "skipped"])
    values = stats.samples(o, "o_orderpriority", "o_clerk" if "o_clerk" in o.columns else "o_orderstatus")
    ids = o.groupBy("o_orderpriority").agg(F.array_join(F.slice(sequence.by_number(F.collect_set((F.col("o_custkey") % 1200).cast("string"))), 1, 40), ",").alias("ids"))
    return counts.join(values, "o_orderpriority").join(ids, "o_orderpriority")


QUERIES = {
    f.__name__: f
    for f in (file_names, media_fields, language_lists, titles_and_ids, option_values, text_lines, transcript_lines, time_expressions, signature_text, recognised_filter, catalogue_filters, block_fields, summaries)
}

ORACLE = {
    "file_names": r"""WITH x AS (SELECT *, 'lib/' || p_brand || '/' || p_name || '.' || p_type || CASE WHEN p_partkey % 3 <> 0 THEN '.content.yaml' ELSE '.srt' END AS path, trim(regexp_replace(' ' || p_name || ': <' || p_type || '/>?" ', '[<>:"/\\|?*]', '_', 'g')) AS clean FROM part)
        SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_name || '.' || p_type END AS base, p_name AS bare, clean, CASE WHEN p_partkey % 4 = 0 THEN clean ELSE p_brand || '-' || clean END AS directory,
          CASE WHEN p_size % 2 = 0 THEN '-s' || p_size || 'e' || (p_partkey % 100) END AS episode, replace(url_encode(path || ' ~*+é&'), '%2F', '/') AS address,
          p_name || '-' || CASE WHEN p_partkey % 3 <> 0 THEN p_size::VARCHAR ELSE '' END || '-%other%' AS filled, sha256(path) AS sha256, md5(path) AS md5 FROM x""",
    "media_fields": r"""SELECT c_custkey, CASE WHEN c_custkey % 5 NOT IN (0, 1) THEN c_name || '.mp3' END AS sound, CASE WHEN c_custkey % 4 <> 0 THEN c_name || CASE WHEN c_custkey % 2 = 0 THEN '.png' ELSE '.jpg' END END AS image,
          c_mktsegment AS base, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey::VARCHAR END AS ref, c_custkey AS ordinal FROM customer""",
    "language_lists": """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'en,ja' WHEN 1 THEN 'en,es' WHEN 2 THEN 'en,pt' ELSE '' END AS "all", CASE c_custkey % 5 WHEN 0 THEN 'ja' WHEN 2 THEN 'pt' ELSE '' END AS original FROM customer""",
    "titles_and_ids": r"""SELECT c_custkey, CASE WHEN c_custkey % 4 IN (0, 1) THEN c_name END AS title, 'Q' || c_custkey AS entity, c_name AS visible, 'remove-all-' || lower(c_mktsegment) || '-text2-md' AS kebab, c_name || '  ' || chr(10) || c_mktsegment AS note,
          c_mktsegment || '_big_one' AS node, c_name || '[よみ] x[y] (z)' AS readings, CASE WHEN c_custkey % 3 = 1 THEN c_mktsegment || '|Other' END AS genres, c_custkey % 5 IN (0, 1, 3) AS is_word, c_custkey % 2 = 0 AS ideograph, c_name AS bare,
          c_custkey % 3 <> 1 AS blank FROM customer""",
    "option_values": r"""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'true' WHEN 1 THEN c_custkey::VARCHAR WHEN 2 THEN (c_custkey % 100) || '.5' WHEN 3 THEN '"a \"b\" ' || c_custkey || '"' ELSE 'false' END AS value FROM customer""",
    "text_lines": r"""WITH x AS (SELECT doc_id, text, regexp_split_to_array(text, '\r\n|\n|\r') AS l FROM documents), y AS (SELECT *, CASE WHEN l[-1] = '' THEN l[1:len(l) - 1] ELSE l END AS k FROM x)
        SELECT doc_id, len(k) AS n_lines, md5(array_to_string(k, '|')) AS lines_md5, md5(regexp_replace(regexp_replace('<i>' || coalesce(text, '') || '&lrm;</i>' || chr(8207), '<[^>]*>', '', 'g'), '&[lr]rm;|' || chr(8206) || '|' || chr(8207), '', 'g')) AS plain_md5 FROM y""",
    "transcript_lines": """SELECT conv_id, turn, 1::BIGINT AS part, 'Primary' AS kind, role AS actor, md5(text) || chr(10) || 'and on' AS text FROM conversations
        UNION ALL SELECT conv_id, turn, 2, 'SoundEffect', NULL, '（noise）' FROM conversations UNION ALL SELECT conv_id, turn, 3, 'Primary', NULL, 'turn ' || turn FROM conversations""",
    "time_expressions": """SELECT event_id, CASE event_id % 5 WHEN 0 THEN ((event_id % 24) * 3600 + (event_id % 60) * 60 + event_id % 59) * 1000000 + 500000 WHEN 1 THEN (event_id % 1000) * 1000000 + 250000 WHEN 2 THEN (event_id % 9999) * 1000 WHEN 3 THEN event_id END AS ttml_us,
          CASE WHEN event_id % 2 = 0 THEN ((event_id % 60) * 60 + event_id % 60) * 1000000 + (event_id % 1000) * 1000 END AS vtt_us, year(ts) + CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS year, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS run_at FROM events""",
    "signature_text": """WITH x AS (SELECT vec_id, embedding, list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))) / len(embedding) AS m FROM embeddings),
          y AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(CAST(v AS DOUBLE) >= m AS INTEGER)) AS b FROM x),
          z AS (SELECT vec_id, list_transform(range(16), lambda i: lower(to_hex(b[61 - 4 * i] + 2 * b[62 - 4 * i] + 4 * b[63 - 4 * i] + 8 * b[64 - 4 * i]))) AS h FROM y)
        SELECT vec_id, array_to_string(h, '') AS hex, true AS same, true AS refused, greatest(vec_id % 31 - vec_id % 11, vec_id % 23 - vec_id % 17) AS height FROM z""",
    "recognised_filter": """WITH x AS (SELECT user_id AS image, event_id, CASE event_id % 4 WHEN 0 THEN 'よみ' WHEN 1 THEN '山の本' WHEN 2 THEN 'latin' ELSE 'カナ と' END AS text, CASE WHEN event_id % 4 = 0 THEN 10 ELSE event_id % 21 END AS h FROM events WHERE event_id % 4 <> 2 AND (event_id % 7 = 0 OR event_id % 10 >= 5)),
          y AS (SELECT *, max(h) OVER (PARTITION BY image) AS top FROM x)
        SELECT image, event_id, text FROM y WHERE NOT (h <= 0.7 * top AND event_id % 4 <> 1)""",
    "catalogue_filters": r"""SELECT c_custkey, c_custkey % 2 = 0 AS audio_jp, true AS audio_any, c_custkey % 3 <> 0 AS wanted, true AS unfiltered, c_custkey % 4 <> 0 AND c_custkey % 3 <> 1 AS needs_text,
          concat_ws(',', CASE WHEN c_custkey % 5 <> 0 THEN c_name END, CASE WHEN c_custkey % 3 <> 0 THEN 'v' END) AS edges, c_custkey % 6 <> 0 AS counted, c_custkey % 2 = 0 AND c_custkey % 4 <> 0 AS open,
          c_mktsegment = 'BUILDING' AND regexp_matches(c_name, '1.$') AS tagged, regexp_matches(c_name, '(?i)R#0+1\d*$') AS titled, regexp_matches(c_name, '2$') AND NOT regexp_matches(c_name, '12$') AS alone FROM customer""",
    "block_fields": r"""WITH x AS (SELECT conv_id, turn, role, md5(text) AS text, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, md5(text)) AS i, bool_or(role = 'user') OVER (PARTITION BY conv_id) AS has_refs FROM conversations)
        SELECT conv_id, count(*) FILTER (role <> 'system') AS kept, coalesce(string_agg(CASE role WHEN 'assistant' THEN 'Primary' ELSE role END, ',' ORDER BY i) FILTER (role <> 'system'), '') AS roles, CASE WHEN conv_id % 2 = 0 THEN any_value(text) FILTER (i = 1) END AS only,
          '{"image":{"name":' || conv_id || '},"source":{"ordinal":' || any_value(n) || '}}' AS base, string_agg(CASE WHEN i = n AND has_refs THEN CASE WHEN role = 'user' THEN 'en+time' ELSE 'time' END WHEN role = 'user' THEN 'en' ELSE '-' END, ',' ORDER BY i) AS marks,
          '{"a":{"b":' || any_value(n) || '}}' AS path, any_value(n)::VARCHAR AS read, any_value(n) + 1 AS leaves, '[{"term":"' || any_value(text) FILTER (i = 1) || '"}]' AS tokens, CASE WHEN conv_id % 3 = 0 THEN 'b' ELSE 'a' END AS title, CASE WHEN conv_id % 2 = 0 THEN 'x,y' ELSE 'x' END AS tags,
          '[' || string_agg('{"role":"' || role || '"}', ',' ORDER BY i) || ']' AS subset FROM x GROUP BY conv_id""",
    "summaries": """WITH o AS (SELECT o_orderpriority, o_orderstatus, o_custkey % 1200 AS id FROM orders), i AS (SELECT DISTINCT o_orderpriority, id FROM o), r AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY id) <= 40),
          s AS (SELECT o_orderpriority, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM r GROUP BY 1)
        SELECT o_orderpriority, count(*) AS n_rows, count(*) FILTER (o_orderstatus = 'F') AS n_added, count(*) FILTER (o_orderstatus = 'O') AS n_updated, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS n_skipped,
          round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS percent_added, min(o_orderstatus) AS sample, string_agg(DISTINCT o_orderstatus, ', ' ORDER BY o_orderstatus) AS "values", any_value(ids) AS ids FROM o JOIN s USING (o_orderpriority) GROUP BY 1""",
}
