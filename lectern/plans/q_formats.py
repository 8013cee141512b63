"""Queries over caption, YAML and Markdown files: codecs and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import folds
from lectern.plans.tables import EVENTS_SQL, read, timed_events
from lectern.sources import blocks, captions, markdown

_STYLES = '<head><styling><style xml:id="r" tts:ruby="container"/><style xml:id="t" tts:ruby="text"/></styling></head>'


def _caption_texts(spark, d, kind, head, cue, tail, between):
    """Each user's events as the text of one file, in order."""
    e = timed_events(spark, d).select(F.concat(F.col("file").cast("string"), F.lit(f".{kind}")).alias("file"), "pos", cue.alias("cue"))
    one = e.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("pos", "cue"))).alias("c"))
    return one.select("file", F.concat(F.lit(head), F.array_join(F.transform("c", lambda x: x["cue"]), between), F.lit(tail)).alias("content"))


def vtt_parse(spark, d):
    """All events as cues of WebVTT files with notes, styles, settings, ruby and tags, parsed."""
    clock = lambda s: F.format_string("%02d:%02d:%02d.%03d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60, F.lit(250))
    cue = F.concat("pos", F.lit("\n"), clock(F.col("pos")), F.lit(" --> "), clock(F.col("pos") + 2), F.lit(" align:start\nこれは<ruby>音<rt>おと</rt></ruby>です\n<i>"), "event_type", F.lit("</i> "), "pos")
    return captions.cues_of(_caption_texts(spark, d, "vtt", "WEBVTT\n\nNOTE a note\n\nSTYLE\n::cue { color: red }\n\n", cue, "\n", "\n\n"))


def ttml_parse(spark, d):
    """All events as paragraphs of TTML files with breaks and ruby by styles, parsed."""
    cue = F.concat(F.lit('<p begin="'), "pos", F.lit('s" end="'), F.col("pos") * 1000 + 1500, F.lit('ms">'), "event_type", F.lit('<br/>x<span style="r">音<span style="t">おと</span></span> '), "pos", F.lit("</p>"))
    return captions.cues_of(_caption_texts(spark, d, "ttml", f'<tt xmlns="http://www.w3.org/ns/ttml" xmlns:tts="http://www.w3.org/ns/ttml#styling">{_STYLES}<body><div>', cue, "</div></body></tt>", ""))


def caption_export(spark, d):
    """SubRip files of all events, one for each user, and how many cues they hold when read again."""
    e = timed_events(spark, d)
    files = captions.caption_files(e.where("start_us < end_us").withColumn("file", F.concat(F.col("file").cast("string"), F.lit(".srt"))), "file", "srt", "event_type", "start_us", "end_us")
    return captions.cues_of(files).groupBy("file").agg(F.count("*").alias("n_cues"), F.min("markdown").alias("first_text"))


def yaml_roundtrip(spark, d):
    """All events as YAML blocks, written and parsed again: how many blocks each user's file has, and a digest of
    the JSON of the blocks that were read, in order."""
    e = timed_events(spark, d)
    block = F.struct(F.col("pos").cast("string").alias("id"), F.struct(F.struct(F.lit("00:00:01.000").alias("start"), F.lit("00:00:02.000").alias("end")).alias("timecodes"), F.col("event_type").alias("note")).alias("source"), F.array(F.struct(F.col("text"))).alias("chunks"))
    files = blocks.yaml_files(e.select(F.col("file").cast("string").alias("file"), "pos", block.alias("block")))
    read = blocks.parsed_yaml(files, blocks.BLOCK, "block")
    one = read.groupBy("file").agg(F.count("*").alias("n_docs"), F.array_sort(F.collect_list(F.struct("pos", F.to_json("block").alias("json")))).alias("b"))
    return one.select("file", "n_docs", F.md5(F.array_join(F.transform("b", lambda x: x["json"]), "\n")).alias("md5"))


def markdown_export(spark, d):
    e = timed_events(spark, d)
    refs = F.create_map(F.lit("en"), F.when(F.col("event_type") != "click", F.concat(F.lit("ref "), F.col("event_type"))))
    rows = e.select(
        F.col("file").cast("string").alias("file"), "pos", F.when(F.col("event_type") == "error", F.lit("note")).alias("note"), F.lit(None).cast("string").alias("resource"), F.col("start_us"), F.lit(None).cast("long").alias("ref_start_us"),
        F.when(F.col("event_type") == "view", F.lit("a b.jpg")).alias("image"), F.lit(None).cast("string").alias("image_group"), F.when(F.col("event_type") == "purchase", F.lit("s.mp3")).alias("audio"), F.array(F.struct("text", refs.alias("references"))).alias("chunks"),
    )
    files = markdown.markdown_files(rows, markdown.Style(references="footnotes"))
    return files.select("file", F.length("content").cast("long").alias("n_chars"), F.md5("content").alias("md5"))


def low_confidence_fold(spark, d):
    """Texts of all events, each of two spans with their confidence, without what isn't sure."""
    e = read(spark, d, "events").select("event_id", "event_type", F.col("event_id").cast("string").alias("no"))
    sure = lambda k: (F.col("event_id") % k) / 10.0 + 0.05
    spans = F.array(F.struct(F.col("event_type").alias("text"), sure(10).alias("confidence")), F.struct(F.col("no").alias("text"), sure(7).alias("confidence")))
    return e.select("event_id", folds.confident_text(F.concat_ws(" ", "event_type", "no"), spans, 0.5).alias("cleaned"))


def japanese_filter(spark, d):
    """Names of all parts, some between Japanese words: which count as Japanese text, and their ruby as HTML."""
    k = F.col("p_partkey")
    text = F.when(k % 6 == 0, "").when(k % 6 == 1, F.concat(F.lit("やま"), "p_name")).when(k % 6 == 2, F.col("p_name")).when(k % 6 == 3, F.concat(F.lit("森[もり]の"), "p_name")).when(k % 6 == 4, "ロ")
    df = read(spark, d, "part").select("p_partkey", text.alias("text"))
    return df.select("p_partkey", T.is_japanese_text("text").alias("kept"), T.ruby("text").alias("ruby"))


QUERIES = {f.__name__: f for f in (vtt_parse, ttml_parse, caption_export, yaml_roundtrip, markdown_export, low_confidence_fold, japanese_filter)}
ORACLE = {
    "vtt_parse": """SELECT user_id || '.vtt' AS file, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS ordinal, event_id::VARCHAR AS id, event_id * 1000000 + 250000 AS start_us, event_id * 1000000 + 2250000 AS end_us, 'align:start' AS settings,
        'これは<ruby>音<rt>おと</rt></ruby>です' || chr(10) || '<i>' || event_type || '</i> ' || event_id AS raw, 'これは 音[おと]です  ' || chr(10) || event_type || ' ' || event_id AS markdown FROM events""",
    "ttml_parse": """SELECT user_id || '.ttml' AS file, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS ordinal, NULL::VARCHAR AS id, event_id * 1000000 AS start_us, event_id * 1000000 + 1500000 AS end_us, NULL::VARCHAR AS settings,
        event_type || chr(10) || 'x<ruby>音<rt>おと</rt></ruby> ' || event_id AS raw, event_type || '  ' || chr(10) || 'x 音[おと] ' || event_id AS markdown FROM events""",
    "caption_export": """SELECT user_id || '.srt' AS file, count(*) AS n_cues, min(event_type) AS first_text FROM events WHERE round(value * 600) >= 1 GROUP BY user_id""",
    "yaml_roundtrip": """WITH b AS (SELECT user_id, event_id, '{"id":"' || event_id || '","source":{"timecodes":{"start":"00:00:01.000","end":"00:00:02.000"},"note":"' || event_type || '"},"chunks":[{"text":"' || event_type || ' ' || event_id || '"}]}' AS j FROM events)
        SELECT user_id::VARCHAR AS file, count(*) AS n_docs, md5(string_agg(j, chr(10) ORDER BY event_id)) AS md5 FROM b GROUP BY 1""",
    "markdown_export": f"""WITH {EVENTS_SQL}, n AS (SELECT *, file || '-' || row_number() OVER w AS id, event_type = 'view' AND coalesce(lag(event_type) OVER w = 'view', false) AS again FROM ev WINDOW w AS (PARTITION BY file ORDER BY pos)),
        m AS (SELECT file, pos, concat_ws(chr(10) || chr(10), CASE WHEN NOT again THEN '## ' || CASE event_type WHEN 'error' THEN 'note' ELSE printf('%02d:%02d:%02d', s // 3600000000, s // 60000000 % 60, s // 1000000 % 60) END END,
          CASE WHEN event_type = 'view' AND NOT again THEN '![](images/a%20b.jpg)' END, CASE event_type WHEN 'click' THEN text ELSE text || '[^' || id || ']' END, CASE WHEN event_type <> 'click' THEN '[^' || id || ']: ref ' || event_type END,
          CASE event_type WHEN 'purchase' THEN '<audio controls src="audio/s.mp3"></audio>' ELSE '---' END) AS t FROM n),
        f AS (SELECT file::VARCHAR AS file, '# ' || file || chr(10) || chr(10) || string_agg(t, chr(10) || chr(10) ORDER BY pos) || chr(10) AS c FROM m GROUP BY m.file)
        SELECT file, length(c) AS n_chars, md5(c) AS md5 FROM f""",
    "low_confidence_fold": "SELECT event_id, CASE WHEN event_id % 10 >= 5 THEN event_type || ' ' || event_id WHEN event_id % 7 >= 5 THEN event_id::VARCHAR END AS cleaned FROM events",
    "japanese_filter": """SELECT p_partkey, p_partkey % 6 IN (1, 3) AS kept, CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'やま' || p_name WHEN 2 THEN p_name WHEN 3 THEN '<ruby>森<rt>もり</rt></ruby>の' || p_name WHEN 4 THEN 'ロ' END AS ruby FROM part""",
}
