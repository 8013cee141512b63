"""Queries over timed streams: alignment, cues, sections, statistics of time."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import time as TM
from lectern.operators import intervals, sequence, stats
from lectern.operators.intervals import Timed
from lectern.operators.resolve import first_by_priority
from lectern.plans.tables import EVENTS_SQL, HOUR, timed_events

#: Width of the time buckets that spread one user's intervals over many join keys.
BUCKET = 6 * HOUR


def interval_best_match(spark, d):
    hit = intervals.best_match(timed_events(spark, d, "purchase"), timed_events(spark, d, "view"), bucket_us=BUCKET)
    return hit.select(F.col("a_file").alias("user_id"), F.col("a_pos").alias("event_id"), F.col("b_pos").alias("ref_id"), F.round(F.try_divide("shared", F.col("a_e") - F.col("a_s")), 6).alias("ratio"))


_PAIRS = """
p1 AS (
  SELECT a.file, a.pos AS ap, b.pos AS bp, a.s AS a_s, a.e AS a_e, b.s AS b_s, b.e AS b_e, least(a.e, b.e) - greatest(a.s, b.s) AS shared
  FROM (SELECT * FROM ev WHERE event_type = 'purchase') a JOIN (SELECT * FROM ev WHERE event_type = 'view') b ON a.file = b.file AND a.s < b.e AND b.s < a.e
), win1 AS (
  SELECT * FROM p1 WHERE shared * 10 > (a_e - a_s) * 3 QUALIFY row_number() OVER (PARTITION BY file, ap ORDER BY shared DESC, b_s, b_e, bp) = 1
)"""
_ALIGN = (
    _PAIRS
    + """, win2 AS (
  SELECT * FROM p1 WHERE shared * 10 > (b_e - b_s) * 3 AND (file, bp) NOT IN (SELECT file, bp FROM win1)
  QUALIFY row_number() OVER (PARTITION BY file, bp ORDER BY shared DESC, a_s, a_e, ap) = 1
), links AS (SELECT file, ap, bp FROM win1 UNION ALL SELECT file, ap, bp FROM win2),
al AS (
  SELECT a.file, a.pos AS in_pos, l.bp AS ref_pos, a.s AS g_s, a.e AS g_e FROM ev a LEFT JOIN links l ON l.file = a.file AND l.ap = a.pos WHERE a.event_type = 'purchase'
  UNION ALL
  SELECT b.file, NULL, b.pos, b.s, b.e FROM ev b WHERE b.event_type = 'view' AND (b.file, b.pos) NOT IN (SELECT file, bp FROM links)
)"""
)


def _aligned(spark, d):
    return intervals.align(timed_events(spark, d, "purchase"), timed_events(spark, d, "view"), bucket_us=BUCKET)


def interval_outer_align(spark, d):
    return _aligned(spark, d).select(F.col("file").alias("user_id"), "in_pos", "ref_pos", "g_s", "g_e")


def interval_merged_blocks(spark, d):
    return intervals.merged_refs(_aligned(spark, d), timed_events(spark, d, "view")).select(F.col("file").alias("user_id"), "in_pos", "lone_pos", "n_refs", "ref_start", "ref_end", "ref_text")


def timed_stats(spark, d):
    e = timed_events(spark, d).withColumn("n_tokens", F.greatest(F.round(F.col("value") / 10), F.lit(0)).cast("long"))
    timed = F.col("event_type") != "signup"
    e = e.withColumns({"start_us": F.when(timed, F.col("start_us")), "end_us": F.when(timed, F.col("end_us")), "proper": (F.col("event_type") == "purchase").cast("long")})
    out = stats.timed_statistics(e, "file", proper="proper")
    return out.select(F.col("file").alias("user_id"), "tokens", "timed_tokens", "duration_us", F.round("median_us_per_token", 4).alias("median_us"), F.round("mean_us_per_token", 4).alias("mean_us"), "proper_nouns")


def bucketed_files(spark, d):
    e = timed_events(spark, d)
    return sequence.sections(e, ["file"], ["start_us", "pos"], "event_type", 2).select(F.col("file").alias("user_id"), F.col("pos").alias("event_id"), F.col("section").cast("long").alias("section"), F.col("in_section").cast("long").alias("in_section"), "file_no")


def repeat_suppression(spark, d):
    e = timed_events(spark, d)
    return sequence.suppress_repeats(e, ["file"], ["start_us", "pos"], F.nullif(F.col("event_type"), F.lit("error"))).select(F.col("file").alias("user_id"), F.col("pos").alias("event_id"), "hidden")


def monotonic_check(spark, d):
    return sequence.out_of_order(timed_events(spark, d), ["file"], ["pos"], "end_us").select(F.col("file").alias("user_id"), "out_of_order", "n_late")


def priority_dedupe(spark, d):
    e = timed_events(spark, d)
    rank = (F.get_json_object("props", "$.k").cast("int") > 50).cast("int") * 2 + (F.col("event_type") != "view").cast("int")
    return first_by_priority(e, ["file", "event_type"], rank, "pos").select(F.col("file").alias("user_id"), "event_type", F.col("pos").alias("event_id"))


def heading_coalesce(spark, d):
    e = timed_events(spark, d)
    k = F.get_json_object("props", "$.k").cast("int")
    note = F.when(k % 3 == 0, F.concat(F.lit("note "), k.cast("string")))
    resource = F.when(k % 3 == 1, F.col("event_type"))
    return e.select(F.col("pos").alias("event_id"), F.coalesce(note, resource, TM.format_clock(F.col("start_us") - 1_700_000_000_000_000)).alias("heading"))


def timecode_roundtrip(spark, d):
    e = timed_events(spark, d)
    shown = TM.format_vtt(F.col("end_us") - F.col("start_us"))
    return e.select(F.col("pos").alias("event_id"), shown.alias("shown"), TM.vtt_time(shown).alias("read_us"), TM.ttml_time(F.concat((F.col("value")).cast("decimal(18,2)").cast("string"), F.lit("s"))).alias("offset_us"))


def cue_coalesce(spark, d):
    e = timed_events(spark, d)
    own = F.when(F.col("event_type") == "view", F.col("text"))
    ref = F.when(F.col("event_type").isin("purchase", "click"), F.col("text"))
    rows = e.select("file", "pos", "start_us", "end_us", own.alias("text"), ref.alias("ref_text"), F.col("start_us").alias("ref_start_us"), F.col("end_us").alias("ref_end_us"))
    return intervals.cues_of_blocks(rows, extend_us=250_000).select(F.col("pos").alias("event_id"), "cue_text", "cue_start", "cue_end")


def merge_same_text(spark, d):
    e = timed_events(spark, d)
    return intervals.merge_same_text(e, Timed(), "event_type", gap_us=HOUR).select(F.col("file").alias("user_id"), F.col("pos").alias("first_id"), "event_type", "start_us", "end_us", "n_cues")


def json_flatten(spark, d):
    e = timed_events(spark, d)
    return e.select(F.col("pos").alias("event_id"), F.from_json("props", "k int")["k"].alias("k"), "event_type").select("event_id", "k", F.explode(F.array("event_type", F.concat(F.lit("k"), F.col("k").cast("string")))).alias("label"))


QUERIES = {
    f.__name__: f
    for f in (interval_best_match, interval_outer_align, interval_merged_blocks, timed_stats, bucketed_files, repeat_suppression, monotonic_check, priority_dedupe, heading_coalesce, timecode_roundtrip, cue_coalesce, merge_same_text, json_flatten)
}

_CLOCK = "printf('%02d:%02d:%02d', x // 3600, (x // 60) % 60, x % 60)"
ORACLE = {
    "interval_best_match": f"WITH {EVENTS_SQL}, {_PAIRS} SELECT file AS user_id, ap AS event_id, bp AS ref_id, round(shared / (a_e - a_s), 6) AS ratio FROM win1",
    "interval_outer_align": f"WITH {EVENTS_SQL}, {_ALIGN} SELECT file AS user_id, in_pos, ref_pos, g_s, g_e FROM al",
    "interval_merged_blocks": f"""WITH {EVENTS_SQL}, {_ALIGN}
        SELECT al.file AS user_id, in_pos, CASE WHEN in_pos IS NULL THEN ref_pos END AS lone_pos, count(r.pos) AS n_refs,
               first(r.s ORDER BY r.s, r.e, r.pos) AS ref_start, last(r.e ORDER BY r.s, r.e, r.pos) AS ref_end, string_agg(r.text, chr(10) || chr(10) ORDER BY r.s, r.e, r.pos) AS ref_text
        FROM al LEFT JOIN ev r ON r.file = al.file AND r.pos = al.ref_pos GROUP BY ALL""",
    "timed_stats": f"""WITH {EVENTS_SQL}, b AS (
          SELECT file, CASE WHEN event_type <> 'signup' THEN s END AS s, CASE WHEN event_type <> 'signup' THEN e END AS e, CAST(greatest(round(value / 10), 0) AS BIGINT) AS n, CAST(event_type = 'purchase' AS BIGINT) AS p FROM ev
        ), g AS (SELECT file, s, e, sum(n) AS n, sum(p) AS p FROM b WHERE n > 0 GROUP BY ALL)
        SELECT file AS user_id, CAST(sum(n) AS BIGINT) AS tokens, CAST(coalesce(sum(n) FILTER (s IS NOT NULL), 0) AS BIGINT) AS timed_tokens, CAST(coalesce(sum(e - s), 0) AS BIGINT) AS duration_us,
               round(quantile_cont((e - s) / n, 0.5) FILTER (s IS NOT NULL), 4) AS median_us, round(coalesce(sum(e - s), 0) / nullif(sum(n) FILTER (s IS NOT NULL), 0), 4) AS mean_us, CAST(sum(p) AS BIGINT) AS proper_nouns
        FROM g GROUP BY file""",
    "bucketed_files": f"""WITH {EVENTS_SQL}, x AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND lag(1) OVER w IS NOT NULL THEN 0 ELSE 1 END AS n FROM ev WINDOW w AS (PARTITION BY file ORDER BY s, pos)),
        y AS (SELECT *, CAST(sum(n) OVER (PARTITION BY file ORDER BY s, pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section FROM x),
        z AS (SELECT *, row_number() OVER (PARTITION BY file, section ORDER BY s, pos) AS in_section FROM y)
        SELECT file AS user_id, pos AS event_id, section, in_section, (in_section - 1) // 2 + 1 AS file_no FROM z""",
    "repeat_suppression": f"""WITH {EVENTS_SQL} SELECT file AS user_id, pos AS event_id, coalesce(nullif(event_type, 'error') = lag(nullif(event_type, 'error')) OVER (PARTITION BY file ORDER BY s, pos), false) AS hidden FROM ev""",
    "monotonic_check": f"""WITH {EVENTS_SQL}, x AS (SELECT file, e < lag(e) OVER (PARTITION BY file ORDER BY pos) AS late FROM ev)
        SELECT file AS user_id, coalesce(bool_or(late), false) AS out_of_order, count(*) FILTER (late) AS n_late FROM x GROUP BY file""",
    "priority_dedupe": f"""WITH {EVENTS_SQL} SELECT file AS user_id, event_type, pos AS event_id FROM ev
        QUALIFY row_number() OVER (PARTITION BY file, event_type ORDER BY CAST(CAST(json_extract(props, '$.k') AS INTEGER) > 50 AS INTEGER) * 2 + CAST(event_type <> 'view' AS INTEGER) DESC, pos) = 1""",
    "heading_coalesce": f"""WITH {EVENTS_SQL}, x AS (SELECT pos, event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k, (s - 1700000000000000) // 1000000 AS x FROM ev)
        SELECT pos AS event_id, CASE WHEN k % 3 = 0 THEN 'note ' || k WHEN k % 3 = 1 THEN event_type ELSE {_CLOCK} END AS heading FROM x""",
    "timecode_roundtrip": f"""WITH {EVENTS_SQL}, x AS (SELECT pos, value, e - s AS us, (e - s) // 1000000 AS x FROM ev)
        SELECT pos AS event_id, {_CLOCK} || '.' || printf('%03d', (us // 1000) % 1000) AS shown, us // 1000 * 1000 AS read_us, CAST(CAST(value AS DECIMAL(18,2)) * 1000000 AS BIGINT) AS offset_us FROM x""",
    "cue_coalesce": f"""WITH {EVENTS_SQL} SELECT pos AS event_id, text AS cue_text, CASE WHEN event_type = 'view' THEN s ELSE (s + e) // 2 END AS cue_start,
        CASE WHEN event_type = 'view' THEN e + 250000 ELSE least(e, (s + e) // 2 + 100000) END AS cue_end FROM ev WHERE event_type IN ('view', 'purchase', 'click')""",
    "merge_same_text": f"""WITH {EVENTS_SQL}, x AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND s - lag(e) OVER w <= {HOUR} THEN 0 ELSE 1 END AS n FROM ev WINDOW w AS (PARTITION BY file ORDER BY s, e, pos)),
        y AS (SELECT *, sum(n) OVER (PARTITION BY file ORDER BY s, e, pos ROWS UNBOUNDED PRECEDING) AS g FROM x)
        SELECT file AS user_id, min(pos) AS first_id, min(event_type) AS event_type, min(s) AS start_us, max(e) AS end_us, count(*) AS n_cues FROM y GROUP BY file, g""",
    "json_flatten": f"""WITH {EVENTS_SQL} SELECT pos AS event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, unnest([event_type, 'k' || CAST(json_extract(props, '$.k') AS INTEGER)]) AS label FROM ev""",
}
