"""Line dedup: boilerplate is what many distinct sites repeat.

Lines that are frequent enough get a HyperLogLog sketch of their sites for each line hash: the sketches of a
task's lines merge before anything is shuffled. Only lines whose estimate is near the threshold are paired with
their sites, for an exact count; estimates beyond that band decide alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import BROADCAST_IDS, by_top, stored

MIN_SITES = 10
MIN_CHARS = 10
LG_K = 8
#: Relative width of the band of estimates that are counted exactly: four standard errors at LG_K.
BAND = 0.3


def _row(id_col: str, text_col: str) -> Column:
    """What tells the rows of one id apart, or those without an id: rows of the same text share it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.when(F.col(id_col).cast("long").isNull(), F.md5(text)).otherwise(F.hex(F.xxhash64(text)))


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_chars: int) -> DataFrame:
    """(line, pos, lead, site, doc, row): the hash of each trimmed line that is long enough, its place in the text, and
    whether the text has it for the first time there; a null site stays null."""
    hashes = F.transform(F.split(F.col(text_col), "\n"), lambda x: F.btrim(x, F.lit(" \t\r")))
    hashes = F.transform(hashes, lambda x, i: F.when(F.length(x) >= min_chars, F.struct(F.xxhash64(x).alias("line"), i.alias("pos"))))
    # Sorted by hash and place, a line comes first where the entry before is another; the array of one makes that array once.
    by_hash = F.array_sort(F.filter(hashes, lambda x: x.isNotNull()))
    led = F.transform(F.array(by_hash), lambda s: F.transform(s, lambda x, i: F.struct(x["line"].alias("line"), x["pos"].alias("pos"), F.coalesce(F.get(s, i - 1)["line"] != x["line"], F.lit(True)).alias("lead"))))
    site = F.when(F.col(site_col).isNotNull(), F.xxhash64(F.col(site_col)))
    # The row's key is made before the lines are exploded, so that no line carries its whole text along.
    keyed = docs.select(led[0].alias("__lines"), site.alias("site"), F.col(id_col).cast("long").alias("doc"), _row(id_col, text_col).alias("row"))
    return keyed.select(F.explode("__lines").alias("__line"), "site", "doc", "row").select("__line.*", "site", "doc", "row")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(line, n, first_doc) of stored lines (line, site, doc): those on ``min_sites`` distinct sites or more, how often each occurs, and the
    smallest id of its documents.

    No row of a line is shuffled by the line alone: what is, are partial counts and partial sketches, one for
    each task. Lines that occur fewer than ``min_sites`` times need no sketch, and only those near the threshold
    need pairs of line and site; either are chosen by broadcast. Were the chosen lines too many for that, all
    lines would get sketches, and the distinct pairs of all would be joined.
    """
    often = lines.groupBy("line").agg(F.count("*").alias("n"), F.min("doc").alias("first_doc"))
    often = stored(often.where(F.col("n") >= min_sites), "often")
    some = lines.join(F.broadcast(often.select("line")), "line", "left_semi") if often.count() <= BROADCAST_IDS else lines
    sketches = some.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"))
    spread = stored(often.join(sketches.where(F.col("sites") >= min_sites * (1 - BAND)), "line"), "line-spread")
    near = F.col("sites") <= min_sites * (1 + BAND)
    far, close = spread.where(~near).drop("sites"), spread.where(near).drop("sites")
    n_close = close.count()
    if not n_close:
        return far
    pairs = lines.where("site is not null").select("line", "site")
    few = n_close <= BROADCAST_IDS
    pairs = pairs.join(F.broadcast(close.select("line")), "line", "left_semi").distinct() if few else pairs.distinct().join(close.select("line"), "line", "left_semi")
    exact = pairs.groupBy("line").agg(F.count("*").alias("exact")).where(F.col("exact") >= min_sites)
    return far.unionByName(close.join(exact.select("line"), "line", "left_semi"))


def without_boilerplate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS
) -> DataFrame:
    """The input's columns with such lines taken out of the text, and n_lines and n_removed; columns of
    these names are replaced. Of each boilerplate line one occurrence stays: the first in the document
    of the smallest id.

    Lines end at \\n and are compared without spaces, tabs and \\r at their ends; shorter ones than
    ``min_chars`` are never removed. Null texts stay null, with 0 lines; empty ones have one line.
    Null sites don't count as a site, rows with a null id keep no first occurrence and so lose every such line, and
    rows that repeat an id share its first occurrences. An empty table stays empty.
    """
    # Hashes of lines are a small part of the texts: texts are taken apart once, and all counts read these.
    lines = stored(_lines(docs, id_col, text_col, site_col, min_chars), "lines")
    bad = stored(boilerplate(lines, min_sites), "boilerplate")
    hits = by_top(lines.select("line", "pos", "lead", "doc", "row"), bad, ["line"], "n")
    stays = F.col("lead") & F.coalesce(F.col("doc") == F.col("first_doc"), F.lit(False))
    # Places to take out, in order. Rows without an id stand apart by their key. Rows of one id and text give the same places.
    per_doc = hits.where(~stays).groupBy(F.coalesce("doc", F.lit(0)).alias("__doc"), F.col("row").alias("__key")).agg(F.array_sort(F.collect_set("pos")).alias("__gone"))
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    others = [c for c in kept if c != text_col]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("__row") if others else F.lit(0).alias("__row"), F.col(text_col).alias("__text"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("__doc"), _row(id_col, text_col).alias("__key"))
    joined = rows.join(per_doc, ["__doc", "__key"], "left").withColumn("__lines", F.split("__text", "\n"))
    # The marks of all lines come from the places by their distances, so that the work is linear in a text's lines; a last
    # one, behind the text, is taken away with those of lines that go.
    before = F.concat(F.array(F.lit(-1)), F.col("__gone"))
    after = F.concat(F.col("__gone"), F.array(F.size("__lines")))
    marks = F.flatten(F.zip_with(before, after, lambda a, b: F.concat(F.array_repeat(F.lit(False), b - a - 1), F.array(F.lit(True)))))
    left = F.filter(F.arrays_zip(F.col("__lines").alias("line"), marks.alias("gone")), lambda p: ~p["gone"])
    text = F.when(F.col("__gone").isNotNull(), F.array_join(F.transform(left, lambda p: p["line"]), "\n")).otherwise(F.col("__text"))
    out = [(text if c == text_col else F.col("__row").getField(c)).alias(c) for c in kept]
    count = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    return joined.select(*out, count("__lines").alias("n_lines"), F.when(F.col("__gone").isNotNull(), count("__gone")).otherwise(F.lit(0).cast("long")).alias("n_removed"))


ORACLE = f"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL
), t AS (SELECT doc_id, source, pos, raw, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM l
), bad AS (
  SELECT line, min(doc_id) AS first_doc FROM t WHERE length(line) >= {MIN_CHARS} GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}
), firsts AS (SELECT t.line, t.doc_id, min(pos) AS pos FROM t JOIN bad ON t.line = bad.line AND t.doc_id = bad.first_doc GROUP BY ALL
), marked AS (
  SELECT t.doc_id, t.pos, t.raw, bad.line IS NOT NULL AND NOT coalesce(f.pos = t.pos, false) AS gone
  FROM t LEFT JOIN bad ON t.line = bad.line LEFT JOIN firsts f ON f.line = t.line AND f.doc_id = t.doc_id
)
SELECT d.doc_id, coalesce(count(m.pos), 0) AS n_lines, count(*) FILTER (m.gone) AS n_removed,
       sha256(coalesce(string_agg(m.raw, chr(10) ORDER BY m.pos) FILTER (NOT m.gone), '')) AS text_sha256
FROM documents d LEFT JOIN marked m ON m.doc_id = d.doc_id GROUP BY d.doc_id
"""
