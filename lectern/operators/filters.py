"""Row and array filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.bits import box_height
from lectern.functions.text import blank, kana_count, kanji_count

#: The title types that candidates may have, best first.
TITLE_TYPES = ["movie", "tvSeries", "tvMiniSeries", "tvMovie", "tvSpecial", "short", "tvShort", "video"]


def cleaned_cues(cues: DataFrame, text: str = "text", start: str = "start_us", end: str = "end_us") -> DataFrame:
    """Cues without override blocks in braces; those that end before they start, and those of no or one
    character, are dropped. Ordinals are given before."""
    out = cues.withColumn(text, F.trim(F.regexp_replace(F.col(text), r"\{.*?\}", "")))
    return out.where((F.col(start) <= F.col(end)) & ~blank(text) & (F.length(text) > 1))


def without_markup(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", ""), "&[lr]rm;|[‎‏]", "")


def original_audio(details: Column, countries: list[str], language: str) -> Column:
    """Whether in some of the countries the language is among the original audio tracks."""
    at = F.map_filter(details, lambda k, _: k.isin(countries))
    return F.exists(F.map_values(at), lambda v: F.array_contains(v["originalAudio"], language))


def languages_wanted(languages: Column, wanted: list[str]) -> Column:
    """Any language in common; an empty wish list lets everything pass, a missing language nothing."""
    return F.lit(True) if not wanted else F.coalesce(F.arrays_overlap(languages, F.array(*map(F.lit, wanted))), F.lit(False))


def needs_recognition(image: Column, chunks: Column) -> Column:
    return image.isNotNull() & ~F.exists(F.coalesce(chunks, F.array().cast("array<struct<text:string>>")), lambda c: F.coalesce(c["text"], F.lit("")) != "")


def recognised_lines(lines: DataFrame, image: str, text: str, words: str, box: str) -> DataFrame:
    """Lines of recognised text without noise: some word is sure enough (a word without confidence is), the
    text has kana or kanji, and it isn't a reading aid: kana only, and at most 0.7 of the highest line."""
    sure = F.exists(words, lambda w: F.coalesce(w["confidence"] >= 0.5, F.lit(True)))
    script = (kana_count(text) > 0) | (kanji_count(text) > 0)
    kept = lines.where(sure & script).withColumn("__h", box_height(box))
    top = F.max("__h").over(Window.partitionBy(image))
    aid = (F.col("__h") <= 0.7 * F.col("__top")) & (kana_count(text) > 0) & (F.length(F.regexp_replace(text, r"[\p{IsHiragana}\p{IsKatakana}ー\s\p{P}]", "")) == 0)
    return kept.withColumn("__top", top).where(~aid).drop("__h", "__top")


def with_tags(volumes: DataFrame, pattern: str | None = None, tags: list[str] = (), moniker: str = "moniker", tag_col: str = "tags") -> DataFrame:
    """Volumes whose moniker fits a wildcard pattern and that have all the tags."""
    out = volumes
    if pattern:
        out = out.where(F.col(moniker).ilike(pattern.replace("%", r"\%").replace("_", r"\_").replace("*", "%").replace("?", "_")))
    for t in tags:
        out = out.where(F.array_contains(tag_col, t))
    return out


def title_matches(titles: DataFrame, pattern: str, title: str = "title", without: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Titles that fit a pattern in any case, but for those whose key is in ``without``."""
    found = titles.where(F.col(title).rlike("(?i)" + pattern))
    return found if without is None else found.join(without.select(key), key, "left_anti")


def primary(kind: Column) -> Column:
    """Content that counts: of the primary kind, which is the one that isn't named."""
    return F.coalesce(kind, F.lit("Primary")) == "Primary"


def unresolved(catalogue_id: Column, entity: Column) -> Column:
    """In the catalogue, but without an entity yet."""
    return catalogue_id.isNotNull() & entity.isNull()


def export_edges(edges: Column) -> Column:
    """Edges of lists of titles that are ready and have an address."""
    return F.filter(edges, lambda e: (e["type"] == "LIST") & (F.coalesce(e["status"], F.lit("READY")) == "READY") & (e["listType"] == "TITLES") & e["url"].isNotNull())


def candidates(works: DataFrame, kind: str, ja_aka: str, ja_original: str) -> DataFrame:
    return works.where(F.col(kind).isin(TITLE_TYPES) & (F.coalesce(F.col(ja_aka), F.lit(False)) | F.coalesce(F.col(ja_original), F.lit(False))))
