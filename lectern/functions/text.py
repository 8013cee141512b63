"""Scalar text functions as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Unicode ranges of the scripts that the filters tell apart.
KANA = r"ぁ-ゖゝ-ゟァ-ヺー-ヿㇰ-ㇿｦ-ﾟ"
KANJI = r"一-鿿㐀-䶿"
#: Characters that stand in other scripts' texts too, as shapes.
KANA_LOOKALIKES = "ロ"
KANJI_LOOKALIKES = "口入人日"
#: What lies below all these ranges. One comparison a character tells it, a class of many ranges takes one for each; and a run is one match.
_BELOW = r"[\x00-\x{2FFF}]++"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank(x: Column | str) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(F.trim(F.regexp_replace(_c(x), r"(?U)\s+", " ")) == "", F.lit(True))


def null_marker(x: Column | str, marker: str = r"\N") -> Column:
    """The text, or null where it is empty or the marker of a missing value."""
    return F.nullif(F.nullif(_c(x), F.lit(marker)), F.lit(""))


def title_key(x: Column | str) -> Column:
    """A title for comparison: lower-case letters and digits, every other run one space; null if missing."""
    return F.trim(F.regexp_replace(F.lower(null_marker(x)), r"[^\p{L}\p{Nd}]+", " "))


def slug(x: Column | str, fallback: Column | str | None = None) -> Column:
    """ASCII kebab case; the fallback where nothing is left."""
    body = F.regexp_replace(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]+", "-"), "^-|-$", "")
    return body if fallback is None else F.coalesce(F.nullif(body, F.lit("")), _c(fallback))


_RUBY = r"(?U) ?(\w+)\[(\w+)\]"


def ruby(x: Column | str, mode: str = "html") -> Column:
    """Readings in brackets after a word: left as they are (none), as ruby elements (html, blur_html), or
    removed (remove). The base is the whole run of word characters before the bracket."""
    out = {"none": None, "html": "<ruby>$1<rt>$2</rt></ruby>", "blur_html": '<ruby>$1<rt class="blurText">$2</rt></ruby>', "remove": "$1"}[mode]
    return _c(x) if out is None else F.regexp_replace(_c(x), _RUBY, out)


def combined(texts: Column | str, separator: str = "\n\n") -> Column:
    """The texts of an array that are not blank, joined."""
    return F.array_join(F.filter(_c(texts), lambda t: ~blank(t)), separator)


def hard_breaks(x: Column | str) -> Column:
    """Line ends as Markdown line breaks."""
    return F.regexp_replace(_c(x), r"\r?\n", "  \n")


def base_name(path: Column | str, suffix: str = ".content.yaml") -> Column:
    """The file's name without the suffix; null if it doesn't end in it."""
    return F.nullif(F.regexp_extract(_c(path), r"([^/\\]+)" + suffix.replace(".", r"\.") + "$", 1), F.lit(""))


def without_extensions(path: Column | str) -> Column:
    return F.regexp_replace(F.regexp_extract(_c(path), r"([^/\\]*)$", 1), r"(?<=.)\..*$", "")


def clean_file_name(x: Column | str) -> Column:
    """Characters that file systems refuse become underscores."""
    return F.trim(F.regexp_replace(_c(x), r'[<>:"/\\|?*\x00-\x1F]', "_"))


def volume_directory(moniker: Column | str, title: Column | str) -> Column:
    return F.concat_ws("-", F.nullif(_c(moniker), F.lit("")), clean_file_name(title))


def _infix(x: Column | str, pattern: str, what: str) -> Column:
    found = F.regexp_extract(_c(x), pattern, 1)
    return F.when(_c(x).isNull() | (_c(x) == ""), None).when(found != "", found).otherwise(F.raise_error(F.concat(F.lit(f"malformed {what}: "), _c(x))).cast("string"))


def sound_file(x: Column | str) -> Column:
    """The file of ``[sound:file]``; null if empty, an error if malformed."""
    return _infix(x, r"^\[sound:(.+)\]$", "audio")


def image_file(x: Column | str) -> Column:
    """The file of an ``<img src=...>`` tag; null if empty, an error if malformed."""
    return _infix(x, r"""^<img src=['"](.+)['"]\s*/?>$""", "image")


def media_key(x: Column | str) -> Column:
    """``base|ordinal`` or ``base|ref|ordinal`` as a struct (base, ref, ordinal)."""
    p = F.split(_c(x), r"\|")
    return F.struct(p[0].alias("base"), F.when(F.size(p) >= 3, F.get(p, F.lit(1))).alias("ref"), F.element_at(p, -1).cast("int").alias("ordinal"))


def uri_escaped(x: Column | str) -> Column:
    """Percent-encoding that leaves the unreserved characters and the slash."""
    out = F.url_encode(_c(x))
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def film_qualifier(x: Column | str) -> Column:
    """``-s01e02`` of an episode's file name, lower-cased; null without one."""
    found = F.regexp_extract(_c(x), r"(?i)(s\d{1,4}e\d{1,4})", 1)
    return F.when(found != "", F.concat(F.lit("-"), F.lower(found)))


def language_codes(x: Column | str, codes: dict[str, str], original_only: bool = False) -> Column:
    """Codes of a comma-separated list of track names, distinct and sorted. Notes in brackets and the audio
    description mark are dropped; a name that isn't known loses leading words until it is."""
    table = F.create_map(*[F.lit(y) for pair in sorted(codes.items()) for y in pair])
    parts = F.filter(F.transform(F.split(F.coalesce(_c(x), F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")
    if original_only:
        parts = F.filter(parts, lambda p: p.contains("[Original]"))
    plain = lambda p: F.trim(F.lower(F.regexp_replace(F.regexp_replace(p, r" - Audio Description|\[Original\]", ""), r"\([^)]*\)", "")))
    tails = lambda p: F.transform(F.sequence(F.lit(1), F.size(F.split(p, " +"))), lambda i: F.array_join(F.slice(F.split(p, " +"), i, F.size(F.split(p, " +"))), " "))
    code = lambda p: F.get(F.filter(F.transform(tails(plain(p)), lambda t: F.try_element_at(table, t)), lambda c: c.isNotNull()), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(F.transform(parts, code), lambda c: c.isNotNull())))


def without_zero_width(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(x), r"[﻿​‌‍]", ""))


def entity_id(uri: Column | str) -> Column:
    return F.regexp_replace(_c(uri), r"^.*/entity/", "")


def display_title(titles: Column | str) -> Column:
    """The English title, else the first of the others by language that isn't empty, else null."""
    m = _c(titles)
    others = F.filter(F.transform(F.array_sort(F.map_entries(m)), lambda e: e["value"]), lambda v: F.coalesce(v, F.lit("")) != "")
    return F.coalesce(F.nullif(F.try_element_at(m, F.lit("en")), F.lit("")), F.get(others, F.lit(0)))


def is_word_char(x: Column | str) -> Column:
    return _c(x).rlike(r"^[\p{L}\p{Nd}\p{Mn}\p{Pc}]$")


def has_japanese(x: Column | str) -> Column:
    """Any character of the blocks Hiragana, Katakana and CJK Unified Ideographs."""
    return F.coalesce(_c(x).rlike(r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]"), F.lit(False))


def upper_count(x: Column | str) -> Column:
    """Upper-case letters of all scripts; null if the text is missing."""
    return F.length(F.regexp_replace(_c(x), r"[^\p{Lu}]++", ""))


def has_ideograph(x: Column | str) -> Column:
    return F.coalesce(_c(x).rlike(f"[{KANJI}]"), F.lit(False))


def kebab(x: Column | str) -> Column:
    """Pascal case to kebab case."""
    return F.lower(F.regexp_replace(_c(x), r"(?<=[a-z0-9])(?=[A-Z])", "-"))


def coerced(x: Column | str) -> Column:
    """A JSON text of the narrowest type that an option's text reads as: boolean, long, double, string."""
    c = _c(x)
    return F.coalesce(
        F.when(F.lower(c).isin("true", "false"), F.lower(c)), F.when(c.rlike(r"^\s*[+-]?\d+\s*$"), c.try_cast("long").cast("string")), c.try_cast("double").cast("string"), F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    )


def lines(x: Column | str) -> Column:
    """Lines by any line end, without an empty one at the end."""
    parts = F.split(_c(x), r"\r\n|\n|\r")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def note_text(x: Column | str) -> Column:
    """Parts between ideographic spaces, each on a line."""
    return F.replace(_c(x), F.lit("　"), F.lit("  \n"))


def html_text(x: Column | str) -> Column:
    """Text of a fragment of HTML: no comments, no tags, the five basic entities decoded."""
    out = F.regexp_replace(F.regexp_replace(_c(x), r"(?s)<!--.*?-->", ""), r"<[^>]*>", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(out)


def without_suffix_notes(x: Column | str) -> Column:
    """Without ``(cf. ...)`` and ``(via ...)`` notes."""
    return F.trim(F.regexp_replace(_c(x), r"\s*\((?:cf\.|via) [^)]*\)", ""))


def node_id(name: Column | str) -> Column:
    """The first of several names, without brackets, spaces as underscores."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.split(_c(name), "[,;]")[0], "[()]", "")), " +", "_")


def parenthetical_ruby(x: Column | str) -> Column:
    """A reading in ASCII or full-width parentheses after a word character becomes a bracketed one."""
    return F.regexp_replace(_c(x), r"(?U)(?<=\w)[(（](\w+)[)）]", "[$1]")


def split_list(x: Column | str) -> Column:
    """A comma-separated list; null if missing."""
    return F.transform(F.split(null_marker(x), ","), lambda p: F.trim(p))


def substituted(template: Column | str, values: dict[str, Column], mark: str = "%{}%") -> Column:
    """Each ``%name%`` replaced by its value."""
    out = _c(template)
    for name, value in values.items():
        out = F.replace(out, F.lit(mark.format(name)), F.coalesce(value, F.lit("")))
    return out


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Characters in their compatible form, full-width letters and digits as plain ones."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def natural_key(x: Column | str, digits: int = 10) -> Column:
    """A key under which runs of digits sort by their value: each is padded with zeros to ``digits``. Names of
    full-width digits are to be put through ``nfkc`` before."""
    parts = F.regexp_extract_all(_c(x), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, F.greatest(F.lit(digits), F.length(p)), F.lit("0"))).otherwise(p)), "")


def kana_count(x: Column | str, without: str = "") -> Column:
    kept = F.regexp_replace(F.coalesce(_c(x), F.lit("")), f"{_BELOW}|[^{KANA}]++", "")
    return F.length(F.regexp_replace(kept, f"[{without}]", "") if without else kept)


def kanji_count(x: Column | str, without: str = "") -> Column:
    kept = F.regexp_replace(F.coalesce(_c(x), F.lit("")), f"{_BELOW}|[^{KANJI}]++", "")
    return F.length(F.regexp_replace(kept, f"[{without}]", "") if without else kept)


def is_japanese_text(x: Column | str) -> Column:
    """Kana or kanji beyond the shapes that other scripts' texts hold by chance."""
    kana, sure = kana_count(x), kana_count(x, KANA_LOOKALIKES)
    return (sure > 1) | ((sure > 0) & (kana > 1)) | (kanji_count(x, KANJI_LOOKALIKES) > 0)
