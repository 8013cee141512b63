"""Blocks as Markdown and HTML, by column expressions; whole files by an ordered aggregate."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from lectern.functions import text as T
from lectern.functions.time import format_clock
from lectern.operators import sequence
from lectern.sources import inline


@dataclass(frozen=True)
class Style:
    """How blocks are shown. references: quote, footnotes or blur; labels: none, first, all, or several, that is
    all where a chunk has more than one reference."""

    headings: bool = True
    ruby: str = "none"
    references: str = "quote"
    labels: str = "none"
    keep_together: bool = False
    image_prefix: str = "images"
    audio_prefix: str = "audio"
    tight_breaks: bool = False


def heading(note: Column, resource: Column, start: Column, ref_start: Column) -> Column:
    """Note, else resource, else the block's time, else its first reference's."""
    return F.coalesce(note, resource, format_clock(start), format_clock(ref_start))


def image_line(name: Column, prefix: str) -> Column:
    return F.when(name.isNotNull(), F.concat(F.lit(f"![]({prefix}/"), T.uri_escaped(name), F.lit(")")))


def audio_line(name: Column, prefix: str) -> Column:
    return F.when(name.isNotNull(), F.concat(F.lit(f'<audio controls src="{prefix}/'), T.uri_escaped(name), F.lit('"></audio>')))


def reference_text(refs: Column, style: Style, note_id: Column) -> Column:
    """A chunk's references (a map of name to text) in the style, by name. Blank ones are left out."""
    items = F.filter(F.array_sort(F.map_entries(refs)), lambda e: ~T.blank(e["value"]))
    label = lambda e, first: F.when(F.lit(style.labels == "all") | (F.lit(style.labels == "several") & (F.size(refs) > 1)) | (F.lit(style.labels == "first") & first), F.concat(e["key"], F.lit(": "))).otherwise("")
    body = lambda e: F.regexp_replace(e["value"], r"\n{2,}", "  \n  \n") if style.tight_breaks else e["value"]
    if style.references == "footnotes":
        shown = F.transform(items, lambda e, i: F.concat(label(e, i == 0), F.regexp_replace(body(e), "\n", "\n    ")))
        joined = F.array_join(shown, "\n\n    ")
        return F.when(F.size(items) > 0, F.concat(F.lit("[^"), note_id, F.lit("]: "), joined))
    if style.references == "blur":
        shown = F.transform(items, lambda e, i: blurred(e["value"], F.concat_ws("-", note_id, F.lit("ref"), e["key"]), "blurText", F.rtrim(label(e, i == 0))))
        return F.when(F.size(items) > 0, F.array_join(shown, "\n\n"))
    quoted = F.lit(style.labels in ("first", "all")) | (F.lit(style.labels == "several") & (F.size(refs) > 1))
    quote = F.when(quoted, "> ").otherwise("")
    shown = F.transform(items, lambda e, i: F.concat(quote, label(e, i == 0), F.replace(body(e), F.lit("\n"), F.concat(F.lit("\n"), quote))))
    return F.when(F.size(items) > 0, F.array_join(shown, "\n\n"))


def html_of(x: Column) -> Column:
    """Markdown as HTML, as far as texts of captions have it: paragraphs, strong, emphasis, code, links, hard breaks."""
    body = _escaped(x)
    for pattern, tag in ((r"\*\*(.+?)\*\*", "strong"), (r"__(.+?)__", "strong"), (r"\*(.+?)\*", "em"), (r"(?<!\w)_(.+?)_(?!\w)", "em"), (r"`(.+?)`", "code")):
        body = F.regexp_replace(body, pattern, f"<{tag}>$1</{tag}>")
    body = F.regexp_replace(body, r"\[([^\]]+)\]\(([^)\s]+)\)", '<a href="$2">$1</a>')
    body = F.regexp_replace(body, r" {2,}\n|\\\n", "<br />\n")
    parts = F.filter(F.split(F.regexp_replace(body, r"^\n+|\n+$", ""), r"\n\s*\n"), lambda p: F.trim(p) != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.lit("<p>"), p, F.lit("</p>"))), "\n")


def blurred(x: Column, id_: Column, style: str, label: Column) -> Column:
    """A text as HTML that a tap on its checkbox shows: each paragraph for itself, as a span after a label."""
    tag = F.when(label != "", "span").otherwise("p")
    begin = F.concat(F.lit("<"), tag, F.lit(f" class='{style}'><input type='checkbox' id='"), id_, F.lit("'/><label for='"), id_, F.lit("'>"))
    end = F.concat(F.lit("</label></"), tag, F.lit(">"))
    inner = F.replace(F.replace(html_of(x), F.lit("<p>"), begin), F.lit("</p>"), end)
    return F.when(label != "", F.concat(F.lit("<p><span>"), label, F.lit("</span> "), inner, F.lit("</p>"))).otherwise(inner)


def _escaped(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def render(blocks: DataFrame, style: Style = Style()) -> DataFrame:
    """(file, pos, markdown) from flat blocks: file, pos, note, resource, start_us, ref_start_us, image,
    image_group, audio, and chunks, an array of (text, references: map of name to text).

    A block whose image, or its group, is the one before's shows neither heading nor image again.
    Without audio a rule ends the block.
    """
    rows = sequence.suppress_repeats(blocks, ["file"], ["pos"], F.coalesce("image_group", "image"), "__again")
    rows = sequence.ordinals(rows, ["file"], ["pos"], "__n")
    title = F.concat(F.lit("## "), heading(F.col("note"), F.col("resource"), F.col("start_us"), F.col("ref_start_us"))) if style.headings else F.lit(None).cast("string")
    block_id = F.concat_ws("-", "file", F.col("__n").cast("string"))
    note_id = lambda i: F.when(F.size("chunks") > 1, F.concat_ws("-", block_id, (i + 1).cast("string"))).otherwise(block_id)
    mark = lambda c, i: F.when(F.lit(style.references == "footnotes") & (F.size(F.filter(F.map_values(c["references"]), lambda v: ~T.blank(v))) > 0), F.concat(F.lit("[^"), note_id(i), F.lit("]"))).otherwise("")
    chunk = lambda c, i: F.array_join(F.array(F.nullif(F.concat(T.ruby(F.coalesce(c["text"], F.lit("")), style.ruby), mark(c, i)), F.lit("")), reference_text(c["references"], style, note_id(i))), "\n\n")
    shown = F.filter(F.transform("chunks", chunk), lambda t: t != "")
    again = F.col("__again")
    parts = F.array(
        F.lit("::: {.keep-together}" if style.keep_together else None).cast("string"),
        F.when(~again, title),
        F.when(~again, image_line(F.col("image"), style.image_prefix)),
        F.when(F.size(shown) > 0, F.array_join(shown, "\n\n")),
        F.coalesce(audio_line(F.col("audio"), style.audio_prefix), F.lit("---")),
        F.lit(":::" if style.keep_together else None).cast("string"),
    )
    return rows.select("file", "pos", F.array_join(parts, "\n\n").alias("markdown"))


def combined_file(files: DataFrame, name: str) -> DataFrame:
    """All files, in the order of their names, as one."""
    one = files.agg(F.array_sort(F.collect_list(F.struct("file", "content"))).alias("f"))
    return one.select(F.lit(name).alias("file"), F.array_join(F.transform("f", lambda x: x["content"]), "\n").alias("content"))


def markdown_files(blocks: DataFrame, style: Style = Style(), most: int = 10_000) -> DataFrame:
    """(file, content): each file's blocks under its name; an error beyond ``most`` blocks."""
    rows = sequence.capped(render(blocks, style), ["file"], ["pos"], most)
    one = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("pos", "markdown"))).alias("b"))
    return one.select("file", F.concat(F.lit("# "), F.col("file"), F.lit("\n\n"), F.array_join(F.transform("b", lambda x: x["markdown"]), "\n\n"), F.lit("\n")).alias("content"))


def to_html(text: str) -> str:
    """Markdown as HTML; an empty text stays empty."""
    return inline.shown(text)[1]


def to_plain(text: str) -> str:
    """The text of Markdown without its marks, each block on its own lines; a line end closes it."""
    return inline.shown(text)[0] or "\n"


@F.pandas_udf(StringType())
def markdown_to_html(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else to_html(t))


@F.pandas_udf(StringType())
def markdown_to_plain(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else to_plain(t))


@F.pandas_udf(StructType().add("plain", StringType()).add("html", StringType()))
def markdown_to_both(texts: pd.Series) -> pd.DataFrame:
    """Plain text and HTML of Markdown that is parsed once."""

    def both(t: str | None) -> tuple:
        if t is None:
            return None, None
        plain, page = inline.shown(t)
        return plain or "\n", page

    return pd.DataFrame(texts.map(both).tolist(), columns=["plain", "html"], dtype=object)


def paragraphs(texts: DataFrame, file: str, content: str) -> DataFrame:
    """(file, pos, text): the paragraphs of Markdown files, as blocks."""
    parts = F.filter(F.split(content, r"\r?\n\s*\r?\n"), lambda p: F.trim(p) != "")
    return texts.select(F.col(file).alias("file"), F.posexplode(parts).alias("pos", "text"))


def templated(rows: DataFrame, template, schema: str = "content string") -> DataFrame:
    """Each file's rows rendered by a Python callable ``template(file, rows) -> text``."""
    names = rows.columns

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values("pos")
        return pd.DataFrame({"file": [f["file"].iloc[0]], "content": [template(f["file"].iloc[0], f[names].to_dict("records"))]})

    return rows.groupBy("file").applyInPandas(run, "file string, " + schema)
