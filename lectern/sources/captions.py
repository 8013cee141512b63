"""Caption formats: WebVTT, TTML, SubRip and ASS, read into cues and written from them."""

from __future__ import annotations

import html
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CUE_SCHEMA = "file string, ordinal int, id string, start_us bigint, end_us bigint, settings string, raw string, markdown string"


class CaptionError(ValueError):
    """A file that breaks its format."""


@dataclass
class Node:
    """An element of a cue's text: a tag with children, or text (tag is empty)."""

    tag: str = ""
    text: str = ""
    classes: list[str] = field(default_factory=list)
    annotation: str = ""
    children: list[Node] = field(default_factory=list)


@dataclass
class Cue:
    start_us: int
    end_us: int
    text: str
    id: str = ""
    settings: dict[str, str] = field(default_factory=dict)
    nodes: list[Node] | None = None


@dataclass
class Document:
    cues: list[Cue] = field(default_factory=list)
    styles: list[str] = field(default_factory=list)
    regions: list[dict[str, str]] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)


# WebVTT --------------------------------------------------------------------------------------------

_TIME = re.compile(r"(?:(\d{2,}):)?([0-5]\d):([0-5]\d)\.(\d{3})")
_ARROW = re.compile(r"^\s*(\S+)\s+-->\s+(\S+)(?:\s+(.*))?$")
#: Cue settings and the form of their values.
_SETTINGS = {
    "vertical": r"rl|lr",
    "line": r"(?:-?\d+|\d+(?:\.\d+)?%)(?:,(?:start|center|end))?",
    "position": r"\d+(?:\.\d+)?%(?:,(?:line-left|center|line-right))?",
    "size": r"\d+(?:\.\d+)?%",
    "align": r"start|center|end|left|right",
    "region": r"\S+",
}
_REGION = {"id": r"\S+", "width": r"\d+(?:\.\d+)?%", "lines": r"\d+", "regionanchor": r"\S+%,\S+%", "viewportanchor": r"\S+%,\S+%", "scroll": r"up"}
#: The tags of cue text.
_TAGS = {"b", "i", "u", "c", "v", "lang", "ruby", "rt"}


def vtt_us(text: str) -> int:
    m = _TIME.fullmatch(text)
    if not m:
        raise CaptionError(f"malformed time {text!r}")
    return ((int(m[1] or 0) * 60 + int(m[2])) * 60 + int(m[3])) * 1_000_000 + int(m[4]) * 1000


def _pairs(text: str, sep: str, known: dict[str, str]) -> dict[str, str]:
    """Settings of known names; one with a malformed value is an error, unknown ones are left out."""
    out = {}
    for part in text.split():
        name, _, value = part.partition(sep)
        if name in known:
            if not re.fullmatch(known[name], value):
                raise CaptionError(f"malformed setting {part!r}")
            out[name] = value
    return out


def parse_vtt(text: str) -> Document:
    """A WebVTT file. Styles and regions must come before the first cue; a cue may not end before it starts."""
    body = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n").replace("\0", "�")
    first, _, rest = body.partition("\n")
    if first[:6] != "WEBVTT" or (len(first) > 6 and first[6] not in " \t"):
        raise CaptionError("no WEBVTT signature")
    header, blank, rest = ("", "", rest[1:]) if rest.startswith("\n") else rest.partition("\n\n")
    doc = Document()
    for block in re.split(r"\n{2,}", rest.strip("\n")) if rest.strip("\n") else []:
        lines = block.split("\n")
        head = lines[0].strip()
        if head == "NOTE" or head.startswith(("NOTE ", "NOTE\t")):
            doc.notes.append("\n".join([head[4:].strip(), *lines[1:]]).strip("\n"))
        elif head in ("STYLE", "REGION") and not any("-->" in x for x in lines[:2]):
            if doc.cues:
                raise CaptionError(f"{head} after the first cue")
            if head == "STYLE":
                doc.styles.append("\n".join(lines[1:]))
            else:
                doc.regions.append(_pairs(" ".join(lines[1:]), ":", _REGION))
        else:
            at = 0 if "-->" in lines[0] else 1
            if len(lines) <= at or not (m := _ARROW.match(lines[at])):
                raise CaptionError(f"no cue time in {head!r}")
            start, end = vtt_us(m[1]), vtt_us(m[2])
            if end < start:
                raise CaptionError(f"cue {head!r} ends before it starts")
            raw = "\n".join(lines[at + 1 :])
            doc.cues.append(Cue(start, end, raw, lines[0] if at else "", _pairs(m[3] or "", ":", _SETTINGS), parse_spans(raw)))
    return doc


_TOKEN = re.compile(r"<(/?)([^<>]*)>|([^<]+)|<")
_OPEN = re.compile(r"(\w+)((?:\.[^\s.]+)*)(?:\s+(.*))?", re.S)


def parse_spans(text: str) -> list[Node] | None:
    """The tree of a cue's text; null if its markup is broken. A tag that isn't closed reaches to the end;
    a timestamp is a node of its own."""
    root = Node("root")
    stack = [root]
    for m in _TOKEN.finditer(text):
        if m[3] is not None:
            stack[-1].children.append(Node(text=html.unescape(m[3])))
        elif m[2] is None:
            return None
        elif not m[1] and _TIME.fullmatch(m[2]):
            stack[-1].children.append(Node("time", m[2]))
        elif m[1]:
            name = m[2].strip().split(".")[0]
            if len(stack) == 1:
                return None
            if stack[-1].tag == "rt" and name == "ruby":
                stack.pop()
            if stack[-1].tag != name and name:
                return None
            stack.pop()
        else:
            tag = _OPEN.fullmatch(m[2])
            if not tag or tag[1] not in _TAGS or (tag[1] == "rt" and stack[-1].tag not in ("ruby", "rt")):
                return None
            if tag[1] == "rt" and stack[-1].tag == "rt":
                stack.pop()
            node = Node(tag[1], classes=[c for c in tag[2].split(".") if c], annotation=html.unescape(" ".join((tag[3] or "").split())))
            stack[-1].children.append(node)
            stack.append(node)
    return root.children


def spans_markdown(nodes: list[Node] | None) -> str | None:
    """Cue text as Markdown: ruby as ``base[reading]`` (with a space before it after a word character),
    lines with hard breaks, other tags unwrapped. Ruby of several lines or of other than word characters
    is an error."""
    if nodes is None:
        return None
    out: list[str] = []

    def plain(items: list[Node]) -> str:
        return "".join(x.text if not x.tag else plain(x.children) for x in items if x.tag != "time")

    def word(text: str) -> str:
        if "\n" in text:
            raise CaptionError("line break inside ruby")
        text = re.sub(r"\s", "", text)
        if not re.fullmatch(r"\w+", text):
            raise CaptionError(f"ruby of other than word characters: {text!r}")
        return text

    def visit(items: list[Node]) -> None:
        for x in items:
            if not x.tag:
                out.append(x.text.replace("\n", "  \n"))
            elif x.tag == "ruby":
                base: list[Node] = []
                for part in x.children:
                    if part.tag == "rt":
                        before = "".join(out)[-1:]
                        lead = " " if re.fullmatch(r"\w", before or " ") else ""
                        out.append(f"{lead}{word(plain(base))}[{word(plain(part.children))}]")
                        base = []
                    else:
                        base.append(part)
                out.append(plain(base))
            elif x.tag != "time":
                visit(x.children)

    visit(nodes)
    return "".join(out)


def vtt_clock(us: int) -> str:
    ms = us // 1000
    return f"{ms // 3_600_000:02d}:{ms // 60_000 % 60:02d}:{ms // 1000 % 60:02d}.{ms % 1000:03d}"


def write_vtt(doc: Document) -> str:
    """The text of a file: regions and styles, then the cues by start and end. Cues must last, and neither
    ids nor texts may hold what would end them."""
    parts = ["WEBVTT"]
    parts += ["REGION\n" + "\n".join(f"{k}:{v}" for k, v in r.items()) for r in doc.regions]
    parts += [f"STYLE\n{s}" for s in doc.styles]
    for c in sorted(doc.cues, key=lambda c: (c.start_us, c.end_us)):
        if c.end_us <= c.start_us:
            raise CaptionError("a cue must end after it starts")
        if "-->" in c.text or "-->" in c.id or "\n\n" in c.text or "\n" in c.id:
            raise CaptionError("a cue holds an arrow or a blank line")
        time = " ".join([f"{vtt_clock(c.start_us)} --> {vtt_clock(c.end_us)}", *[f"{k}:{v}" for k, v in c.settings.items()]])
        parts.append("\n".join(([c.id] if c.id else []) + [time] + ([c.text] if c.text else [])))
    return "\n\n".join(parts) + "\n"


# TTML ----------------------------------------------------------------------------------------------

_OFFSET = re.compile(r"(\d+(?:\.\d+)?)(h|ms|m|s|t|f)")
_CLOCK = re.compile(r"(?:(\d+)\.)?(\d{1,2}):(\d{2}):(\d{2})(?:\.(\d{1,7}))?")
_UNIT = {"h": 3_600_000_000, "m": 60_000_000, "s": 1_000_000, "ms": 1000, "t": 0.1}


def ttml_us(text: str) -> int:
    if m := _CLOCK.fullmatch(text.strip()):
        return ((int(m[1] or 0) * 24 + int(m[2])) * 3600 + int(m[3]) * 60 + int(m[4])) * 1_000_000 + int((m[5] or "0").ljust(7, "0")) // 10
    if m := _OFFSET.fullmatch(text.strip()):
        if m[2] == "f":
            raise CaptionError("times in frames are not supported")
        return int(float(m[1]) * _UNIT[m[2]])
    raise CaptionError(f"malformed time {text!r}")


def _local(name: str) -> str:
    return name.rpartition("}")[2]


def _attr(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if _local(k) == name), None)


def parse_ttml(text: str) -> Document:
    """A TTML file's paragraphs as cues. Styles with a ruby kind make ruby of the spans that use them: of a
    container its base, unwrapped, and its text."""
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        raise CaptionError(f"not XML: {e}") from e
    kinds = {_attr(s, "id"): _attr(s, "ruby") for s in root.iter() if _local(s.tag) == "style"}

    def spans(e: ET.Element) -> list[Node]:
        out = [Node(text=_folded(e.text))] if e.text else []
        for child in e:
            name = _local(child.tag)
            if name == "br":
                out.append(Node(text="\n"))
            elif name == "span":
                kind = _attr(child, "ruby") or kinds.get(_attr(child, "style"))
                inner = spans(child)
                if kind == "container":
                    out.append(Node("ruby", children=inner))
                elif kind == "text":
                    out.append(Node("rt", children=inner))
                else:
                    out.extend(inner)
            if child.tail:
                out.append(Node(text=_folded(child.tail)))
        return out

    doc = Document()
    for p in root.iter():
        if _local(p.tag) == "p" and (begin := _attr(p, "begin")):
            start = ttml_us(begin)
            end = ttml_us(e) if (e := _attr(p, "end")) else start + ttml_us(_attr(p, "dur") or "0s")
            nodes = spans(p)
            doc.cues.append(Cue(start, end, spans_vtt(nodes), _attr(p, "id") or "", {}, nodes))
    return doc


def _folded(text: str) -> str:
    return re.sub(r"[ \t\r\n]+", " ", text)


def spans_vtt(nodes: list[Node]) -> str:
    """Cue text with its markup."""
    out = []
    for x in nodes:
        if not x.tag:
            out.append(html.escape(x.text, quote=False).strip(" ") if x.text.strip() == "" and "\n" not in x.text else html.escape(x.text, quote=False))
        elif x.tag == "time":
            out.append(f"<{x.text}>")
        else:
            name = ".".join([x.tag, *x.classes]) + (f" {html.escape(x.annotation, quote=False)}" if x.annotation else "")
            out.append(f"<{name}>{spans_vtt(x.children)}</{x.tag}>")
    return "".join(out)


# SubRip and ASS ------------------------------------------------------------------------------------

_SRT_TIME = re.compile(r"(\d+):(\d{2}):(\d{2})[,.](\d{1,3})\s*-->\s*(\d+):(\d{2}):(\d{2})[,.](\d{1,3})")


def parse_srt(text: str) -> Document:
    doc = Document()
    for block in re.split(r"\n\s*\n", text.removeprefix("﻿").replace("\r\n", "\n").strip()):
        lines = block.split("\n")
        at = next((k for k, x in enumerate(lines[:2]) if _SRT_TIME.search(x)), None)
        if at is None:
            continue
        g = _SRT_TIME.search(lines[at]).groups()
        us = [((int(g[k]) * 60 + int(g[k + 1])) * 60 + int(g[k + 2])) * 1_000_000 + int(g[k + 3].ljust(3, "0")) * 1000 for k in (0, 4)]
        body = "\n".join(lines[at + 1 :])
        doc.cues.append(Cue(us[0], us[1], body, lines[0] if at else "", {}, [Node(text=body)]))
    return doc


def write_srt(cues: list[tuple[int, int, str]]) -> str:
    """Numbered paragraphs from (start, end, text), in the order given."""
    clock = lambda us: vtt_clock(us).replace(".", ",")
    return "\n".join(f"{n}\n{clock(a)} --> {clock(b)}\n{t}\n" for n, (a, b, t) in enumerate(cues, 1))


def parse_ass(text: str) -> Document:
    """The dialogue lines of an ASS or SSA file."""
    doc, names = Document(), None
    section = ""
    for line in text.removeprefix("﻿").splitlines():
        if line.startswith("["):
            section = line.strip().lower()
        elif section == "[events]" and line.lower().startswith("format:"):
            names = [x.strip().lower() for x in line.partition(":")[2].split(",")]
        elif section == "[events]" and line.startswith("Dialogue:") and names:
            row = dict(zip(names, line.partition(":")[2].split(",", len(names) - 1), strict=False))
            us = []
            for key in ("start", "end"):
                h, m, s = row[key].strip().split(":")
                us.append((int(h) * 60 + int(m)) * 60_000_000 + round(float(s) * 1_000_000))
            body = re.sub(r"\\[Nn]", "\n", row["text"]).replace(r"\h", " ")
            doc.cues.append(Cue(us[0], us[1], body, "", {}, [Node(text=body)]))
    return doc


PARSERS = {"vtt": parse_vtt, "ttml": parse_ttml, "dfxp": parse_ttml, "xml": parse_ttml, "srt": parse_srt, "ass": parse_ass}
EXTENSIONS = tuple(PARSERS)


def cue_rows(file: str, text: str) -> list[tuple]:
    """Rows of CUE_SCHEMA. Ordinals count all cues, before any filter."""
    kind = file.rpartition(".")[2].lower()
    doc = PARSERS[kind](text)
    rows = []
    for n, c in enumerate(doc.cues, 1):
        shown = c.text.replace("\n", "  \n") if kind in ("srt", "ass") else spans_markdown(c.nodes)
        rows.append((file, n, c.id or None, c.start_us, c.end_us, " ".join(f"{k}:{v}" for k, v in c.settings.items()) or None, c.text, shown))
    return rows


def cues_of(texts: DataFrame, file: str = "file", text: str = "content") -> DataFrame:
    """Cues of caption files held in a table. A file is parsed by one task; an error names it."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        names = [x.split()[0] for x in CUE_SCHEMA.split(", ")]
        for batch in batches:
            for name, body in zip(*batch.columns, strict=True):  # one file's text at a time
                try:
                    rows = cue_rows(name.as_py(), body.as_py() or "")
                except CaptionError as e:
                    raise CaptionError(f"{name}: {e}") from e
                cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return texts.select(F.col(file).alias("file"), F.col(text).alias("content")).mapInArrow(parse, CUE_SCHEMA)


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    """Cues of all caption files below ``path``."""
    glob = "*.{" + ",".join(EXTENSIONS) + "}"
    raw = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    return cues_of(raw.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("content")))


def webvtt_files(texts: DataFrame) -> DataFrame:
    """(file, content) of TTML files as WebVTT files, ruby kept; an error names the file."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, out = batch.column(0).to_pylist(), []
            for name, body in zip(names, batch.column(1).to_pylist(), strict=True):
                try:
                    out.append(write_vtt(parse_ttml(body or "")))
                except CaptionError as e:
                    raise CaptionError(f"{name}: {e}") from e
            yield pa.record_batch([pa.array([re.sub(r"\.[^.]*$", "", n) + ".vtt" for n in names], pa.string()), pa.array(out, pa.string())], names=["file", "content"])

    return texts.select("file", "content").mapInArrow(convert, "file string, content string")


def caption_files(cues: DataFrame, file: str = "file", kind: str = "srt", text: str = "cue_text", start: str = "cue_start", end: str = "cue_end") -> DataFrame:
    """(file, content): caption files from cues, renumbered by start and end."""
    rows = cues.select(F.col(file).alias("file"), F.struct(F.col(start).alias("s"), F.col(end).alias("e"), F.col(text).alias("t")).alias("c")).groupBy("file").agg(F.array_sort(F.collect_list("c")).alias("c"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for items in batch.column(1).to_pylist():
                rows = [(x["s"], x["e"], x["t"]) for x in items]
                out.append(write_srt(rows) if kind == "srt" else write_vtt(Document([Cue(a, b, html.escape(t, quote=False)) for a, b, t in rows])))
            yield pa.record_batch([batch.column(0), pa.array(out, pa.string())], names=["file", "content"])

    return rows.mapInArrow(write, "file string, content string")
