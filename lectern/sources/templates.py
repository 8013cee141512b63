"""Users' templates as text, compiled to column expressions: a file's rows are one array, and its text is one expression over it.

``{{ name.field }}`` shows a value; ``{{ function name .. }}`` what a function makes of values; ``{{ for x in name }} .. {{ end }}`` repeats for
each element, where ``x_index`` counts from 0; ``{{ if name }} .. {{ else }} .. {{ end }}`` asks whether a value is there: not null, false, empty
or blank. ``{{-`` and ``-}}`` take the white space away that stands before or behind. Names that no row has show nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, MapType, StringType, StructType

from lectern.functions.time import format_clock
from lectern.operators.sequence import capped
from lectern.sources.markdown import audio_line, image_line

Value = tuple[Column, DataType]
#: What templates may call; a null value gives nothing.
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "format_timecode": format_clock,
    "render_image": lambda name, prefix=None: image_line(name, "images") if prefix is None else F.when(name.isNotNull(), F.replace(image_line(name, "\0"), F.lit("\0"), prefix)),
    "render_audio": lambda name, prefix=None: audio_line(name, "audio") if prefix is None else F.when(name.isNotNull(), F.replace(audio_line(name, "\0"), F.lit("\0"), prefix)),
}
_NAME = r"[A-Za-z_][\w]*(?:\.[\w-]+)*"


@dataclass(frozen=True)
class Node:
    """kind is text, show, for or if; words are a text, or a tag's."""

    kind: str
    words: tuple[str, ...]
    body: tuple[Node, ...] = ()
    other: tuple[Node, ...] = ()


def parsed(template: str) -> tuple[Node, ...]:
    """A template's nodes; a tag that isn't closed, or closes nothing, is an error that names it."""
    stack: list[tuple[tuple[str, ...], list[Node], list[Node] | None]] = [((), [], None)]
    add = lambda node: (stack[-1][1] if stack[-1][2] is None else stack[-1][2]).append(node)
    at, trim = 0, False
    for m in re.finditer(r"\{\{(-?)(.*?)(-?)\}\}", template, re.DOTALL):
        text = template[at : m.start()]
        text = text.lstrip() if trim else text
        text = text.rstrip() if m[1] else text
        if text:
            add(Node("text", (text,)))
        at, trim = m.end(), bool(m[3])
        words = tuple(re.findall(r"\"[^\"]*\"|\S+", m[2]))
        if words[:1] == ("end",):
            if len(stack) == 1:
                raise ValueError("a template's {{ end }} closes nothing")
            head, body, other = stack.pop()
            add(Node(head[0], head[1:], tuple(body), tuple(other or ())))
        elif words[:1] == ("else",):
            if stack[-1][0][:1] != ("if",) or stack[-1][2] is not None:
                raise ValueError("a template's {{ else }} belongs to no {{ if }}")
            stack[-1] = (stack[-1][0], stack[-1][1], [])
        elif words[:1] == ("for",):
            if len(words) != 4 or words[2] != "in":
                raise ValueError(f"not a loop: {m[0]}")
            stack.append((("for", words[1], words[3]), [], None))
        elif words[:1] == ("if",) and len(words) == 2:
            stack.append((words, [], None))
        elif words:
            add(Node("show", words))
    if len(stack) > 1:
        raise ValueError(f"a template's {{{{ {stack[-1][0][0]} }}}} is never closed")
    rest = template[at:]
    rest = rest.lstrip() if trim else rest
    if rest:
        add(Node("text", (rest,)))
    return tuple(stack[0][1])


def _value(word: str, names: dict[str, Value]) -> Value | None:
    """What a word stands for; None if no row has it."""
    if word.startswith('"'):
        return F.lit(word[1:-1]), StringType()
    if not re.fullmatch(_NAME, word):
        raise ValueError(f"not a name: {word}")
    first, *path = word.split(".")
    found = names.get(first)
    for part in path:
        if found is None:
            return None
        col, kind = found
        if isinstance(kind, StructType) and part in kind.names:
            found = col[part], kind[part].dataType
        elif isinstance(kind, MapType):
            found = F.try_element_at(col, F.lit(part)), kind.valueType
        else:
            return None
    return found


def _there(value: Value | None) -> Column:
    if value is None:
        return F.lit(False)
    col, kind = value
    if isinstance(kind, BooleanType):
        return F.coalesce(col, F.lit(False))
    if isinstance(kind, (ArrayType, MapType)):
        return F.coalesce(F.size(col) > 0, F.lit(False))
    return F.coalesce(F.trim(col) != "", F.lit(False)) if isinstance(kind, StringType) else col.isNotNull()


def compiled(nodes: tuple[Node, ...], names: dict[str, Value], functions: dict[str, Callable[..., Column]] = FUNCTIONS) -> Column:
    """The text of a template as an expression over ``names``."""
    parts = []
    for node in nodes:
        if node.kind == "text":
            parts.append(F.lit(node.words[0]))
        elif node.kind == "show":
            parts.append(_shown(node.words, names, functions))
        elif node.kind == "if":
            parts.append(F.when(_there(_value(node.words[0], names)), compiled(node.body, names, functions)).otherwise(compiled(node.other, names, functions)))
        else:
            item, listed = node.words[0], _value(node.words[1], names)
            if listed is None or not isinstance(listed[1], ArrayType):
                continue
            parts.append(F.coalesce(F.array_join(F.transform(listed[0], _element(item, listed[1].elementType, node.body, names, functions)), ""), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def _element(item: str, kind: DataType, body: tuple[Node, ...], names: dict[str, Value], functions: dict[str, Callable[..., Column]]) -> Callable[[Column, Column], Column]:
    return lambda x, i: compiled(body, names | {item: (x, kind), f"{item}_index": (i, IntegerType())}, functions)


def _shown(words: tuple[str, ...], names: dict[str, Value], functions: dict[str, Callable[..., Column]]) -> Column:
    if words[0] in functions:
        given = [_value(w, names) for w in words[1:]]
        if not given or any(g is None for g in given):
            return F.lit("")
        return F.coalesce(functions[words[0]](*[g[0] for g in given]).cast("string"), F.lit(""))
    found = _value(words[0], names)
    if found is None or len(words) > 1:
        return F.lit("")
    col, kind = found
    return F.coalesce(F.to_json(col) if isinstance(kind, (StructType, MapType, ArrayType)) else col.cast("string"), F.lit(""))


def rendered(rows: DataFrame, template: str, file: str = "file", pos: str = "pos", settings: dict[str, str] | None = None, functions: dict[str, Callable[..., Column]] | None = None, most: int = 10_000) -> DataFrame:
    """(file, content): each file's rows by a template that knows ``file_heading``, ``settings`` and ``blocks``, the rows in order with all their
    columns. An error beyond ``most`` rows of a file, before they come together. Nulls show nothing; an empty table gives no files."""
    few = capped(rows, [file], [pos], most)
    row = F.struct(*rows.columns)
    # Rows may have maps, which have no order: those of one place go by their JSON.
    placed = F.struct(F.struct(F.col(pos).alias("at"), F.to_json(row).alias("tie")).alias("__key"), row.alias("__row"))
    by_key = lambda a, b: F.when(a["__key"] < b["__key"], -1).when(a["__key"] > b["__key"], 1).otherwise(0)
    one = few.groupBy(F.col(file).alias("file")).agg(F.array_sort(F.collect_list(placed), by_key).alias("__r"))
    one = one.select("file", F.transform("__r", lambda r: r["__row"]).alias("blocks"))
    given = F.create_map(*[F.lit(x) for pair in (settings or {}).items() for x in pair]) if settings else F.lit(None).cast("map<string,string>")
    names: dict[str, Value] = {"file_heading": (F.col("file").cast("string"), StringType()), "settings": (given, MapType(StringType(), StringType())), "blocks": (F.col("blocks"), one.schema["blocks"].dataType)}
    return one.select("file", compiled(parsed(template), names, FUNCTIONS | (functions or {})).alias("content"))
