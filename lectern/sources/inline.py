"""Markdown as a tree of blocks with runs of inline nodes, shown as HTML or as plain text: what a task does with one
text. Paragraphs, headings of both kinds, rules, quotes, nested lists, fenced and indented code; escapes, entities, code
spans, nested emphasis, links, images, autolinks, hard breaks. Tags in a text stay in HTML and go from plain text. Not
read: reference links, tables, and tags as blocks of their own."""

from __future__ import annotations

import bisect
import html
import re
import string
from collections import defaultdict
from functools import lru_cache

#: Quotes and lists within each other that are read as such; what lies deeper is text.
DEPTH = 60

_FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})[ \t]*(\S*)")
_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_QUOTE = re.compile(r" {0,3}> ?")
_ITEM = re.compile(r"( {0,3})([-*+]|(\d{1,9})([.)]))(?:( {1,4})(?=\S)|( )(?= *\S)|[ \t]*$)")
_UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_TOKEN = re.compile(
    r"(?P<escape>\\[!-/:-@\[-`{-~])|(?P<hard>(?<! ) {2,}\n|\\\n) *|(?P<soft> ?\n) *|(?P<code>`+)|<(?P<auto>[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*)>"
    r"|(?P<tag></?[A-Za-z][A-Za-z0-9-]*(?:\s[^<>]*)?/?>)|(?P<entity>&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});)|(?P<open>!?\[)|(?P<close>\])|(?P<run>\*+|_+)"
)
_PLAIN = re.compile(r"[^\\`*_\[\]<&\n]*$")
_TAIL = re.compile(r"\(\s*(?:<([^<>\n]*)>|([^\s()<]?[^\s()]*(?:\([^\s()]*\)[^\s()]*)*))(?:\s+(\"[^\"]*\"|'[^']*'))?\s*\)")


def _starts_block(line: str) -> bool:
    """Whether a line ends the paragraph before it."""
    item = _ITEM.match(line)
    return bool(_FENCE.match(line) or _HEADING.match(line) or _RULE.match(line) or _QUOTE.match(line) or (item and item.end() < len(line) and item[3] in (None, "1")))


def tree(lines: list[str], depth: int = 0) -> list[tuple]:
    """Blocks: (paragraph, text), (heading, level, text), (rule,), (code, language, text), (quote, blocks),
    (list, start or None, tight, items), each item a list of blocks."""
    out: list[tuple] = []
    i, n = 0, len(lines)
    while i < n:
        line = lines[i]
        if not line.strip():
            i += 1
        elif line.startswith("    "):
            j = i
            while j < n and (lines[j].startswith("    ") or not lines[j].strip()):
                j += 1
            out.append(("code", "", "\n".join(x[4:] for x in lines[i:j]).rstrip() + "\n"))
            i = j
        elif m := _FENCE.match(line):
            end = re.compile(rf" {{0,3}}{m[1][0]}{{{len(m[1])},}}[ \t]*$")
            j = next((k for k in range(i + 1, n) if end.match(lines[k])), n)
            out.append(("code", m[2], "".join(x + "\n" for x in lines[i + 1 : j])))
            i = j + 1
        elif m := _HEADING.match(line):
            out.append(("heading", len(m[1]), (m[2] or "").strip()))
            i += 1
        elif _RULE.match(line):
            out.append(("rule",))
            i += 1
        elif depth < DEPTH and _QUOTE.match(line):
            inner = []
            while i < n and (_QUOTE.match(lines[i]) or (inner and inner[-1].strip() and lines[i].strip() and not _starts_block(lines[i]))):
                inner.append(_QUOTE.sub("", lines[i], count=1))
                i += 1
            out.append(("quote", tree(inner, depth + 1)))
        elif depth < DEPTH and (m := _ITEM.match(line)):
            i = _list(lines, i, m, depth, out)
        else:
            j, level = i + 1, 0
            while j < n and lines[j].strip():
                if u := _UNDERLINE.match(lines[j]):
                    level = 1 if u[1][0] == "=" else 2
                    break
                if _starts_block(lines[j]):
                    break
                j += 1
            text = "\n".join(x.lstrip() for x in lines[i:j]).rstrip()
            out.append(("heading", level, text) if level else ("paragraph", text))
            i = j + (level > 0)
    return out


def _list(lines: list[str], i: int, first: re.Match, depth: int, out: list[tuple]) -> int:
    """Adds the list that begins in line i; where it ends. Items of a list have the same mark."""
    mark, items, tight, n = first[4] or first[2], [], True, len(lines)
    while i < n and (m := _ITEM.match(lines[i])) and (m[4] or m[2]) == mark and not _RULE.match(lines[i]):
        width = m.end() if m[5] or m[6] else len(m[1]) + len(m[2]) + 1
        inner = [lines[i][m.end() :]]
        i += 1
        while i < n:
            line = lines[i]
            if not line.strip():
                inner.append("")
            elif line.startswith(" " * width):
                inner.append(line[width:])
            elif inner[-1].strip() and not _starts_block(line) and not _ITEM.match(line):
                inner.append(line)
            else:
                break
            i += 1
        blanks = len(inner)
        while inner and not inner[-1]:
            inner.pop()
        follows = i < n and (m := _ITEM.match(lines[i])) and (m[4] or m[2]) == mark
        items.append(tree(inner, depth + 1))
        if (blanks > len(inner) and follows and blanks > 1) or ("" in inner and len(items[-1]) > 1 and any(not x and y and not y.startswith(" ") for x, y in zip(inner, inner[1:], strict=False))):
            tight = False
    out.append(("list", int(first[3]) if first[3] else None, tight, items))
    return i


def _emphasised(nodes: list, runs: list, bottom: int) -> None:
    """Pairs the delimiter runs above ``bottom``. A run is [node, mark, left, opens, closes, length]; a node's tags are
    put beside what is left of its run. The place under which no opener can be is kept for each kind of closer, so
    that long texts without pairs take linear time."""
    floor: dict[tuple, int] = defaultdict(lambda: bottom)
    at = bottom
    while at < len(runs):
        closer = runs[at]
        if not closer[4] or not closer[2]:
            at += 1
            continue
        kind, k = (closer[1], closer[3], closer[5] % 3), at - 1
        while k >= floor[kind]:
            o = runs[k]
            odd = (o[4] or closer[3]) and (o[5] + closer[5]) % 3 == 0 and (o[5] % 3 or closer[5] % 3)
            if o[1] == closer[1] and o[3] and o[2] and not odd:
                break
            k -= 1
        else:
            floor[kind] = at
            at += 1
            continue
        opener = runs[k]
        used = 2 if opener[2] > 1 and closer[2] > 1 else 1
        tag = "strong" if used == 2 else "em"
        opener[2] -= used
        closer[2] -= used
        nodes[opener[0]][2].insert(0, tag)
        nodes[closer[0]][1].append(tag)
        for run in (opener, closer):
            nodes[run[0]][3] = run[1] * run[2]
        del runs[k + 1 : at]
        for other in [x for x, v in floor.items() if v > k + 1]:
            floor[other] = k + 1
        at = k + 1
    del runs[bottom:]


def nodes_of(text: str) -> list:
    """Inline nodes: [kind, ..] with kind text, raw (a tag), code, hard, soft, run ([run, closed tags, opened tags, left]),
    link, unlink or image."""
    if _PLAIN.match(text):
        return [["text", text]]
    nodes: list = []
    runs: list = []
    brackets: list[tuple[int, int, bool]] = []
    ticks: dict[int, list[int]] = defaultdict(list)
    for m in re.finditer(r"`+", text):
        ticks[len(m[0])].append(m.start())
    at = 0
    while m := _TOKEN.search(text, at):
        if m.start() > at:
            nodes.append(["text", text[at : m.start()]])
        at, kind, found = m.end(), m.lastgroup, m[0]
        if kind == "escape":
            nodes.append(["text", found[1]])
        elif kind in ("hard", "soft"):
            nodes.append([kind])
        elif kind == "entity":
            nodes.append(["text", html.unescape(found)])
        elif kind == "auto":
            nodes += [["link", m["auto"], None], ["text", m["auto"]], ["unlink"]]
        elif kind == "tag":
            nodes.append(["raw", found])
        elif kind == "code":
            places = ticks[len(found)]
            end = bisect.bisect_left(places, at)
            if end == len(places):
                nodes.append(["text", found])
                continue
            body = text[at : places[end]].replace("\n", " ")
            nodes.append(["code", body[1:-1] if body.strip() and body[0] == body[-1] == " " else body])
            at = places[end] + len(found)
        elif kind == "open":
            brackets.append((len(nodes), len(runs), found == "!["))
            nodes.append(["text", found])
        elif kind == "close":
            tail = _TAIL.match(text, at) if brackets else None
            place, bottom, image = brackets.pop() if brackets else (0, 0, False)
            if not tail:
                nodes.append(["text", "]"])
                continue
            _emphasised(nodes, runs, bottom)
            target, title = html.unescape(tail[1] if tail[1] is not None else tail[2]), tail[3] and tail[3][1:-1]
            if image:
                nodes[place:] = [["image", target, title, plain_inline(nodes[place + 1 :])]]
            else:
                nodes[place] = ["link", target, title]
                nodes.append(["unlink"])
                brackets = [b for b in brackets if b[2]]
            at = tail.end()
        else:
            before, after = text[m.start() - 1 : m.start()] or " ", text[at : at + 1] or " "
            mark = lambda c: c in string.punctuation or (not c.isalnum() and not c.isspace() and ord(c) > 127)
            left = not after.isspace() and (not mark(after) or before.isspace() or mark(before))
            right = not before.isspace() and (not mark(before) or after.isspace() or mark(after))
            opens, closes = (left, right) if found[0] == "*" else (left and (not right or mark(before)), right and (not left or mark(after)))
            runs.append([len(nodes), found[0], len(found), opens, closes, len(found)])
            nodes.append(["run", [], [], found])
    nodes.append(["text", text[at:]])
    _emphasised(nodes, runs, 0)
    return nodes


def plain_inline(nodes: list) -> str:
    own = {"hard": lambda v: "\n", "soft": lambda v: "\n", "raw": lambda v: "", "link": lambda v: "", "unlink": lambda v: "", "run": lambda v: v[3], "image": lambda v: v[3]}
    return "".join(own[v[0]](v) if v[0] in own else v[1] for v in nodes)


def _link(v: list, name: str, attribute: str, more: str = "") -> str:
    title = f' title="{html.escape(v[2])}"' if v[2] is not None else ""
    return f'<{name} {attribute}="{html.escape(v[1])}"{more}{title}'


def html_inline(nodes: list) -> str:
    own = {
        "hard": lambda v: "<br />\n", "soft": lambda v: "\n", "raw": lambda v: v[1], "text": lambda v: html.escape(v[1]).replace("&#x27;", "'"), "code": lambda v: f"<code>{html.escape(v[1])}</code>", "unlink": lambda v: "</a>",
        "link": lambda v: _link(v, "a", "href") + ">", "image": lambda v: _link(v, "img", "src", f' alt="{html.escape(v[3])}"') + " />",
        "run": lambda v: "".join(f"</{t}>" for t in v[1]) + v[3] + "".join(f"<{t}>" for t in v[2]),
    }
    return "".join(own[v[0]](v) for v in nodes)


@lru_cache(1 << 14)
def _short(text: str) -> tuple[str, str]:
    nodes = nodes_of(text)
    return plain_inline(nodes), html_inline(nodes)


def _shown(text: str) -> tuple[str, str]:
    """A block's text plain and as HTML. Short ones are kept, as both forms ask for them and texts repeat."""
    return _short(text) if len(text) <= 200 else _short.__wrapped__(text)


def plain_blocks(blocks: list[tuple]) -> str:
    """Each block on lines of its own, without a mark."""
    out = []
    for b in blocks:
        if b[0] in ("paragraph", "heading"):
            out.append(_shown(b[-1])[0] + "\n")
        elif b[0] == "code":
            out.append(b[2])
        elif b[0] == "quote":
            out.append(plain_blocks(b[1]))
        elif b[0] == "list":
            out += [plain_blocks(item) for item in b[3]]
    return "".join(out)


def html_blocks(blocks: list[tuple], tight: bool = False) -> str:
    out = []
    for b in blocks:
        if b[0] == "paragraph":
            body = _shown(b[1])[1]
            out.append(body if tight else f"<p>{body}</p>")
        elif b[0] == "heading":
            out.append(f"<h{b[1]}>{_shown(b[2])[1]}</h{b[1]}>")
        elif b[0] == "rule":
            out.append("<hr />")
        elif b[0] == "code":
            out.append(f"<pre><code{f' class="language-{html.escape(b[1])}"' if b[1] else ''}>{html.escape(b[2])}</code></pre>")
        elif b[0] == "quote":
            out.append(f"<blockquote>\n{html_blocks(b[1])}</blockquote>")
        else:
            name = "ul" if b[1] is None else "ol"
            start = f' start="{b[1]}"' if b[1] not in (None, 1) else ""
            items = []
            for item in b[3]:
                body = html_blocks(item, b[2])
                inline = b[2] and item and item[0][0] == "paragraph"
                items.append("<li>" + ("" if inline or not item else "\n") + (body[:-1] if b[2] and item and item[-1][0] == "paragraph" else body) + "</li>\n")
            out.append(f"<{name}{start}>\n{''.join(items)}</{name}>")
    return "".join(x + "\n" for x in out)


def lines_of(text: str) -> list[str]:
    return text.replace("\r\n", "\n").replace("\r", "\n").expandtabs(4).split("\n")


#: Where a text may be cut: behind an empty line, before a line that no indented code takes in.
_PART = re.compile(r"\n\n(?=\S)")
#: A line that may be an item; in a part before such a line there may be its list.
_MAY_ITEM = re.compile(r" {0,3}(?:[-*+]|\d{1,9}[.)])(?!\S)")
_HAS_ITEM = re.compile(rf"^{_MAY_ITEM.pattern}", re.M)
#: Characters of which some are used as PLACE: a text with them is parsed as a whole.
_TAKEN = re.compile("[\U00020000-\U0010ffff]")
#: Letters elsewhere are all alike to the parser: PLACE stands for a run of them.
_LETTERS = re.compile(r"([^\W\d_]+)")
PLACE = "\U00020000"
#: Words that one part may have, each with a character of its own; a text with a larger one is parsed as a whole.
MOST_WORDS = 60_000
_PLACES = re.compile("[\U00020000-\U0002ffff]")


def shown(text: str) -> tuple[str, str]:
    """A text plain and as HTML. It is parsed in parts, as paragraphs, headings and quotes are over at an empty line, lists and indented code where a
    line follows that begins neither with a space nor as an item. Forms of short parts, without their letters, are kept, as they repeat."""
    lines = lines_of(text)
    text = "\n".join(lines)
    # Lines of a fence take in empty lines; letters count in entities, and in tags and links in angles.
    if any(x in text for x in ("```", "~~~", "&", "<")) or (not text.isascii() and _TAKEN.search(text)):
        blocks = tree(lines)
        return plain_blocks(blocks), html_blocks(blocks)
    pieces = _LETTERS.split(text)
    words = pieces[1::2]
    plain, page, plain_words, page_words, at = [], [], [], [], 0
    forms = _joined(_PART.split(PLACE.join(pieces[::2])))
    if any(len(form) > MOST_WORDS and form.count(PLACE) > MOST_WORDS for form in forms):
        blocks = tree(lines)
        return plain_blocks(blocks), html_blocks(blocks)
    for form in forms:
        n, a, b, a_order, b_order = _formed(form) if len(form) <= 200 else _formed.__wrapped__(form)
        own = words[at : at + n]
        at += n
        plain.append(a)
        page.append(b)
        plain_words += own if a_order is None else [own[k] for k in a_order]
        page_words += own if b_order is None else [own[k] for k in b_order]
    return "".join(plain) % tuple(plain_words), "".join(page) % tuple(page_words)


def _joined(parts: list[str]) -> list[str]:
    """A part with items takes in the parts behind it that begin as one."""
    out, begun = [], False
    for x in parts:
        item, lists = _items(x) if len(x) <= 200 else _items.__wrapped__(x)
        if begun and item:
            out[-1].append(x)
        else:
            out.append([x])
            begun = lists
    return ["\n\n".join(x) if len(x) > 1 else x[0] for x in out]


@lru_cache(1 << 14)
def _items(form: str) -> tuple[bool, bool]:
    """Whether a part begins as an item, and whether it has any."""
    return bool(_MAY_ITEM.match(form)), bool(_HAS_ITEM.search(form))


@lru_cache(1 << 14)
def _formed(form: str) -> tuple:
    """How many words a part has, plain and as HTML with %s for a word, and the order of words in each, None if it is the part's."""
    n = form.count(PLACE)
    places = iter(range(n))
    blocks = tree(_PLACES.sub(lambda m: chr(ord(PLACE) + next(places)), form).split("\n"))

    def pattern(text: str) -> tuple:
        order = [ord(c) - ord(PLACE) for c in _PLACES.findall(text)]
        return _PLACES.sub("%s", text.replace("%", "%%")), None if order == list(range(n)) else order

    (plain, plain_order), (page, page_order) = pattern(plain_blocks(blocks)), pattern(html_blocks(blocks))
    return n, plain, page, plain_order, page_order
