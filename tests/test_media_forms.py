from __future__ import annotations

import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.errors import PySparkException

from lectern.operators import lookup, reshape, search
from lectern.plans import media, q_media
from lectern.sources import images, inline, markdown


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
@pytest.mark.parametrize("depth", [8, 16])
def test_row_filters_are_undone(channels, depth):
    rng = np.random.default_rng(channels)
    for kind in (None, 0, 1, 2, 3, 4):
        pixels = rng.integers(0, 1 << depth, (13, 11, channels))
        eight = pixels if depth == 8 else (pixels * 510 + 65535) // 131070
        want = eight[:, :, 0] if channels < 3 else (eight[:, :, :3] @ [299, 587, 114] + 500) // 1000
        assert (images.png_grey(images.encoded_png(pixels, depth, kind)) == want).all()


def _made(header: bytes, raw: bytes, palette: bytes = b"") -> bytes:
    chunk = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + b"\0\0\0\0"
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_palettes_low_depths_and_passes():
    size = lambda w, h, *rest: w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes(rest)
    assert images.png_grey(_made(size(3, 1, 1, 0, 0, 0, 0), b"\0\xa0")).tolist() == [[255, 0, 255]]
    assert images.png_grey(_made(size(3, 1, 2, 3, 0, 0, 0), b"\0\x18", bytes([9, 9, 9, 50, 50, 50, 70, 70, 70]))).tolist() == [[9, 50, 70]]
    pixels = np.arange(9 * 10).reshape(9, 10)
    parts = [pixels[y::dy, x::dx] for x, y, dx, dy in ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))]
    raw = b"".join(b"\0" + bytes(row.tolist()) for part in parts for row in part)
    assert (images.png_grey(_made(size(10, 9, 8, 0, 0, 0, 1), raw)) == pixels).all()
    for bad in (b"", b"GIF", _made(size(3, 1, 1, 0, 0, 0, 0), b"\0"), _made(size(0, 1, 8, 0, 0, 0, 0), b"")):
        with pytest.raises(ValueError):
            images.png_grey(bad)


def test_reduction_is_a_mean_of_areas():
    rng = np.random.default_rng(3)
    for h, w in ((1, 1), (8, 8), (24, 16), (5, 13), (31, 3)):
        grey = rng.integers(0, 256, (h, w)).astype(np.uint8)
        fine = np.kron(grey.astype(np.int64), np.ones((8, 8), np.int64)).reshape(8, h, 8, w).sum((1, 3))
        assert (images.reduced(grey) == (2 * fine + h * w) // (2 * h * w)).all()


def test_files_to_signatures_and_groups(spark, tmp_path):
    grey = np.arange(64).reshape(8, 8, 1) * 2
    for name, pixels in (("a.png", grey), ("b.png", np.kron(grey, np.ones((2, 3, 1), np.int64))), ("c.png", grey[::-1])):
        (tmp_path / name).write_bytes(images.encoded_png(pixels))
    (tmp_path / "d.png").write_bytes(b"no image")
    found = {r.name: r.signature for r in images.read_signatures(spark, str(tmp_path)).collect()}
    assert found["a.png"] == found["b.png"] == -1 << 32 and found["c.png"] == (1 << 32) - 1 and found["d.png"] is None
    known = spark.createDataFrame([("a.png", "0000000000000001"), ("gone.png", "00")], "name string, signature string")
    assert {r.name: r.signature for r in images.read_signatures(spark, str(tmp_path), known=known).collect()} == {**found, "a.png": 1}
    content = spark.createDataFrame([("f", i, ((n,),)) for i, n in enumerate(("a.png", "b.png", "c.png", "d.png"))], "file string, pos long, block struct<image:struct<name:string>>")
    assert media.group_images(content, images.read_signatures(spark, str(tmp_path))).count() == 4
    images.register("length", images.Provider(lambda c: c, lambda c: q_media.F.length(c).cast("long"), lambda a, b: (a == b).cast("double"), lambda a: a.cast("string"), lambda t: t.cast("long")))
    assert {r.name: r.signature for r in images.read_signatures(spark, str(tmp_path), "length").collect()}["d.png"] == 8


HTML = [
    ("", ""), ("***a** b*", "<p><em><strong>a</strong> b</em></p>\n"), ("**a *b* c**", "<p><strong>a <em>b</em> c</strong></p>\n"), ("*foo**bar**baz*", "<p><em>foo<strong>bar</strong>baz</em></p>\n"),
    ("snake_case_name _a_ b\\*c\\*", "<p>snake_case_name <em>a</em> b*c*</p>\n"), ("**a*", "<p>*<em>a</em></p>\n"), ("a * b * c", "<p>a * b * c</p>\n"),
    ("- a\n- b\n  - c\n- d", "<ul>\n<li>a</li>\n<li>b\n<ul>\n<li>c</li>\n</ul>\n</li>\n<li>d</li>\n</ul>\n"), ("3. a\n\n4. b", '<ol start="3">\n<li>\n<p>a</p>\n</li>\n<li>\n<p>b</p>\n</li>\n</ol>\n'),
    ("> a\nb\n\nc", "<blockquote>\n<p>a\nb</p>\n</blockquote>\n<p>c</p>\n"), ("```py\nx < *1*\n```\ny", '<pre><code class="language-py">x &lt; *1*\n</code></pre>\n<p>y</p>\n'), ("# T #\nx\n===", "<h1>T</h1>\n<h1>x</h1>\n"),
    ('[a *b*](u "t") ![c](d)', '<p><a href="u" title="t">a <em>b</em></a> <img src="d" alt="c" /></p>\n'), ("*a [b*](c)", '<p>*a <a href="c">b*</a></p>\n'), ("[a]( b", "<p>[a]( b</p>\n"),
    ("`` a`b `` <x> <http://q.r>", '<p><code>a`b</code> <x> <a href="http://q.r">http://q.r</a></p>\n'), ("a\n\n---\n\n    code\n", "<p>a</p>\n<hr />\n<pre><code>code\n</code></pre>\n"), ('&amp; < &copy; "', "<p>&amp; &lt; © &quot;</p>\n"),
]


@pytest.mark.parametrize("text, want", HTML)
def test_markdown_to_html(text, want):
    assert markdown.to_html(text) == want


def test_markdown_to_plain_and_long_texts():
    assert markdown.to_plain("# T\r\n\r\n- **a _b_**\n- `c` [d](e) ![f](g)\n\n> q\\*  \n> r\n\n```\nk\n```\n<b>t</b>") == "T\na b\nc d f\nq*\nr\nk\nt\n"
    assert markdown.to_plain("") == "\n"
    for text in ("*a " * 50_000, "[" * 50_000, ">" * 50_000, "a** " * 50_000, "[a](" * 30_000, "- " * 3_000 + "a", "x" + " " * 50_000 + "y", " ".join("`" * k for k in range(1, 400))):
        markdown.to_html(text)


def test_table_as_one_array(spark, tmp_path):
    def read(folder):
        return json.loads("".join((tmp_path / folder / n).read_text() for n in names))

    rows = [(i * 7 % 100, f'x"{i % 3}\n') for i in range(100)] + [(0, "again"), (0, None), (None, "n"), (None, "n")]
    names = reshape.write_json_array(spark.createDataFrame(rows, "k int, v string"), str(tmp_path / "a"), ["k"], 5)
    got = read("a")
    assert len(names) == 7 and [r.get("k") for r in got] == sorted([r[0] for r in rows], key=lambda k: -1 if k is None else k)
    assert sorted((r.get("k") is not None, r.get("k", 0), r.get("v") or "") for r in got) == sorted((k is not None, k or 0, v or "") for k, v in rows)
    for n in ([], [(1, "one")]):
        names = reshape.write_json_array(spark.createDataFrame(n, "k int, v string"), str(tmp_path / f"n{len(n)}"), ["k"], 3)
        assert read(f"n{len(n)}") == [{"k": k, "v": v} for k, v in n]


def test_ancestors_and_their_errors(spark):
    entries = spark.createDataFrame([("/a", True), ("/a/b", True), ("/a/b/c", True), ("/a/f", False), ("/z", True), ("/a/b", True)], "path string, is_dir boolean")
    marked = spark.createDataFrame([("/a",), ("/a/b",), ("/gone",)], "directory string")
    paths = spark.createDataFrame([("/a/b/c",), ("/a/b/c",), ("/a",), ("/a/f",), ("/z",), ("/a/bc",), (None,)], "path string")
    got = sorted(((r.path or "", r.directory, r.state) for r in lookup.resolved_ancestor(paths, entries, marked).collect()), key=lambda r: r[0])
    assert got == [("", None, "missing"), ("/a", "/a", "found"), ("/a/b/c", "/a/b", "found"), ("/a/b/c", "/a/b", "found"), ("/a/bc", None, "missing"), ("/a/f", None, "file"), ("/z", None, "none")]
    assert lookup.resolved_ancestor(paths.where("path in ('/a', '/z')"), entries, marked, strict=True).count() == 2
    for path, message in (("/a/f", "a file where a directory is expected: /a/f"), ("/a/bc", "no such path: /a/bc")):
        with pytest.raises(PySparkException, match=message):
            lookup.resolved_ancestor(paths.where(f"path = '{path}'"), entries, marked, strict=True).collect()


def test_bounded_search_loses_nothing_and_skips_blocks(spark):
    texts = [(i, " ".join([f"w{i % 7}"] * (1 + i % 5) + [f"r{i // 40}"] + ["filler"] * (i % 11))) for i in range(1_200)] + [(5_000, ""), (5_001, None)]
    index = search.build(spark.createDataFrame(texts, "doc long, text string"), "doc", "text").written()
    queries = spark.createDataFrame([(1, "w3 r5"), (2, "filler"), (3, "r29"), (4, "unknown"), (5, ""), (6, None), (7, "w1 w2 w1 r1 filler")], "q long, t string")
    rows = lambda df: sorted(map(tuple, df.select("query", "doc", "score", "rank").collect()))
    for norms in ("byte", "exact"):
        whole = rows(search.best_matches(index, queries, "q", "t", 10, norms=norms, block_docs=10_000))
        for size in (1, 16, 64):
            assert rows(search.best_matches(index, queries, "q", "t", 10, norms=norms, block_docs=size)) == whole
    assert {r[0] for r in whole} == {1, 2, 3, 7} and len(whole) == 40
    bounds = spark.createDataFrame([(1, b, float(b)) for b in range(10)], "query long, block long, bound double")
    left = search.reachable(bounds, spark.createDataFrame([(1, 6.5)], "query long, score double"), bounds.where("block = 9"))
    assert sorted(r.block for r in left.collect()) == [7, 8]


def test_markdown_in_parts():
    """A text that is parsed in parts is shown as in one; parts that were met before are not parsed again."""
    rng, some = random.Random(8), ["a *b*", "- x", "* y", "+ z", "1. one", "2) two", "   - in", "    code", "  p", "> q", ">", "# h", "---", "===", "***", "\\*", "`c", "é", "", "", "", "\t t", "**s", "<b>", "[l](u)", "_e_", "\xa0n", "\x0b", "![a b](c \"d\")", "é% %s", "&amp;", "\U00020001", "a\u0301b 5x"]
    for n in range(6000):
        text = rng.choice(["\n", "\n\n", "\r\n"]).join(rng.choices([x for x in some if n % 2 or not re.search("```|~~~|[&<\U00020000-\U0010ffff]", x)] + (["```", "~~~ x"] if n % 5 == 0 else []), k=rng.randrange(1, 12)))
        blocks = inline.tree(inline.lines_of(text))
        assert (markdown.to_plain(text), markdown.to_html(text)) == (inline.plain_blocks(blocks) or "\n", inline.html_blocks(blocks)), text
    before = inline._formed.cache_info().misses
    got = markdown.to_html("\n\n".join(f"**w{chr(97 + k % 26)}{'é' * (k // 26)} _x_** 5%" for k in range(500)))
    assert got.count("<strong>") == 500 and "<p><strong>wbé <em>x</em></strong> 5%</p>" in got and inline._formed.cache_info().misses - before <= 1
