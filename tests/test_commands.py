"""Every command through the command line."""

from __future__ import annotations

import json

import pytest

from lectern.cli import _option, run
from lectern.sources import blocks

EP = """id: b1
source:
  ordinal: 1
  note: Start
  timecodes: {start: '00:00:01.000', end: '00:00:02.000'}
image: {name: one.jpg}
chunks:
- text: 森[もり]へ **行く**
  references:
    en: {text: into the *forest*}
---
id: b2
source:
  ordinal: 2
image: {name: two.jpg}
references:
  en:
    source:
      ordinal: 7
      timecodes: {start: '00:00:04.000', end: '00:00:06.000'}
chunks:
- text: ''
  references:
    en: {text: alone}
    fr: {text: seul}
"""


@pytest.fixture
def content(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "ep.content.yaml").write_text(EP)
    return tmp_path


def read(path):
    return list(blocks.documents(path.read_text()))


def test_index_and_link(spark, content):
    other = content / "other"
    other.mkdir()
    (other / "x.content.yaml").write_text("id: o1\nchunks:\n- text: 森へ行く道\n- text: つづき\n")
    run(["content", "index", str(other), "--index-path", str(content / "idx")])
    assert [x["block"]["id"] for x in run(["content", "search", "行く", "--index-path", str(content / "idx")])] == ["o1"]
    totals = run(["content", "link", str(content / "in"), str(content / "out"), "--index-path", str(content / "idx"), "--link-name", "kin"])
    assert totals == {"linked_chunks": 1, "total_chunks": 2}
    out = read(content / "out" / "ep.content.yaml")
    assert out[0]["chunks"][0]["references"] == {"en": {"text": "into the *forest*"}, "kin": {"text": "森へ行く道\n\nつづき"}} and "kin" not in out[1]["chunks"][0]["references"]


def test_import_media(spark, content):
    media = content / "media"
    media.mkdir()
    (media / "ep.tsv").write_text("ep|1\t-\t[sound:a.mp3]\t<img src='s.jpg'>\t\t\nep|en|7\t-\t[sound:b.mp3]\t<img src='gone.jpg'>\t\t\n")
    (media / "s.jpg").write_text("x")
    run(["content", "transform", "import-media", str(content / "in"), str(content / "out"), "--media-path", str(media), "--image-prefix", "p/", "--audio-prefix", "q/"])
    out = read(content / "out" / "ep.content.yaml")
    assert (out[0]["image"], out[0]["audio"]) == ({"name": "p/s.jpg"}, {"name": "q/a.mp3"}) and out[1]["image"] == {"name": "two.jpg"} and "audio" not in out[1]


def test_image_text_and_groups(spark, content):
    seen = content / "seen"
    seen.mkdir()
    (seen / "two.easyocr.json").write_text(json.dumps({"readResult": [{"text": "看板", "confident": 0.5}]}))
    run(["content", "transform", "import-image-text", str(content / "in"), str(content / "out"), "--images", str(seen), "--provider", "easyocr", "--role", "OnScreenText"])
    assert [c.get("text") for c in read(content / "out" / "ep.content.yaml")[1]["chunks"]] == ["", "看板"]
    (content / "sig.csv").write_text("name,signature\none.jpg,00000000000000ff\ntwo.jpg,00000000000000fe\n")
    run(["content", "transform", "group-similar-images", str(content / "in"), str(content / "grouped"), "--images", str(content / "sig.csv"), "--similarity-threshold", "0.9"])
    assert read(content / "grouped" / "ep.content.yaml")[1]["image"]["group"] == {"name": "one.jpg", "similarity": 1 - 1 / 64}


def test_subtitles(spark, content):
    run(["subtitles", "generate", str(content / "in"), str(content / "srt"), "--include-ref", "en", "--extend-audio", "200"])
    assert (content / "srt" / "ep.srt").read_text() == "1\n00:00:01,000 --> 00:00:02,200\n森[もり]へ 行く\n\n2\n00:00:05,000 --> 00:00:05,100\nalone\n"
    run(["subtitles", "generate", str(content / "in"), str(content / "keys"), "--purpose", "media-extraction", "--include-ref", "en"])
    assert [x for x in (content / "keys" / "ep.srt").read_text().split("\n") if "|" in x] == ["ep|1", "ep|en|7"]
    run(["subtitles", "generate", str(content / "in"), str(content / "own")])
    assert (content / "own" / "ep.srt").read_text().count("-->") == 1
    (content / "tt").mkdir()
    (content / "tt" / "a.ttml").write_text('<tt xmlns="http://www.w3.org/ns/ttml"><body><div><p begin="1s" end="2s">one<br/>two</p></div></body></tt>')
    assert run(["subtitles", "ttml-to-webvtt", str(content / "tt"), str(content / "vtt")]) == ["a.vtt"]
    assert (content / "vtt" / "a.vtt").read_text() == "WEBVTT\n\n00:00:01.000 --> 00:00:02.000\none\ntwo\n"
    run(["subtitles", "generate-content", str(content / "vtt"), str(content / "made")])
    assert read(content / "made" / "a.content.yaml")[0]["chunks"] == [{"text": "one  \ntwo"}]


def test_markdown_export(spark, content):
    export = lambda *more: (run(["markdown", "export", str(content / "in"), str(content / "md"), *more]), (content / "md" / "ep.md").read_text())[1]
    plain = export()
    assert plain.startswith("# ep\n\n## Start\n\n![](images/one.jpg)\n\n森[もり]へ **行く**\n\ninto the *forest*\n\n---") and "## 00:00:04" in plain and "> en: alone\n\n> fr: seul" in plain
    assert "## " not in export("--no-block-headings")
    assert "<ruby>森<rt>もり</rt></ruby>へ" in export("--ruby", "html") and "森へ" in export("--ruby", "remove")
    notes = export("--ref-behavior", "footnotes", "--ref-labels", "all")
    assert "行く**[^ep-1]" in notes and "[^ep-1]: en: into the *forest*" in notes and "    fr: seul" in notes
    blur = export("--ref-behavior", "blur-html")
    assert "<p class='blurText'><input type='checkbox' id='ep-1-ref-en'/><label for='ep-1-ref-en'>into the <em>forest</em></label></p>" in blur
    assert "<p><span>fr:</span> <span class='blurText'><input type='checkbox' id='ep-2-ref-fr'/><label for='ep-2-ref-fr'>seul</label></span></p>" in blur
    with pytest.raises(Exception, match="more than 1 blocks"):
        export("--block-limit", "1")
    (content / "t.py").write_text("def template(file, rows, options):\n    return f\"{file} {len(rows)} {options['n'] + 1}\\n\"\n")
    assert export("--template", str(content / "t.py"), "--option", "n=4") == "ep 2 5\n"
    (content / "in" / "a.content.yaml").write_text("id: x\nchunks:\n- text: first\n")
    run(["markdown", "export", str(content / "in"), str(content / "md" / "all.md"), "--combine"])
    assert (content / "md" / "all.md").read_text().startswith("# a\n\nfirst\n\n---\n\n# ep") or "# a" in (content / "md" / "all.md").read_text()


def test_options():
    assert [_option(f"k={v}")[1] for v in ("True", "12", "1.5", "x=y")] == [True, 12, 1.5, "x=y"]
    with pytest.raises(ValueError):
        _option("nothing")


def test_config_and_volumes(spark, tmp_path):
    path = str(tmp_path / "c" / "config.yaml")
    run(["config", "set", path, "core.depth", "3"])
    run(["config", "set", path, "core.name", "x"])
    assert run(["config", "get", path, "core.depth"]) == 3 and run(["config", "get", path]) == {"core": {"depth": 3, "name": "x"}} and run(["config", "get", path, "a.b"]) is None
    run(["library", "init", str(tmp_path / "lib")])
    inner = run(["volume", "new", str(tmp_path / "lib"), "One", "--moniker", "m-1", "--tags", "b,a"])
    run(["volume", "new", str(tmp_path / "lib"), "Two"])
    assert [v["title"] for v in run(["volume", "list", inner])] == ["One"] and [v["title"] for v in run(["volume", "list", inner, "--all"])] == ["Two", "One"]


def test_stats(spark, content):
    (content / "in" / "two.content.yaml").write_text("chunks:\n- text: 森へ to\n")
    rows = lambda action: [json.loads(x) for f in sorted((content / action).glob("part*")) for x in f.read_text().splitlines()]
    for action in ("content", "aggregates", "analytics"):
        run(["stats", action, str(content / "in"), str(content / action)])
    assert {(r["file"], r["tokens"], r["timed_tokens"], r["duration_us"]) for r in rows("content")} == {("ep", 4, 4, 1_000_000), ("two", 2, 0, 0)}
    assert {r["term"]: (r["cnt"], r["n_docs"]) for r in rows("aggregates")}["to"] == (1, 1)
    assert {(r["file"], r["n_terms"]) for r in rows("analytics")} == {("ep", 4), ("two", 2)}
