import struct

import pytest
from pyspark.sql import functions as F

from inkmesh.functions import blocks, frontmatter, markers
from inkmesh.functions import text as T
from inkmesh.sources import delimited, html, images, manifest


def column(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(("name", "want"), [("  Ab C ", "ab c"), ("﻿É ", "é"), ("É", "é"), ("", "")])
def test_handle(spark, name, want):
    assert T.handle_py(name) == want
    assert column(spark, name, T.handle) == want


@pytest.mark.parametrize(("title", "want"), [("a/b: c?", "ab c"), (" ._x. ", "x"), ("...", "Untitled"), ("a \n b", "a b")])
def test_sanitize_title(spark, title, want):
    assert T.sanitize_title_py(title) == want
    assert column(spark, title, T.sanitize_title) == want


def test_long_titles_are_cut_by_bytes_with_a_tag_of_the_whole():
    a, b = "é" * 150 + "a", "é" * 150 + "b"
    assert len(T.title_stem_py(a).encode()) <= 200
    assert T.title_stem_py(a) != T.title_stem_py(b)
    assert T.title_stem_py(a.upper().lower()) == T.title_stem_py(a)
    assert T.unique_title_py("x", {"x", "x-2"}) == "x-3"
    assert len(T.unique_title_py(a, {T.handle_py(T.title_stem_py(a))}).encode()) <= 200


def test_lengths_count_utf16_units(spark):
    assert column(spark, "a😀b", T.utf16_length) == 4
    assert column(spark, "a😀bcd", T.token_estimate) == 2
    cut = T.truncate_tail_py("x" * 100 + "😀" * 200, 40)
    assert cut.endswith("\n" + T.MARKER) and len(cut.encode("utf-16-le")) <= 2 * 160
    assert T.truncate_tail_py("x" * 100, 1) == T.MARKER
    assert T.truncate_tail_py("abc", 1) == "abc"


def test_slug_and_paths(spark):
    assert T.slug_py("What is ÉA, really?") == "what-is-a-really"
    assert column(spark, "日本", T.slug) == "answer"
    assert column(spark, "a/b/.md", T.extension) == ""
    assert column(spark, "a/b/c.tar.GZ", T.extension) == ".gz"
    assert T.normalize_path_py("a\\.\\b//../c") == "a/c"


def test_markers_cannot_be_ended_by_their_payload():
    assert markers.image_not_fetched("a-->b", "x\ny") == "<!-- image not fetched: a--›b — x y -->"
    assert markers.truncated() == "<!-- truncated for context budget -->"


def test_frontmatter():
    head = frontmatter.parse("---\nkind: yes\nn: 010\nd: 2024-01-02\nt: true\n---\nbody")
    assert (head.data, head.body) == ({"kind": "yes", "n": 10, "d": "2024-01-02", "t": True}, "body")
    assert not frontmatter.parse("---\n- a\n---\n").mergeable
    assert frontmatter.parse("---\nopen").present and not frontmatter.parse("---\nopen").mergeable
    assert frontmatter.ensure("---\nb: 1 # c\n---\nx", {"a": 2, "b": 3}) == "---\na: 2\nb: 1 # c\n---\nx"
    assert frontmatter.ensure("x", {"kind": "answer"}) == "---\nkind: answer\n---\nx"
    assert frontmatter.replace_value("---\ns: a\n---\nx", "s", "[[b]]") == "---\ns: '[[b]]'\n---\nx"
    assert frontmatter.replace_value("---\ns: a\ns: b\n---\nx", "s", "c") is None
    assert frontmatter.render({"updated": "2024-01-02", "kind": "x", "zz": 1, "aliases": []}).split("\n")[1:5] == ["kind: x", "aliases: []", "updated: '2024-01-02'", "zz: 1"]


def test_citations_hold_brackets_and_do_not_pile_up():
    text = blocks.with_citations("prose", ["raw/[draft] a.md", "raw/b.md", "raw/b.md"])
    assert blocks.citations(text) == ["raw/[draft] a.md", "raw/b.md"]
    assert blocks.with_citations(text, ["raw/c.md"]).count("citations:start") == 1
    assert blocks.citations("<!-- citations:start -->\n## Sources\n- [[a]]\n") == []


def test_trace_round_trip_and_the_older_form():
    t = blocks.Trace("B", ["A, b", "raw/[x] y.md"], True, [("A, b", 0.12345), ("c", 0.0)])
    text = blocks.with_block("answer", "trace", blocks.trace_lines(t))
    back = blocks.parse_trace(text)
    assert (back.mode, back.seeds, back.round2, back.top) == ("B", t.seeds, True, [("A, b", 0.1235), ("c", 0.0)])
    old = blocks.block("trace", ["- mode: A", "- seeds: [[x]], [[Newton, Isaac]]", "- round2: no", "- top: [[x]] 0.5000, [[Newton, Isaac]] 0.1"])
    back = blocks.parse_trace(old)
    assert back.seeds == ["x"] and back.top == [("x", 0.5)]
    assert back.unparsed == ["[[Newton, Isaac]]", "[[Newton, Isaac]] 0.1"]
    assert blocks.parse_trace(blocks.block("trace", ["- mode: C"])) is None


def test_answer_links():
    body = "[[A]] [[B|b]] [[Al]] [[A#h]] [[#here]] [[gone]]"
    got = blocks.validated_links(body, [("wiki/A.md", "A")], {"a": "wiki/A.md", "al": "wiki/A.md", "b": "wiki/B.md"})
    assert got == "[[A]] b <!-- link outside retrieved set: B --> [[Al]] [[A#h]] [[#here]] gone <!-- link outside retrieved set: gone -->"
    assert blocks.post_pass("[[al]] [[al|x]] [[A]] [[no]] [[a]] [[ A |]]", {"al": "A", "a": "A"}) == "[[A|al]] [[A|x]] [[A]] [[no]] [[A|a]] [[A|]]"
    assert blocks.clean_missing(["[]][X][[]", " a\nb ", "[[]]"]) == ["X", "a b"]
    assert blocks.forged_removed("a\n <!-- trace:start --> \nb <!-- trace:end --> c\n") == "a\nb <!-- trace:end --> c\n"


@pytest.mark.parametrize(
    ("text", "rows"),
    [
        ('a,b\r\n"x""y","\n"', [["a", "b"], ['x"y', "\n"]]),
        ('q"r,s\n\nlast', [['q"r', "s"], [""], ["last"]]),
        ('"",""""', [["", '"']]),
        ('"open', [["open"]]),
        ("", []),
        ("﻿a,\n", [["a", ""]]),
    ],
)
def test_delimited(text, rows):
    assert delimited.parse(text, ",") == rows


def test_dataset_card():
    card = delimited.describe("id,name,when,ok\n1,a|b,2024-01-01,yes\n2,,2024-01-02,NO\n", "raw/x.csv")
    assert "- Rows: 2" in card and "| id | integer |" in card and "| when | date |" in card and "| ok | boolean |" in card and "a\\|b" in card
    assert "Header row: no" in delimited.describe("1,2\n3,4\n", "raw/x.csv")


def test_html():
    assert html.to_markdown("<h2>A <b>b</b></h2><p>c <em>d</em><script>'</p>'</script><ul><li>x<li>y</ul><a href='/u'>l</a>") == "## A **b**\n\nc *d*\n\n-   x\n\n-   y\n\n[l](/u)\n"
    assert html.to_markdown("<script>x</script>") == ""


def test_image_sizes():
    assert images.size(b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 7, 9)) == (7, 9)
    assert images.size(b"GIF89a" + struct.pack("<HH", 3, 4)) == (3, 4)
    assert images.size(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 5, 6) + b"\0" * 8) == (6, 5)
    assert images.size(b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (9).to_bytes(3, "little") + (19).to_bytes(3, "little")) == (10, 20)
    assert images.size(b"nothing") is None


def test_image_decisions_and_links():
    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 400, 300) + b"\0" * 6000
    small = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 4, 3) + b"\0" * 6000
    got = {"http://x/a.png": images.Fetched(body=png), "http://x/s.png": images.Fetched(body=small), "http://x/logo.png": images.Fetched(body=png), "http://x/t": images.Fetched(content_type="text/html"), "http://x/e": images.Fetched(error="timed out")}
    assert images.refusal("http://x/s.png", "", "", got["http://x/s.png"]) == "under 100×100"
    assert images.refusal("http://x/logo.png", "", "", got["http://x/logo.png"]).startswith("decorative")
    assert images.refusal("http://x/logo.png", "our emblem", "see our emblem here", got["http://x/logo.png"]) is None
    assert images.refusal("http://x/t", "", "", got["http://x/t"]) == "not an image, content-type text/html"
    assert images.refusal("http://x/e", "", "", got["http://x/e"]) == "fetch failed, timeout"
    text = "![a](http://x/a.png) ![s](http://x/s.png)\n<!-- image not fetched: s.png — old -->\n<!-- mine -->\nend"
    out, kept, marked = images.localize(text, got.__getitem__, lambda f, u: "raw/assets/1.png")
    assert (kept, marked) == (1, 1)
    assert out == "![a](raw/assets/1.png) ![s](http://x/s.png)\n<!-- image not fetched: s.png — under 100×100 -->\n<!-- mine -->\nend"
    assert images.localize(out, got.__getitem__, lambda f, u: "raw/assets/1.png")[0] == out


def test_manifest():
    assert manifest.parse("not json") == [] and manifest.parse(None) == []
    assert manifest.parse('{"a": "h", "b": {"hash": "i", "derivative": "d"}, "__proto__": "x", "c": 5}') == [("a", "h", None), ("b", "i", "d")]
