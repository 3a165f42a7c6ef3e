import base64
import gzip
import hashlib
import io
import random
import time

import pytest

from karst.llm import html_extract as h
from karst.llm import warc as w

PAGES = "page_id long, url string, html string, payload_bytes string, n_chars string"
ROWS = [
    (5, "http://a/1", "<p>x</p>", "a", "b"), (3, "http://a/2", "<p>x</p>", None, None), (9, "http://a/3", "<p>é\r\n\r\nWARC/1.1\r\n</p>", None, None), (1, None, None, None, None),
    (2, "http://a b\n/", "", None, None), (7, "http://a/4", "HTTP/1.1 200 OK\r\n\r\nx", None, None), (7, "http://a/4", "HTTP/1.1 200 OK\r\n\r\nx", None, None), (None, "http://a/5", "<p>x</p>", None, None), (8, "u", "z" * 300000, None, None),
]


@pytest.mark.parametrize("version", [1, 2])
def test_pages_come_back(spark, tmp_path, version):
    pages = spark.createDataFrame(ROWS, PAGES).repartition(3)
    w.archive_pages(pages, str(tmp_path / "warc"), version=version)
    rows = w.read_pages(spark, str(tmp_path / "warc")).collect()
    first = {}
    for p, _, t, *_ in ROWS:
        if p is not None:
            first[t or ""] = min(p, first.get(t or "", p))
    want = []
    for p, _, t, *_ in ROWS:
        raw = (t or "").encode()
        again = p != first[t or ""]
        want.append((p or -1, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first[t or ""] if again else -1))
    assert sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1) for r in rows) == sorted(want)
    texts = {r.page_id: r.html for r in rows if r.record_type == "response"}
    assert all(texts[p] == (t or "") for p, _, t, *_ in ROWS if p in texts)
    w.archive_pages(pages.limit(0), str(tmp_path / "none"))
    assert w.read_pages(spark, str(tmp_path / "none")).count() == 0


def test_legacy_archives(spark, tmp_path):
    block = b"HTTP/1.0 200 OK\r\nContent-Type: image/png\r\n\r\n\x00\xff\xfe\n\nbinary"
    records = [{"url": "http://x/", "ip": "1.2.3.4", "date": "20031231235959", "type": "image/png", "block": block}, {"url": "dns:x", "date": "2003", "type": "text/dns", "block": b"x. 1 IN A 1.2.3.4"}]
    for version in (1, 2):
        raw = w.arc_bytes(records, version)
        back = list(w.parse_arc(io.BytesIO(raw)))
        assert [r["block"] for r in back] == [block, b"x. 1 IN A 1.2.3.4"] and back[0]["ip-address"] == "1.2.3.4"
        path = tmp_path / f"v{version}"
        path.mkdir()
        (path / "a.arc").write_bytes(raw)
        (path / "b.arc.gz").write_bytes(gzip.compress(raw))
        out = [bytes(r.record) for r in w.convert_archives(spark.read.format("binaryFile").load(str(path))).collect()]
        assert len(out) == 4
        heads = [next(w.parse_warc(io.BytesIO(r + b"\r\n\r\n")))[0] for r in out]
        assert {x["warc-type"] for x in heads} == {"response", "resource"}
        assert {x["warc-date"] for x in heads} == {"2003-12-31T23:59:59Z", "2003-01-01T00:00:00Z"}
        assert len({x["warc-record-id"] for x in heads}) == 2
        payload = block.split(b"\r\n\r\n", 1)[1]
        assert any(x["warc-payload-digest"] == "sha1:" + w.base32_sha1(payload) for x in heads)
    for bad in (b"x", b"filedesc://a 0 0 text/plain 3\n9 0", raw[:-10]):
        with pytest.raises(ValueError):
            list(w.parse_arc(io.BytesIO(bad)))
    assert list(w.parse_arc(io.BytesIO(b""))) == []


def test_held_out_pages():
    """Blocks of pages that the field has not seen."""
    model = h.default_model()
    right = total = 0
    for features, labels in h.labelled_pages(200, 4242):
        right += sum(a == b for a, b in zip(model.decode(features), labels, strict=True))
        total += len(labels)
    assert right / total > 0.99


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><!-- <p>no</p> --><nav><ul><li><a href="/">Home</a><li><a href="/b">B &amp; C</a></ul></nav>
    <script>var a = "<p>no</p>";</script><article><h1>Head&shy;line</h1><p>One  <b>two</b>
    three&nbsp;four<br>five &lt;x&gt; &#233;<p>Six</article><p style="display:none">hid<textarea>q</textarea></body>"""
    texts = [b.text for b in h.blocks_of(page)]
    assert texts == ["Home", "B & C", "Head\xadline", "One two three four five <x> é", "Six", "hid", "q"]
    assert [b.text for b in h.blocks_of("a < b <p title='>'>c</p> d <i")] == ["a < b", "c", "d"]
    assert h.blocks_of(None) == [] and h.blocks_of("") == [] and h.blocks_of("<script>x") == []
    assert [b.text for b in h.blocks_of("<<<>>>")] == ["<<<>>>"]
    assert [b.text for b in h.blocks_of("<p>x <math>y</math> z<p>a<!-- never closed <p>b")] == ["x y z", "a"]


def test_viterbi_equals_enumeration():
    rng = random.Random(1)
    for _ in range(50):
        fs = [[rng.choice("abcdef") for _ in range(3)] for _ in range(rng.randint(1, 7))]
        model = h.Crf({c: rng.uniform(-2, 2) for c in "abcdef"}, tuple(rng.uniform(-1, 1) for _ in range(4)))
        s = model.scores(fs)

        def score(y, s=s, model=model):
            return sum(a for a, b in zip(s, y, strict=True) if b) + sum(model.trans[2 * a + b] for a, b in zip(y, y[1:]))

        best = max((tuple(int(c) for c in f"{k:0{len(fs)}b}") for k in range(2 ** len(fs))), key=score)
        assert score(model.decode(fs)) == pytest.approx(score(best))


def test_main_text(spark):
    page = "<html><body><div class='menu'><a href='/'>Home</a></div><article><h1>Title</h1><p>Some words here.</p></article><div id='comments'><p>Nice one!</p></div><footer>&copy; us</footer></body></html>"
    rows = [(1, "u", page, "old", None), (2, None, None, None, None), (None, "u", "", None, None), (1, "u", page, None, None), (4, "u", "<p>" + "word " * 200000, None, None)]
    out = h.main_text(spark.createDataFrame(rows, PAGES))
    assert out.columns == ["page_id", "url", "payload_bytes", "text", "n_chars"]
    got = [(r.page_id, r.text, r.n_chars) for r in out.where("page_id <> 4 OR page_id IS NULL").collect()]
    assert sorted(got, key=str) == sorted([(1, "Title\nSome words here.", 22), (2, "", 0), (None, "", 0), (1, "Title\nSome words here.", 22)], key=str)
    assert out.where("page_id = 4").count() == 1
    assert h.main_text(spark.createDataFrame([], PAGES)).count() == 0


#: Pages written by hand, not by the generator that makes the training pages: (html, main text).
BY_HAND = [
    (
        """<!doctype html><html lang=en><head><meta charset=utf-8><title>Bread</title></head><body class="home blog">
<div id="page" class="site"><header id="masthead" class="site-header"><div class="logo"><a href="/">Crumbs</a></div>
<nav class="main-navigation"><ul><li><a href="/about">About us</a></li><li><a href="/recipes">Recipes</a></li></ul></nav></header>
<div class="content-area"><main><article class="post"><h1 class="entry-title">How to keep a starter alive</h1>
<div class="entry-content"><p>Feed it once a day with equal parts of flour and water.</p><p>If it smells of vinegar, feed it <em>twice</em>.</p>
<h2>In the fridge</h2><p>Cold slows it down &mdash; a week between feedings is fine.</p></div></article>
<div id="comments" class="comments"><h3>2 replies</h3><p>Worked for me, thanks!</p><p>Mine died anyway.</p></div></main></div>
<aside class="sidebar widget"><h3>Popular</h3><ul><li><a href="/1">Rye</a></li><li><a href="/2">Spelt</a></li></ul></aside>
<footer class="site-footer"><p>&copy; 2023 Crumbs. All rights reserved.</p></footer></div></body></html>""",
        "How to keep a starter alive\nFeed it once a day with equal parts of flour and water.\nIf it smells of vinegar, feed it twice.\nIn the fridge\nCold slows it down \u2014 a week between feedings is fine.",
    ),
    (
        """<html><body><div class="cookie-banner"><p>We use cookies to make this site better.</p><button>Accept</button></div>
<nav><a href="/">Front page</a> <a href="/w">World</a> <a href="/s">Sport</a></nav>
<article><header><h1>Bridge reopens after two years</h1></header>
<p>The old bridge over the river was opened to traffic on Monday, two years after it had been closed for repairs.</p>
<div class="ad"><p>Buy one, get one free at the market hall!</p></div>
<p>About nine thousand cars a day are expected to use it, the council said.</p>
<blockquote><p>It took too long, but it is done.</p></blockquote></article>
<div class="share"><ul><li><a href="#">Share</a></li><li><a href="#">Mail</a></li></ul></div>
<form class="newsletter"><div>Get our mail</div><input type=text><button>Sign up</button></form>
<footer><ul><li><a href="/i">Imprint</a></li></ul><p>&copy; The Daily</p></footer></body></html>""",
        "Bridge reopens after two years\nThe old bridge over the river was opened to traffic on Monday, two years after it had been closed for repairs.\nAbout nine thousand cars a day are expected to use it, the council said.\nIt took too long, but it is done.",
    ),
    (
        """<body><div class=menu><ul><li><a href=a.html>Install</a><li><a href=b.html>Use</a></ul></div>
<div class="content"><h1>Installing the tool</h1><p>Unpack the archive &amp; run the script:<pre>sh ./install   --all</pre>
<p>It asks for these things:<ul><li>a folder to write to<li>a port that is free</ul><p>Then it is done.</div>
<div class=footer>&copy; the authors</div></body>""",
        "Installing the tool\nUnpack the archive & run the script:\nsh ./install --all\nIt asks for these things:\na folder to write to\na port that is free\nThen it is done.",
    ),
    ("<html><body><main><h1>Nur eine \u00dcberschrift</h1><p>Und ein Satz dazu.</p></main><script>var p='<p>nein</p>'</script></body></html>", "Nur eine \u00dcberschrift\nUnd ein Satz dazu."),
    ("<nav><ul><li><a href='/'>Start</a></li></ul></nav><footer><p>&copy; 2020 nobody</p></footer>", ""),
]


@pytest.mark.parametrize("k", range(len(BY_HAND)))
def test_pages_by_hand(k):
    html, want = BY_HAND[k]
    assert h.extract(html, h.default_model()) == want


@pytest.mark.parametrize("unit", ["<div class='a%d'>x", "<x-a>", "<svg>", "<a ", "<a '", "<ul><li>", "<li><x-a>", "<dl><dt>", "<p>x", "<!--", "</b>", "&amp;", "<b>"])
def test_deep_and_broken_pages_take_linear_time(unit):
    html, model = "".join(unit % i if "%d" in unit else unit for i in range(100_000)), h.default_model()
    began = time.time()
    h.extract(html, model)
    assert time.time() - began < 20


def test_archives_are_members_of_bounded_files(spark, tmp_path, monkeypatch):
    """Each record is a gzip member of its own, files end after some bytes, and a whole file is one gzip stream."""
    monkeypatch.setattr(w, "ROWS_PER_FILE", 2)
    rng = random.Random(2)
    rows = [(i, f"http://a/{i}", "".join(rng.choice("abcdefghij <>") for _ in range(3000)), None, None) for i in range(60)]
    path = tmp_path / "warc"
    records = spark.createDataFrame([(bytearray(w.to_warc({"url": r[1], "archive-date": "2024", "ip-address": "0.0.0.0", "content-type": "text/html", "block": r[2].encode()})),) for r in rows], "record binary").coalesce(1)
    big = records.unionByName(records).coalesce(1)
    w.write_warc(big, str(path))
    files = sorted(path.glob("part-*"))
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert raw.count(b"WARC/1.1\r\n") == 120 and raw.endswith(b"\r\n\r\n")
    members = sum(f.read_bytes().count(w._member(b"")[:10]) for f in files)
    assert members >= 120
    assert len(list(w.parse_warc(io.BytesIO(raw)))) == 120


#: Pages whose text nothing holds, and what is theirs.
WITHOUT_CONTAINER = [
    ("<p>" + "one long paragraph of words " * 300 + "</p>", ("one long paragraph of words " * 300).strip()),
    ("plain text without any tags, and that is all of it.", "plain text without any tags, and that is all of it."),
    ("<div><p>Only one paragraph here.</p></div>", "Only one paragraph here."),
    ("<body><p>The first one counts.</p><p>So does the second.</p><p>And the third.</p></body>", "The first one counts.\nSo does the second.\nAnd the third."),
    ("<html><head><title>t</title></head><body><h1>A title</h1>Words at body level.<p>A paragraph.</body></html>", "A title\nWords at body level.\nA paragraph."),
    ("x", "x"),
]


@pytest.mark.parametrize("html,text", WITHOUT_CONTAINER)
def test_pages_without_a_container(html, text):
    assert h.extract(html, h.default_model()) == text


def test_references_end_with_their_text_node():
    assert [b.text for b in h.blocks_of("<p>&l<b>t;</b> &am<!-- -->p; &amp;lt;</p>")] == ["&lt; &amp; &lt;"]
