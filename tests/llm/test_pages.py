"""Archives and main texts of pages."""

from __future__ import annotations

import base64
import hashlib
import io
import random
import zipfile

import numpy as np
import pytest

from monthmatch.llm.html_blocks import blocks_of, extract_main_text, made_pages, trained_labeller
from monthmatch.llm.warc_zip import (
    ZipReader,
    archive_round_trip,
    parse_record,
    read_archives,
    warc_record,
    write_archives,
)


class _Bytes(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def zipped(members, comment=b"", large=False):
    out = _Bytes()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in members.items():
            with z.open(name, "w", force_zip64=large) as f:
                f.write(data)
        z.comment = comment
    return out


@pytest.mark.parametrize("large", [False, True])
@pytest.mark.parametrize("comment", [b"", b"PK\x05\x06 not the end" * 3])
def test_members_and_ranges(large, comment):
    members = {"a.txt": b"0123456789", "ü/b": b"", "c": bytes(range(256)) * 50}
    reader = ZipReader(zipped(members, comment, large))
    assert {n: reader.read(n) for n in members} == members
    assert reader.read("a.txt", 3, 4) == b"3456" and set(reader.members) == set(members)
    with pytest.raises(ValueError):
        reader.read("a.txt", 8, 4)


def test_zip64_directory():
    # Sizes, offset and counts moved to their 64-bit fields.
    data = zipped({"a": b"hello"}).getvalue()
    start = data.index(b"PK\x01\x02")
    local, entry = data[:start], bytearray(data[start : data.index(b"PK\x05\x06")])
    extra = b"\x01\x00\x18\x00" + (5).to_bytes(8, "little") * 2 + (0).to_bytes(8, "little")
    entry[20:28], entry[42:46], entry[30:32] = b"\xff" * 8, b"\xff" * 4, len(extra).to_bytes(2, "little")
    directory = bytes(entry) + extra
    record = b"PK\x06\x06" + (44).to_bytes(8, "little") + b"\x2d\x00\x2d\x00" + b"\x00" * 8
    record += b"".join(n.to_bytes(8, "little") for n in (1, 1, len(directory), start))
    locator = b"PK\x06\x07" + b"\x00" * 4 + (start + len(directory)).to_bytes(8, "little") + b"\x01\x00\x00\x00"
    end = b"PK\x05\x06" + b"\x00" * 4 + b"\xff" * 12 + b"\x00\x00"
    assert ZipReader(_Bytes(local + directory + record + locator + end)).read("a") == b"hello"


def test_damaged_packages():
    with pytest.raises(ValueError):
        ZipReader(_Bytes(b"nothing"))
    out = _Bytes()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"x" * 100)
    with pytest.raises(ValueError):
        ZipReader(out).read("a")


def test_records():
    warc, http, payload = parse_record(warc_record(7, "http://x/\r\nA: b", b"p\r\n\r\nq", None))
    assert payload == b"p\r\n\r\nq" and warc["warc-type"] == "response" and warc["warc-target-uri"] == "http://x/%0D%0AA:%20b"
    warc, http, payload = parse_record(warc_record(8, None, b"pq", 7))
    assert payload == b"" and http["content-length"] == "2" and warc["warc-refers-to"] == "<urn:x-page:7>"


@pytest.mark.parametrize("least", [0, 3])
def test_round_trip(spark, least):
    rows = [
        (3, "u3", "same"), (1, "u1", "same"), (2, None, "same"), (4, "u4", None), (5, "u5", ""), (6, "u6", "é" * 300_000),
        (1, "u1", "same"), (None, "u", "same"), (7, "u7", "ab"), (8, "u8", "ab"), (None, None, "alone"),
    ]
    df = spark.createDataFrame([(*r, "own") for r in rows], "page_id long, url string, html string, payload string")
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        refers = first.get(h or "") if len(data) >= least else None
        refers = None if refers == i else refers
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((i, len(data), digest, "response" if refers is None else "revisit", refers))
    got = archive_round_trip(df.repartition(3), least).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_payloads_and_small_packages(spark, tmp_path):
    df = spark.createDataFrame([(k, f"u{k}", f"page {k} " * 50) for k in range(40)], "page_id long, url string, html string")
    packages = write_archives(df.coalesce(1), f"file://{tmp_path}", package_bytes=500)
    assert packages.count() > 3 and sum(r.records for r in packages.collect()) == 40
    assert {r.page_id: r.payload.decode() for r in read_archives(packages).collect()} == {
        k: f"page {k} " * 50 for k in range(40)
    }
    assert archive_round_trip(df.limit(0)).count() == 0


# --- main texts ----------------------------------------------------------


def texts(page):
    return [b.text for b in blocks_of(page)]


def test_blocks():
    assert texts("<p>a <b>b</b>c<p>d&amp;&lt;e&nbsp; f<br>g</p>tail") == ["a bc", "d&<e f g", "tail"]
    assert texts("<script>if (a<b) '</p>'</script>x<style>p{}</style><!-- c > d -->y") == ["xy"]
    assert texts('<a title="x > y">t</a><ul><li>1<li>2<ul><li>3</ul><li>4</ul>') == ["t", "1", "2", "3", "4"]
    assert texts("a < b and 3<4 <script>open") == ["a < b and 3<4"]
    assert texts("x<div cla") == ["x"] and texts("") == [] and texts("<p> \n </p>") == []
    assert texts("<SCRIPT>x</Script>y<TEXTAREA><p>z</TEXTAREA>") == ["y"]
    nested = blocks_of('<div class="a b" id=c><p>t</div>u')
    assert nested[0].path == (("div", "a", "b", "c"), ("p",)) and nested[1].path == ()
    assert [len(b.path) for b in blocks_of("<ul><li>1<li>2</ul><p>a<p>b")] == [2, 2, 1, 1]


def test_held_out_pages_are_labelled_right():
    x, y = made_pages(150, 77)
    p = trained_labeller().probabilities(x)
    wrong = np.concatenate([(a > 0.5) != b for a, b in zip(p, y, strict=True)])
    assert wrong.mean() < 0.02


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body>
<div class="cookie-notice"><p>We use cookies on this site.</p></div><header><a href="/">Site</a></header>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="ad">Buy the thing now.</div>
<article><h1>The title &amp; more</h1><p>First   paragraph of the <b>article</b>,<br>with a line.<p>Second one &lt;here&gt;.
<div class="advert">Another offer for you.</div><p>Third paragraph of the text.</p></article>
<aside class="sidebar"><h3>Popular</h3><ul><li><a href="/c">Thing</a></li></ul></aside>
<section id="comments"><h3>Comments</h3><div class="comment"><p>I like this article a lot, thank you.</p></div></section>
<form action="/s"><label>Mail</label><input name="m"><button>Go</button></form><footer>Copyright 2024.</footer></body>"""


def test_a_page_with_everything(spark):
    pages = [PAGE, None, "", "<p", PAGE, "<nav><ul><li><a href='/'>Home</a></li></ul></nav><footer>x</footer>"]
    df = spark.createDataFrame([(k, None, h, "own") for k, h in enumerate(pages)], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in extract_main_text(df).collect()}
    want = "The title & more\nFirst paragraph of the article, with a line.\nSecond one <here>.\nThird paragraph of the text."
    assert got[0].text == got[4].text == want and got[0].n_chars == len(want)
    assert [got[k].text for k in (1, 2, 3, 5)] == [""] * 4
    assert extract_main_text(df.limit(0)).count() == 0


def test_long_and_deep_pages(spark):
    r = random.Random(1)
    paragraphs = [" ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(20)) + "." for _ in range(3000)]
    long = "<article>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article>"
    deep = "<div>" * 2000 + "x" + "</div>" * 2000
    df = spark.createDataFrame([(1, long), (2, deep)], "page_id long, html string")
    got = {r.page_id: r.text for r in extract_main_text(df).collect()}
    assert got[1].split("\n") == paragraphs and got[2] in ("", "x")
