"""Media, archive and page operators: exact round trips and literal pages."""

from __future__ import annotations

import io
import math
import os
import random
from collections import Counter

import numpy as np
import pytest
import zstandard

from memlake.llm import html_extract as hx
from memlake.llm import media, warc


@pytest.mark.parametrize("raw", [b"", b"x", b"\xff" * 70 + b"ab", bytes(64), os.urandom(5000), "é".encode() * 3000])
def test_payload_round_trip(raw):
    padded = media.pad(raw)
    assert len(padded) % 64 == 0 and len(padded) > 0 and padded.startswith(raw)
    data = media.write_avi(padded)
    assert media.Video(data).payload() == padded and media.write_avi(padded) == data


def test_general_decoder_agrees_with_even_one():
    data = media.write_avi(media.pad(os.urandom(3000)))
    avi = media.Avi(data)
    head = media._Jpeg(media._HEAD)
    for k in range(len(avi.frames)):
        f = avi.frame(k)
        scan = f[len(media._HEAD) : f.rfind(b"\xff\xd9")]
        assert np.array_equal(head._general(scan), head.coefficients(scan))


def encode_gray(levels, size=16):
    """A baseline frame of flat blocks with ordinary tables: DC differences and end-of-block codes."""
    dc = bytes([0]) + bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12))
    ac = bytes([0x10]) + bytes([0, 1] + [0] * 14) + b"\x00"
    out, last = "", 0
    for v in levels:
        d = v - last
        last = v
        n = abs(d).bit_length()
        out += format(n, "04b") + (format(d if d > 0 else d + (1 << n) - 1, f"0{n}b") if n else "") + "00"
    out += "1" * (-len(out) % 8)
    scan = bytes(int(out[i : i + 8], 2) for i in range(0, len(out), 8)).replace(b"\xff", b"\xff\x00")
    seg = media._segment
    return b"\xff\xd8" + seg(0xDB, b"\0" + b"\x08" * 64) + seg(0xC0, bytes([8, 0, size, 0, size, 1, 1, 0x11, 0])) + seg(0xC4, dc + ac) + seg(0xDA, b"\x01\x01\x00\x00\x3f\x00") + scan + b"\xff\xd9"


def avi_of(frames):
    body = media._list(b"movi", b"".join(media._chunk(b"00dc", f) for f in frames))
    return b"RIFF" + (len(body) + 4).to_bytes(4, "little") + b"AVI " + body


def test_shots_of_foreign_frames():
    dark, light = encode_gray([-100, -100, -99, -101]), encode_gray([90, 90, 91, 89])
    video = media.Video(avi_of([dark] * 5 + [light] * 4 + [dark] * 3))
    assert [(a, b) for a, b, _ in video.shots()] == [(0, 4), (5, 8), (9, 11)]
    with pytest.raises(ValueError, match="no payload"):
        video.payload()


def test_media_on_edges(docs, nothing):
    files = media.with_media(docs)
    rows = media.clips(files).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    assert all(r.end_ms > r.start_ms and r.last_frame >= r.first_frame for r in rows)
    assert media.clips(media.with_media(nothing)).count() == 0
    broken = files.selectExpr("doc_id", "n_bytes", "substring(media, 1, 50) as media")
    assert media.clips(broken, strict=False).count() == 0


@pytest.mark.parametrize("with_dictionary", [True, False])
def test_archives(spark, with_dictionary):
    rows = [(k, f"http://h/{k}", f"<p>page {k % 7} " + "text " * 30) for k in range(40 if with_dictionary else 8)]
    rows += [(90, None, None), (91, "u", ""), (91, "u", ""), (None, "v\r\nX: y", "<p>page 1 " + "text " * 30), (95, "w", "日本")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as first", "2 as sha", "3 as payload")
    got = warc.read_archives(warc.write_archives(pages)).collect()
    assert len(got) == len(rows)
    first: dict[bytes, int] = {}
    for k, _, h in sorted((r for r in rows if r[0] is not None)):
        first.setdefault((h or "").encode(), k)
    for r in got:
        src = [h for k, _, h in rows if k == r.page_id][0] or ""
        want = first[src.encode()]
        assert r.payload_bytes == len(src.encode()) and r.payload_digest == warc.digest(src.encode())
        if r.page_id == want:
            assert r.record_type == "response" and r.refers_to is None and bytes(r.payload) == src.encode()
        else:
            assert r.record_type == "revisit" and r.refers_to == want and r.payload is None
    assert warc.read_archives(warc.write_archives(pages.where("false"))).count() == 0


def test_archive_validation():
    good = warc.record(1, "u", b"body", None, False)
    assert warc.parse(good)[0] == 1
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"HTTP/1.1"), good.replace(b"body\r\n", b"bodY\r\n"), good.replace(b"WARC-Type", b"WARC-Tipe")):
        with pytest.raises(ValueError):
            warc.parse(bad)
    one = zstandard.ZstdCompressor().compress(good)
    assert list(warc.frames(io.BytesIO(one + one))) == [good, good]
    packed = zstandard.ZstdCompressor().compress(b"not a dictionary but content" * 3)
    assert list(warc.frames(io.BytesIO(warc._skippable(packed) + one))) == [good]
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.frames(io.BytesIO(one[:-3])))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href=/x>menu</a></ul></nav><!-- <p>no</p> --><div class="ad">buy</div><div id="cookie-notice">cookies</div>
<article><header><h1>Head &amp;  line</h1></header><p>One <b>two
three<p>four &lt;x&gt;<br>five</p><ul><li>a<li>b</ul><article><p>nice!</p></article><form>mail<input></form></article>
<aside>side</aside><footer>&copy; me</footer></body></html>"""


def by_html(page):
    return hx.chosen(page, None)


def test_page():
    assert by_html(PAGE) == "Head & line\nOne two three\nfour <x> five\na\nb"
    assert by_html("<p>plain &eacute; text<p>cut &am") == "plain é text\ncut &am"
    assert by_html("<p>open <a href='x>y'>link</a> end<di") == "open link end"
    assert by_html("") == "" and by_html("<nav>only a menu</nav>") == "only a menu"
    deep = "<div>" * 3000 + "far down" + "</div>" * 3000
    assert by_html(deep) == "far down" and by_html("<p>" + "word " * 200_000) == ("word " * 200_000).strip()


def naive_importance(pages):
    """The formulas of the module text over lists of pages by host, without Spark."""
    def entropy(values):
        n = Counter(values)
        return -sum(k / len(values) * math.log(k / len(values)) for k in n.values())

    seen, above, html_says = {}, {}, {}
    for host, page in set(pages):
        nodes, _, has_main = hx.walk(page)
        for n in nodes:
            above[n.path] = n.above
            for where in (host, None):
                own = seen.setdefault((where, n.path), ([], []))
                own[0].extend([tuple(n.kids)] if n.kids else [])
                own[1].extend(["\n".join(n.texts)] if n.texts else [])
            html_says[host, n.path] = max(html_says.get((host, n.path), 0.0), hx.prior(n, has_main))

    def lively(where, path):
        most = max((entropy(v[0]) for (w, _), v in seen.items() if w == where and v[0]), default=0.0)
        around = 0.0
        while True:
            around = max(around, entropy(seen[where, path][0]) if seen[where, path][0] else 0.0)
            if path == 0:
                return hx.DAMPED + (1 - hx.DAMPED) * (around / most if most else 0.0)
            path = above[path]

    def varied(host, path):
        texts = seen[host, path][1]
        return (1 - math.exp(-entropy(texts))) / (1 - 1 / len(texts)) if len(texts) > 1 else 0.0

    out = {}
    hosts = {h for h, _ in pages}
    for (host, path), (_, texts) in seen.items():
        if host is None or not texts:
            continue
        have = [(len(seen[h, path][1]) - 1, varied(h, path)) for h in hosts if seen.get((h, path), ((), ()))[1]]
        every, more = sum(n for n, _ in have), len(texts) - 1
        pool = (sum(n * v for n, v in have) + hx.CONTENT_PRIOR) / (every + hx.CONTENT_PRIOR)
        content = (more * varied(host, path) + hx.CONTENT_PRIOR * pool) / (more + hx.CONTENT_PRIOR)
        alike = (every * lively(None, path) + hx.PRIOR * html_says[host, path]) / (every + hx.PRIOR)
        out[host, path] = content * (more * lively(host, path) + hx.PRIOR * alike) / (more + hx.PRIOR)
    return out


def test_importance_equals_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefgh") * rng.randrange(1, 4)
    pages = []
    for k in range(60):
        paragraphs = "".join(f"<p>{word()} {word()}" for _ in range(rng.randrange(6)))
        menu = "".join(f"<li>{word()}" for _ in range(rng.choice((2, 2, 3))))
        wrap = ("<div class=x>" * (k % 9), "</div>" * (k % 9))
        pages.append((f"h{k % 5 if k % 7 else 'lone' + str(k)}", f"<nav><ul>{menu}</ul></nav><div>{word()}</div>{wrap[0]}<article><h1>{word()}</h1>{paragraphs}</article>{wrap[1]}<footer>same</footer>"))
    pages += pages[:5]
    rows = spark.createDataFrame(pages, "host string, html string").selectExpr("xxhash64(host) as site", "html")
    names = {r.site: r.host for r in spark.createDataFrame(pages, "host string, html string").selectExpr("xxhash64(host) as site", "host").distinct().collect()}
    got = {(names[r.site], r.path & (1 << 64) - 1): r.worth for r in hx.importance(rows).collect()}
    want = naive_importance(pages)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    low = {k for k, v in want.items() if v < hx.LEAST}
    table = spark.createDataFrame([(k, f"http://{h}/{k}", p) for k, (h, p) in enumerate(pages)], "page_id long, url string, html string")
    texts = {r.page_id: r.text for r in hx.main_text(table).collect()}
    # Hosts too large for lists are joined by their pages' own nodes: all of them, and some.
    assert all({r.page_id: r.text for r in hx.main_text(table, listed=n).collect()} == texts for n in (0, 3))
    assert low and all(texts[k] == hx.chosen(p, {path: v for (host, path), v in want.items() if host == h and (host, path) in low}) for k, (h, p) in enumerate(pages))


def test_style_tree_removes_what_a_site_repeats(spark):
    page = lambda k: f"<div class=top>Welcome to the site</div><div class=body><p>story {k} of many words</p></div><div class=same>Our standing line</div>"
    rows = [(k, "http://a.example/x", page(k)) for k in range(8)] + [(100, "http://b.example/", page(0)), (101, None, None), (102, "odd url", "<p>x")]
    rows += [(k, "http://c.example/1", page(3)) for k in range(200, 212)]
    rows.append(rows[0])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as site", "3 as paths")
    got = {r.page_id: r.text for r in hx.main_text(pages).collect()}
    assert got[3] == "story 3 of many words"
    # One page of its own, and copies of one, say nothing about a site; there the same path of other hosts counts.
    assert got[100] == "story 0 of many words" and {got[k] for k in range(200, 212)} == {"story 3 of many words"}
    assert got[101] == "" and got[102] == "x"
    assert hx.main_text(pages).count() == len(rows) and hx.main_text(pages.where("false")).count() == 0


def test_equal_siblings_are_judged_apart(spark):
    last = lambda k: f"<body><div><p>own text {k}</p></div><div>(c) site</div></body>"
    first = lambda k: f"<body><div>Welcome</div><div><p>story {k}</p></div></body>"
    rows = [(k, "http://a.example/", last(k)) for k in range(6)] + [(10 + k, "http://b.example/", first(k)) for k in range(6)]
    got = {r.page_id: r.text for r in hx.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{k: f"own text {k}" for k in range(6)}, **{10 + k: f"story {k}" for k in range(6)}}


def comment_pages(layout, n, rng):
    """Pages of a host with one to five reader comments behind the article, at its end, or as plain elements at the end of main."""
    word = lambda k: " ".join(rng.choice("abcdefghij") + str(rng.randrange(500)) for _ in range(k))
    for k in range(n):
        body = "".join(f"<p>{word(rng.randint(10, 60))}</p>" for _ in range(rng.randint(2, 6)))
        some = "".join(f"<div class='comment'><b>{word(1)}</b><p>CMT {word(rng.randint(3, 15))}</p></div>" for _ in range(rng.randint(1, 5)))
        some = f"<div class='comments'>{some}</div>"
        if layout == 2:
            some = some.replace("<p>", "").replace("</p>", "")
        inside, behind = ("", some) if layout == 0 else (some, "")
        main = "main" if layout == 2 else "article"
        head = f"<html><body><nav>menu</nav><{main}><h1>{word(4)}</h1>{body}"
        yield k, f"{head}{inside}</{main}>{behind}<footer>foot</footer></body></html>", head


def test_reader_comments_go_and_articles_stay(spark):
    rng, rows, want = random.Random(1), [], {}
    word = lambda k: " ".join(rng.choice("abcdefghij") + str(rng.randrange(500)) for _ in range(k))
    for layout in range(3):
        for k, page, head in comment_pages(layout, 30, rng):
            rows.append((100 * layout + k, f"http://h{layout}/{k}", page))
            want[100 * layout + k] = "\n".join(t for n, t in hx.walk(head)[1] if n.main)
    for k in range(30):  # sections of one shape, and paragraphs that are divs, are the article
        parts = [f"<section><h2>{word(3)}</h2><p>{word(30)}</p></section>", f"<div class=para>{word(30)}</div>"]
        for host, part in enumerate(parts):
            page = f"<html><body><article><h1>{word(4)}</h1><p>{word(8)}</p>{part * 1}{part.replace(part[-40:-20], word(4))}{part}</article></body></html>"
            rows.append((300 + 100 * host + k, f"http://h{3 + host}/{k}", page))
            want[300 + 100 * host + k] = "\n".join(t for n, t in hx.walk(page)[1] if n.main)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for listed in (hx.LISTED, 0):
        assert {r.page_id: r.text for r in hx.main_text(pages, listed=listed).collect()} == want
