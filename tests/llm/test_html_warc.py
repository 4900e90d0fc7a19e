import base64
import gzip
import hashlib
import random

import pytest

from tessera.llm import html, warc

r = random.Random(11)
WORDS = "the of ä, ring then. über &amp; x &lt;y&gt; onder ist".split()


def say(n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def plain(text):
    import html as h

    return " ".join(h.unescape(text).split())


def page(kind):
    title, paragraphs = say(8), [say(r.randrange(1, 90)) for _ in range(r.randrange(1, 9))]
    body = f"<h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs)
    if kind == 1:
        body = f"<h1>{title}</h1><p><b>{paragraphs[0]}<br>" + "".join(f"<p class='t'>{p}\n</P>" for p in paragraphs[1:])
    if kind == 2:
        body = f"<header><h1>{title}</h1></header>" + "<div class=ad>buy this now and more</div>".join(f"<p>{p}</p>" for p in paragraphs) + "<aside><p>see also this other thing</p></aside>"
    nav = "<nav><ul>" + "".join(f'<li><a href="/{i}">{say(1)}</a></li>' for i in range(6)) + "</ul></nav>"
    form = "<form><label>Mail</label><input type=text><button>Send it</button></form><div id='comments'><p>" + say(40) + "</p></div>" if kind != 1 else ""
    top = "<div class='cookie-notice'>We use cookies on this page</div>" + (f"<header><p>{say(5)}</p></header>" if kind == 2 else "")
    wrap = ("main", "main") if kind == 3 else ("article", "article")
    text = f'<!DOCTYPE html><html><head><title>T {title}</title><script>var t="</p><article>";</script><style>p{{}}</style></head><body>{top}{nav}<!-- <p>no</p> --><div class="ad">{say(9)}</div><{wrap[0]}>{body}</{wrap[1]}>{form}<footer>&copy; me &middot; {say(6)}</footer></body></html>'
    return text, "\n\n".join(t for t in [plain(title), *map(plain, paragraphs)] if t)


def test_articles_are_found(spark):
    pages = [page(i % 4) for i in range(200)]
    df = spark.createDataFrame([(i, f"u{i}", p[0], 1) for i, p in enumerate(pages)], "page_id long, url string, html string, text int")
    weights = html.fit(df)
    assert weights.word > 0 and all(w < 0 for w in weights.tags.values())
    for x in html.main_text(df, weights).collect():
        assert x.text == pages[x.page_id][1]
        assert x.n_chars == len(x.text)


def test_pages_without_labels_get_plain_weights():
    text = "<div><a>x</a><a>y</a></div><div><p>" + "one two three " * 9 + "</p><p>" + "four five " * 9 + "</p></div><div><a>z</a></div>"
    assert html.extract(text, html.Weights()) == ("one two three " * 9).strip() + "\n\n" + ("four five " * 9).strip()


def test_odd_pages(spark):
    rows = [(None, None, None), (1, None, ""), (2, "u", "<p"), (3, "u", "<p>a<p>b"), (4, "u", "just words &eacute;&nbsp;&#x41;"), (5, "u", "<script>x"), (6, "u", "<!-- x"), (7, "u", "<p class='a>b c"), (3, "u", "<p>a<p>b"), (8, "u", "<article>" + "<div>" * 2000 + "deep words here" + "</div>" * 2000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html.main_text(df, html.Weights(tags={"p": -0.1})).collect()
    assert len(got) == len(rows)
    by = {x.page_id: x.text for x in got}
    assert by[None] == by[1] == by[5] == by[6] == ""
    assert by[3] == "a\n\nb" and by[4] == "just words é A"
    assert html.main_text(df.limit(0), html.Weights()).count() == 0
    assert html.fit(df.limit(0)) == html.Weights()


def test_region_is_the_best_of_all():
    for _ in range(300):
        s = [r.choice([-3.0, -1.0, -0.5, 0.0, 1.0, 2.0]) for _ in range(r.randrange(0, 12))]
        a, b = html.best_region(s)
        best = max([0.0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1))])
        assert sum(s[a:b]) == pytest.approx(best)


def test_framing():
    for n in (0, 1, 10, 4095, 4096, 4097, 50_000):
        data = ("é" * n).encode()
        assert warc.unchunked(warc.chunked(data)) == data
        assert b"".join(warc.pieces(data, 1000)) == data
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_archives_come_back_whole(spark):
    rows = [(i, f"http://h/{i}", say(r.randrange(0, 40_000 if i % 10 == 0 else 60))) for i in range(1, 60)]
    rows += [(100, None, None), (101, "a\r\nb", ""), (102, "u", "WARC/1.1\r\n\r\n\r\n\r\nx"), (103, "u", rows[0][2]), (104, "u", rows[0][2]), (104, "u", rows[0][2]), (None, "u", rows[0][2]), (None, None, "only here")]
    df = spark.createDataFrame([(*x, "p") for x in rows], "page_id long, url string, html string, payload_bytes string")
    got = warc.round_trip(df).collect()
    assert len(got) == len(rows)
    want = []
    for i, _, t in rows:
        raw = (t or "").encode()
        same = [x[0] for x in rows if (x[2] or "") == (t or "") and x[0] is not None]
        top = max(same, default=None)
        again = top is not None and i != top
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", top if again else None))
    key = lambda x: tuple((v is None, v or "") for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    plain = warc.round_trip(df, revisit_bytes=1 << 40).collect()
    assert all(x.record_type == "response" for x in plain) and len(plain) == len(rows)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_files_are_plain_warc(spark, tmp_path):
    path = str(tmp_path / "w")
    big = say(9_000)
    warc.write(spark.createDataFrame([(1, "http://h", big)], "page_id long, url string, html string").coalesce(1), "file://" + path)
    files = [f for f in (tmp_path / "w").iterdir() if f.name.endswith(".gz")]
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n") and raw.count(b"WARC-Type: continuation") >= 2
    found = [x for f in files for x in warc.parse(f.read_bytes())]
    assert b"".join(b for _, b in found).endswith(b"0\r\n\r\n")
    assert found[-1][0]["warc-segment-total-length"] == str(sum(len(b) for _, b in found))


def test_a_lost_segment_is_noticed(spark, tmp_path):
    rows = warc.records(1, 0, "u", say(9_000), base64.b32encode(hashlib.sha1(b"").digest()).decode(), None, False)
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.gz").write_bytes(gzip.compress(("\r\n\r\n".join(rows[:-1]) + "\r\n\r\n").encode()))
    with pytest.raises(Exception, match="lacks a segment"):
        warc.read(spark, f"file://{tmp_path}/x").collect()


def _record(kind, name, block, *extra):
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", *extra, f"content-length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@pytest.mark.parametrize("form", ["records", "whole", "plain"])
def test_ordinary_archives_are_read(spark, tmp_path, form):
    body = b"<p>hello</p>"
    parts = [
        _record("warcinfo", "urn:uuid:0", b"software: x\r\n"),
        _record("request", "urn:uuid:1", b"GET / HTTP/1.1\r\n\r\n"),
        _record("response", "urn:uuid:2", b"HTTP/1.1 200 OK\r\nContent-Length: 12\r\n\r\n" + body),
        _record("response", "urn:uuid:3", b"HTTP/1.1 200 OK\r\ntransfer-encoding: Chunked\r\n\r\nc\r\n" + body + b"\r\n0\r\n\r\n"),
        _record("revisit", "urn:uuid:4", b"HTTP/1.1 200 OK\r\n\r\n", "WARC-Refers-To: <urn:uuid:2>", "WARC-Payload-Digest: sha1:X"),
    ]
    raw = b"".join(map(gzip.compress, parts)) if form == "records" else gzip.compress(b"".join(parts)) if form == "whole" else b"".join(parts)
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / ("a.warc" if form == "plain" else "a.warc.gz")).write_bytes(raw)
    got = sorted((x.record_type, x.payload_bytes or 0) for x in warc.read(spark, f"file://{tmp_path}/w").collect())
    assert got == [("response", 12), ("response", 12), ("revisit", 0)]
    with pytest.raises(ValueError):
        list(warc.parse(gzip.compress(b"".join(parts))[:-20]))


def test_references_name_records_that_are_there(spark, tmp_path):
    rows = [(k % 7 if k % 5 else None, f"u{k}", ["", "same", f"own {k}"][k % 3]) for k in range(60)]
    path = f"{tmp_path}/w"
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), "file://" + path)
    found = [f for file in (tmp_path / "w").iterdir() if file.name.endswith(".gz") for f, _ in warc.parse(file.read_bytes())]
    names = [f["warc-record-id"] for f in found]
    assert len(set(names)) == len(names) == 60
    named = {f["warc-refers-to"] for f in found if f["warc-type"] == "revisit"}
    assert named and named <= {f["warc-record-id"] for f in found if f["warc-type"] == "response"}


def test_many_copies_of_one_payload(spark):
    df = spark.range(3000).selectExpr("id AS page_id", "'u' AS url", "IF(id % 3 = 0, CAST(NULL AS STRING), 'x') AS html")
    got = warc.round_trip(df).groupBy("record_type", "payload_bytes").count().collect()
    assert sorted(map(tuple, got)) == [("response", 0, 1), ("response", 1, 1), ("revisit", 0, 999), ("revisit", 1, 1999)]


@pytest.mark.parametrize("piece", ["<script ", "<a ", "<a href=\"", "<!-- ", "<div>", "<div></p></b>", "<header>", "</", "<style>x</style", "<p>", "<div class='ad'>"])
def test_broken_pages_take_linear_time(piece):
    import time

    def seconds(n):
        began = time.process_time()
        html.extract("<p>first words here</p>" + piece * n, html.Weights(tags={"p": -0.1}))
        return time.process_time() - began

    seconds(100)
    assert seconds(60_000) < 4


def test_long_pages_are_read_whole():
    paragraphs = [say(60) for _ in range(2000)]
    text = "<body><nav><a>x</a></nav><article>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article><footer>f</footer></body>"
    assert len(text) > 100_000
    assert html.extract(text, html.Weights(tags={"p": -0.1})) == "\n\n".join(map(plain, paragraphs))


def test_names_that_only_hold_a_word_of_the_list_drop_nothing():
    body = "<p>" + "one two three " * 20 + "</p>"
    text = ("one two three " * 20).strip()
    w = html.Weights(tags={"p": -0.1, "div": -0.1, "nav": -0.1})
    for attributes in ("id=related-work", "class=search-engines-history", "class='content no-sidebar'", "class='post-with-comments'", "class='has-sidebar'"):
        assert html.extract(f"<body><div {attributes}>{body}</div></body>", w) == text, attributes
        assert html.extract(f"<body><p>{'start words ' * 9}</p><div {attributes}>{body}</div></body>", w).endswith(text)
    # even an element with such a name stays if it holds most of the page or its article
    assert html.extract(f"<body><div class=widget><article>{body}</article></div></body>", w) == text
    for attributes in ("class='ad-banner'", "id=cookie-notice", "class='x sidebar-left'", "class=comment-list", "role=navigation"):
        assert html.extract(f"<body>{body}<div {attributes}><p>buy this now</p></div></body>", w) == text, attributes
