"""HTML extraction and WARC transactions."""

from __future__ import annotations

import gzip
import hashlib
import random
import time

import pytest

from tablewright.llm import html, queries, warc
from tests.oracle import assert_same

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style></head><body class="home">
<header><h1>Site name</h1></header><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="cookie-notice">We use cookies, and you have to accept all of them, now, please.</div>
<div id="main"><div class="post"><h2>Head&shy;line &lt;1&gt;</h2><p>First   paragraph,
with <b>bold</b> and <a href="x">a link</a>. It goes on.</p><p>Second one, short.<ul><li>item<li>more items</ul>
<script>var t = "</p>";</script><table><tr><td>cell<td>cell two</table>after<br>break</div></div>
<div class="comments"><p>As a reader, I say: this is a long comment, with punctuation, and so on.</p></div>
<aside>Side</aside><div class="ad">Buy now!</div><form><label>Name</label><input></form>
<footer>&copy; Site</footer></body></html>"""
TEXT = "\n".join([
    "Head\xadline <1>", "First paragraph, with bold and a link. It goes on.", "Second one, short.", "item",
    "more items", "cell", "cell two", "after", "break",
])


@pytest.mark.parametrize(
    "page, text",
    [
        (PAGE, TEXT),
        (None, ""),
        ("", ""),
        ("plain &amp; text\n no tags", "plain & text no tags"),
        ("<nav>only menu</nav>", ""),
        ("<article><h1>T</h1><p><b>One.<br><p>Two, and more.</p></article><footer>f</footer>", "T\nOne.\nTwo, and more."),
        ("<p>unclosed <i>tags", "unclosed tags"),
        ("<p>a</p><!-- <p>hidden</p> --><p>b", "a\nb"),
        ("<p>1 < 2 & 3 &gt; 2</p>", "1 < 2 & 3 > 2"),
        ("<body><p>text<script>never closed", "text"),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


def test_long_pages():
    deep = "<div>" * 3000 + "<p>deep, text.</p>"
    assert html.main_text(deep) == "deep, text."
    many = "<article>" + "<p>Some words, here.</p>" * 5000 + "</article>"
    assert html.main_text(many).count("\n") == 4999


PAGES = "page_id long, url string, html string, text string, digest string, `first` int"


def pages(spark):
    same = "<p>" + "payload " * 20
    rows = [
        (1, "http://a/", same),
        (2, None, same),
        (3, "u v\r\nInjected: 1", same + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"),
        (4, "http://b/", None),
        (5, "http://b/", "short"),
        (6, "http://b/", "short"),
        (7, "x", "é" * 50),
        (8, "x", "é" * 50),
        (9, "x", "é" * 50 + "\n"),
        (9, "x", "é" * 50 + "\n"),
        (None, "x", PAGE),
        (10, "y", "z" * 300_000),
    ]
    return spark.createDataFrame([(*r, "t", "d", 0) for r in rows], PAGES).repartition(3)


def test_extraction_of_rows(spark):
    rows = html.main_texts(pages(spark)).collect()
    assert len(rows) == 12 and all(r.n_chars == len(r.text) for r in rows)
    assert html.main_texts(pages(spark).limit(0)).count() == 0


def test_archive_round_trip(spark):
    want = {}
    for r in pages(spark).collect():
        data = (r.html or "").encode()
        want.setdefault(hashlib.sha256(data).hexdigest(), []).append((r.page_id, len(data)))
    got = warc.captures(pages(spark)).collect()
    assert len(got) == 12
    for r in got:
        ids = [i for i, _ in want[r.payload_digest]]
        assert (r.page_id, r.payload_bytes) in want[r.payload_digest]
        assert r.digest_ok
        first = min((i for i in ids if i is not None), default=None)
        if r.payload_bytes < 100 or r.page_id == first and ids.count(first) == 1:
            assert r.record_type == "response" and r.refers_to is None
        elif r.page_id != first:
            assert r.record_type == "revisit" and r.refers_to == first
    nine = sorted(r.record_type for r in got if r.page_id == 9)
    assert nine == ["response", "revisit"]
    assert warc.captures(pages(spark).limit(0)).count() == 0


def test_transactions_are_whole(spark, tmp_path):
    path = str(tmp_path / "a")
    warc.write_archive(pages(spark), path)
    records = warc.read_archive(spark, path)
    assert records.count() == 36
    assert records.where("NOT whole").count() == 0
    nested = warc.assemble(records)
    assert nested.where("request IS NULL OR metadata IS NULL").count() == 0
    html_of = {r.page_id: r.html or "" for r in pages(spark).collect()}
    payloads = [r.capture.payload for r in nested.collect() if r.capture.record_type == "response"]
    assert set(payloads) <= set(html_of.values())
    lone = records.where("record_type != 'request'")
    assert warc.assemble(lone).where("request IS NULL").count() == 12


def other_archive(version="WARC/1.0"):
    """Records of another writer: gzip members, lower-case names, payloads that look like records."""
    inner = f"{version}\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n".encode()
    payloads = [b"<p>one</p>", inner + b"tail", b"", bytes(range(256)) * 3, inner * 3]
    out, members = [], []
    for i, p in enumerate(payloads):
        block = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" + p
        head = f"{version}\r\nwarc-type: response\r\nWARC-Record-ID: <urn:{i}>\r\ncontent-length:{len(block)}\r\n\r\n".encode()
        members.append(gzip.compress(head + block + b"\r\n\r\n"))
        out.append(p)
    info = f"{version}\r\nWARC-Type: warcinfo\r\nContent-Length: 8\r\n\r\nsoftware\r\n\r\n".encode()
    return gzip.compress(info) + b"".join(members), out


def test_archives_of_other_writers(spark, tmp_path):
    data, payloads = other_archive()
    for name in ("a", "b"):
        (tmp_path / f"{name}.warc.gz").write_bytes(data)
    rows = warc.read_archive(spark, str(tmp_path), version="WARC/1.0").collect()
    assert len(rows) == 2 * (len(payloads) + 1) and all(r.whole for r in rows)
    for i, p in enumerate(payloads):
        own = [r for r in rows if r.record_id == f"<urn:{i}>"]
        assert len(own) == 2
        assert {(r.payload_bytes, r.payload_digest) for r in own} == {(len(p), hashlib.sha256(p).hexdigest())}
        assert {r.payload for r in own} == {p.decode("utf-8", "replace")}
    assert {r.block for r in rows if r.record_type == "warcinfo"} == {"software"}
    narrow = warc.read_archive(spark, str(tmp_path), payloads=False, version="WARC/1.0")
    assert narrow.where("payload IS NOT NULL").count() == 0 and narrow.where("payload_digest IS NOT NULL").count() == 10


def test_records_cut_short(spark, tmp_path):
    whole = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <a>\r\nContent-Length: 4\r\n\r\nfour\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(whole + whole.replace(b"Length: 4", b"Length: 400").replace(b"<a>", b"<b>")))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(whole.replace(b"<a>", b"<c>")))
    rows = {r.record_id: r for r in warc.read_archive(spark, str(tmp_path)).coalesce(1).collect()}
    assert {k: (r.whole, r.payload) for k, r in rows.items() if k != "<b>"} == {"<a>": (True, "four"), "<c>": (True, "four")}
    assert not rows["<b>"].whole and rows["<b>"].payload.startswith("four")


def test_warc_query_equals_sql(spark, small):
    q = queries.QUERIES["op5_warc"]
    assert assert_same(q.run(spark, small), q.sql, small) > 0


ARTICLE = "<p>A first paragraph, long enough, with words.</p><p>A second paragraph, which goes on, and on.</p>"
ARTICLE_TEXT = "A first paragraph, long enough, with words.\nA second paragraph, which goes on, and on."


@pytest.mark.parametrize(
    "start, end",
    [
        ("<div class='post has-sidebar'>", "</div>"),
        ("<div class='layout-no-sidebars'>", "</div>"),
        ("<div class='content with-sidebar-right'>", "</div>"),
        ("<div id='page' class='header-fixed'>", "</div>"),
        ("<form action='x' id='aspnetForm'>", "</form>"),
        ("<form><div class='has-sidebar'><article>", "</article></div></form>"),
    ],
)
def test_wrappers_named_like_furniture(start, end):
    ad = "<div class='sidebar'><p>Buy this, now.</p></div>"
    assert html.main_text(f"<body>{start}{ARTICLE}{ad}{end}<footer>f</footer></body>") == ARTICLE_TEXT


def test_a_headline_in_an_entry_header_stays():
    page = f"<article><div class='entry-header'><h1>Headline</h1></div>{ARTICLE}</article>"
    assert html.main_text(page) == "Headline\n" + ARTICLE_TEXT


def test_long_comments_beside_an_article_go():
    comment = "<p>A comment, as long as it can be, and on and on, with words.</p>" * 6
    assert html.main_text(f"<article>{ARTICLE}</article><div class='comments'>{comment}</div>") == ARTICLE_TEXT


@pytest.mark.parametrize("piece", ["<a ", "<b>x", "<div>", "</div>", "<p>", "<div><p>x", "<td>", "<a href='", "<li><b>", "<!--", "<b></a>"])
def test_a_megabyte_of_open_tags_takes_linear_time(piece):
    page = "<div>" + piece * (1_000_000 // len(piece))
    began = time.process_time()
    html.main_text(page)
    assert time.process_time() - began < 20


@pytest.mark.parametrize(
    "page, text",
    [
        ("<body><div class='wrap'><header class='entry-header'><h1>Headline</h1></header><div class='entry-content'>{}</div></div></body>", "Headline\n{}"),
        ("<body><article><div class='promo-lead'>The lead, of one sentence.</div>{}</article></body>", "The lead, of one sentence.\n{}"),
        ("<body><article>{}</article><div id='discussion'><p>I, a reader, say this, at length.</p><p>And I, another, say that.</p></div></body>", "{}"),
    ],
)
def test_parts_of_the_article_and_what_is_beside_it(page, text):
    assert html.main_text(page.format(ARTICLE)) == text.format(ARTICLE_TEXT)


def test_blocks_keep_their_paths_at_any_depth():
    deep = "<div>" * 300 + ARTICLE + "</div>" * 300 + "<p class='x'>no</p>"
    assert html.main_text(deep) == ARTICLE_TEXT


def plain_content(found, names):
    """The ratios on paths as tuples of labels: path statistics, smoothing, fusion, threshold."""
    stats, order = {}, []
    for path, text, linked in found:
        q = names(path)
        if q not in stats:
            stats[q] = [0, 0, 0, 0]
            order.append(q)
        for i, x in enumerate((len(text), len(html.PUNCTUATION.findall(text)), 1, linked)):
            stats[q][i] += x
    ratio = {q: n / k * (1 + p / k) * (1 - a / n) for q, (n, p, k, a) in stats.items()}
    smooth = {}
    for i, q in enumerate(order):
        weights = [(2, ratio[q])] + [(1, ratio[order[j]]) for j in (i - 1, i + 1) if 0 <= j < len(order)]
        smooth[q] = sum(w * r for w, r in weights) / sum(w for w, _ in weights)
    every = {q[:d] for q in order for d in range(len(q) + 1)}
    strength = {c: sum(min(ratio[q], smooth[q]) * stats[q][0] for q in order if q[: len(c)] == c) for c in every}
    root = ()
    while True:
        below = [c for c in every if len(c) == len(root) + 1 and c[: len(root)] == root]
        if not below:
            break
        best = max(below, key=lambda c: (round(strength[c], 6), c))
        if strength[best] < html.KEEPS_MOST * strength[root] or not any(len(c) == len(best) + 1 and c[: len(best)] == best for c in every):
            break
        root = best
    own = [q for q in order if q[: len(root)] == root]
    mean = sum(smooth[q] * stats[q][0] for q in own) / sum(stats[q][0] for q in own)
    keep = {
        q: q in own or smooth[q] >= html.NEAR_RATIO * mean and ratio[q] >= html.NEAR_RATIO * mean and stats[q][3] < 0.3 * stats[q][0]
        for q in order
    }
    return [keep[names(path)] for path, _, _ in found]


@pytest.mark.parametrize("seed", range(40))
def test_ratios_equal_a_plain_version(seed):
    rng = random.Random(seed)

    def part(depth):
        if depth == 0 or rng.random() < 0.3:
            words = " ".join("word" * rng.randint(1, 2) for _ in range(rng.randint(1, 30)))
            return rng.choice(["<p>{}.</p>", "<p>{}, so. And more!</p>", "<li><a href='x'>{}</a></li>", "<h2>{}</h2>"]).format(words)
        inner = "".join(part(depth - 1) for _ in range(rng.randint(1, 4)))
        return "<div class='{}'>{}</div>".format(rng.choice(["x", "y", "z"]), inner)

    page = "<body>" + "".join(part(4) for _ in range(3)) + "</body>"
    found, paths = html.blocks(page)

    def names(path):
        out = []
        while path > 0:
            out.append(paths.label[path])
            path = paths.parent[path]
        return tuple(reversed(out))

    assert html.content(found, paths) == plain_content(found, names)
