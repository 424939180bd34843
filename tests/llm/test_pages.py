"""WARC round trips and main texts of pages."""

import base64
import gzip
import hashlib
import itertools
import random
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from soquy.llm import mincut, queries, warc

SCHEMA = "page_id long, url string, html string, key string, digest string, n string, text string"
PAGES = [
    (1, "http://a/1", "<p>One page.</p>"),
    (2, "http://a/2", "<p>One page.</p>"),
    (7, None, "<p>One page.</p>"),
    (3, "http://a/\r\n3", None),
    (4, "http://a/4", ""),
    (5, "", "WARC/1.1\r\n\r\nresponse\r\n\r\n\r\n\r\né日\x00"),
    (6, "http://a/6", "x" * 300_000),
    (None, "http://a/n", "<p>No id.</p>"),
    (None, "http://a/n", "<p>One page.</p>"),
    (8, "http://a/8", "same row"),
    (8, "http://a/8", "same row"),
    (9, "http://a/9", "\r\n\r\n"),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "k", "d", "n", "t") for r in rows], SCHEMA).repartition(3)


def expected(rows):
    by_text = defaultdict(list)
    for key, _, html in rows:
        by_text[html or ""].append(key)
    out = Counter()
    for key, _, html in rows:
        raw, keys = (html or "").encode(), [k for k in by_text[html or ""] if k is not None]
        best = max(keys, default=None)
        revisit = key != best
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out[(key, len(raw), digest, "revisit" if revisit else "response", best if revisit else None)] += 1
    return out


def test_captures(spark, tmp_path):
    folder = str(tmp_path)
    pages(spark).write.parquet(f"{folder}/pages.parquet")
    assert Counter(tuple(r) for r in queries.warc_captures(spark, folder).collect()) == expected(PAGES)


def test_records_and_payloads(spark):
    folder = warc.write_captures(pages(spark), "page_id", "url", "html")
    captures = warc.assemble(warc.read_records(spark, folder)).collect()
    assert len(captures) == len(PAGES)
    whole = {r["page_id"]: (r["html"] or "") for r in pages(spark).collect() if r["page_id"]}
    for c in captures:
        key = c["metadata"]["fields"].get("key")
        if c["response"]["record_type"] == "response" and key:
            assert bytes(c["response"]["payload"]).decode() == whole[int(key)]
        assert c["request"]["concurrent_to"] == c["capture_id"] == c["metadata"]["concurrent_to"]
        assert (c["response"]["refers_to"] is not None) == (c["response"]["record_type"] == "revisit")
    files = spark.read.format("binaryFile").load(folder).filter("path like '%.gz'").select("content").collect()
    parsed = [r for f in files for r in warc.parse_archive(gzip.decompress(f["content"]))]
    assert Counter(r[0] for r in parsed)["metadata"] == len(PAGES)


def test_smallest_payload_that_is_revisited(spark):
    folder = warc.write_captures(pages(spark), "page_id", "url", "html", smallest=10)
    kinds = Counter((r["payload_bytes"], r["record_type"]) for r in warc.read_records(spark, folder).collect())
    assert kinds[(8, "response")] == 2 and kinds[(0, "response")] == 2 and kinds[(16, "revisit")] == 3


def test_cut_archives_and_lone_records(spark):
    with pytest.raises(ValueError):
        list(warc.parse_archive(b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <a>\r\nContent-Length: 9\r\n\r\nkey"))
    with pytest.raises(ValueError):
        list(warc.parse_archive(b"junk\r\n\r\n"))
    lone = [("response", "<r>", None), ("metadata", "<m>", "<gone>"), ("request", "<q>", None)]
    records = spark.createDataFrame(
        [(k, i, c, None, None, None, None, 1, None, {}) for k, i, c in lone], warc.RECORDS
    )
    assert [(r["capture_id"], r["request"], r["metadata"]) for r in warc.assemble(records).collect()] == [("<r>", None, None)]


def test_no_pages(spark, tmp_path):
    folder = str(tmp_path)
    pages(spark, []).write.parquet(f"{folder}/pages.parquet")
    assert queries.warc_captures(spark, folder).count() == 0
    assert queries.main_texts(spark, folder).count() == 0


def test_main_text(spark):
    page = """<html><head><title>T</title></head><body class="no-ads"><header><h1>Site</h1></header>
      <div id="cookieNotice"><p>We use cookies, please accept all of them now.</p></div>
      <div class="sidebar"><p>Popular posts and other things that make a long sentence here.</p></div>
      <main><h2>Title</h2><!-- <p>no</p> --><p>First  part with <a href=x>linked words</a> inside.<br>And&nbsp;more &eacute;&#x41;</p>
      <form><p>Sign up for it now, it is free.</p></form><script>if (a < b) { "</p>" }</script><p>Ok.
      <section class="comments"><p>I think this is great, thanks for writing all of it!</p></section></main>
      <aside><p>Aside text that is long, really long.</p></aside><footer>c</footer></body>"""
    assert mincut.main_text(page) == "Title\nFirst part with linked words inside. And more éA\nOk."
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", "<p>cut off <b"), (5, "u", "a < b and plain words.")]
    found = {r["page_id"]: r for r in mincut.extract_main_text(pages(spark, rows)).collect()}
    assert found[2]["text"] == "" and found[3]["n_chars"] == 0 and found[1]["n_chars"] == len(mincut.main_text(page))
    assert found[1]["key"] == "k"


def test_articles_of_the_given_pages(spark):
    import html
    import re

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in mincut.extract_main_text(rows.withColumn("page", F.col("html"))).collect():
        body = r["page"].split("<article>", 1)[1].split("</article>", 1)[0]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", body.replace("<br>", " ")))
        lines = [" ".join(html.unescape(p).split()) for p in parts]
        assert r["text"] == "\n".join(x for x in lines if x)


def test_minimum_cut():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 9)
        scores = [rng.randint(-20, 20) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.randint(0, 15)) for _ in range(rng.randint(0, 14))]

        def cost(side, scores=scores, edges=edges):
            ends = sum(max(s, 0) if not inside else max(-s, 0) for s, inside in zip(scores, side, strict=True))
            return ends + sum(w for a, b, w in edges if side[a] != side[b])

        best = min(cost(side) for side in itertools.product([False, True], repeat=n))
        assert cost(mincut.minimum_cut(scores, edges)) == best


def written(kind, block, *headers):
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{kind}>", *headers, f"Content-Length: {len(block)}"]
    return ("WARC/1.0\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def elsewhere():
    """An archive as other writers have it."""
    http = "Content-Type:application/http;msgtype=response"
    return [
        written("warcinfo", b"software: x\r\n"),
        written("request", b"GET / HTTP/1.1\r\nHost:a\r\n\r\n", "WARC-Concurrent-To:<response>"),
        written("response", b"HTTP/1.1 200 OK\r\nServer:nginx\r\nSet-Cookie: a\r\nSet-Cookie: b: c\r\nodd\r\n\r\nbody\r\n\r\nmore", http),
        written("revisit", b"HTTP/1.1 200 OK\r\nServer: nginx\r\n\r\n", http, "WARC-Payload-Digest: sha1:abc"),
        written("revisit", b""),
        written("response", b"20240101\r\n\r\na. 1 IN A 1.2.3.4", "Content-Type: text/dns", "WARC-Target-URI: dns:a"),
        written("metadata", b"a: 1\nb:2: 3\n", "WARC-Concurrent-To: <response>"),
    ]


def test_archives_from_elsewhere(spark, tmp_path):
    records = elsewhere()
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    (tmp_path / "each.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "whole.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (tmp_path / "notes.txt").write_text("no archive")
    rows = warc.read_records(spark, str(tmp_path)).collect()
    assert len(rows) == 3 * len(records)
    kinds = Counter((r["record_type"], r["payload_bytes"], bytes(r["payload"]) if r["payload"] is not None else None) for r in rows)
    assert kinds[("response", 12, b"body\r\n\r\nmore")] == kinds[("response", 29, b"20240101\r\n\r\na. 1 IN A 1.2.3.4")] == 3
    assert kinds[("revisit", None, None)] == 6
    fields = [r["fields"] for r in rows if r["payload"] is not None and bytes(r["payload"]).startswith(b"body")]
    assert fields == [{"Server": "nginx", "Set-Cookie": "a, b: c"}] * 3
    assert {r["payload_digest"] for r in rows if r["record_type"] == "revisit"} == {"ABC", None}
    assert [r["fields"] for r in rows if r["record_type"] == "metadata"] == [{"a": "1", "b": "2: 3"}] * 3
    (tmp_path / "each.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records)[:-9])
    with pytest.raises(Exception):  # noqa: B017
        warc.read_records(spark, str(tmp_path)).collect()


LONG = "This is a sentence of an article that has a good number of words in it, as they have."


@pytest.mark.parametrize("tag", ["select", "canvas", "svg", "video", "object", "template"])
def test_elements_that_are_left_open_cost_their_tag_only(tag):
    page = f"<body><article><p>{LONG}</p><{tag} class=x><p>{LONG} Two.</p></article><p>{LONG} Three.</p></body>"
    assert f"{LONG} Two." in mincut.main_text(page)
    closed = f"<body><article><p>{LONG}</p><{tag}><p>gone</p></{tag}><p>{LONG} Two.</p></article></body>"
    assert mincut.main_text(closed) == f"{LONG}\n{LONG} Two."
    twice = f"<body><article><{tag}><p>{LONG}</p><{tag}>gone</{tag}><p>{LONG} Two.</p></article></body>"
    assert mincut.main_text(twice) == f"{LONG}\n{LONG} Two."


def test_formulas_keep_their_text():
    page = f"<article><p>{LONG} Here <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p></article>"
    assert mincut.main_text(page) == f"{LONG} Here x=1 holds."


@pytest.mark.parametrize("name", ["social-history", "share-prices", "comment-on-a-law", "adHoc"])
def test_articles_are_not_lost_by_a_part_of_a_name(name):
    page = f'<body><main><div class="{name}"><p>{LONG}</p><p>{LONG} Two.</p></div></main><p>{LONG} Three.</p></body>'
    assert f"{LONG}\n{LONG} Two." in mincut.main_text(page)


@pytest.mark.parametrize("name", ["comments", "commentList", "user-comments", "ad-slot", "related_posts", "cookie-banner box", "newsletter-form"])
def test_boilerplate_by_its_name(name):
    page = f'<body><main><p>{LONG}</p><div class="{name}"><p>{LONG} Two.</p></div></main></body>'
    assert mincut.main_text(page) == LONG


def test_articles_without_an_article_element():
    rng = random.Random(9)
    for _ in range(20):
        n = rng.randint(2, 6)
        body = "".join(f"<{t}>{LONG} {k}.</{t}>" for k in range(n) for t in [rng.choice(["p", "div", "blockquote"])])
        links = "".join(f"<li><a href=x>Link {k}</a></li>" for k in range(12))
        page = f"<body><div class=top-bar><ul>{links}</ul></div><div>{body}</div><div><ul>{links}</ul></div><div id=footer>(c) {LONG}</div></body>"
        assert mincut.main_text(page) == "\n".join(f"{LONG} {k}." for k in range(n))


@pytest.mark.parametrize("opening", ["<div>x", "<div><p>word and word", "<section>", "<ul><li>a", "<select>x", "<svg>", "</div>"])
def test_deep_and_broken_pages_take_linear_time(opening):
    begun = time.perf_counter()
    mincut.main_text(opening * 20_000 + "</section>" * 2_000)
    assert time.perf_counter() - begun < 2
