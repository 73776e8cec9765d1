"""WARC derivatives: links between records, digests, lengths, text of pages."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import time
from html.parser import HTMLParser

from granary.llm import warc

from .fixtures import SF


def test_plain_text():
    page = "<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{x:1}</style><script>var t='</p>';</script></head><body><p>One<b> two</b><br>three<!-- no --><p>four&nbsp;five <"
    assert warc.plain(page) == "A & B\nOne two\nthree\nfour five <"
    assert warc.plain("") == "" and warc.plain("<p") == ""


def check(url, page, d):
    original = warc.response(url, page)
    headers, block = warc.parse(original)
    meta, notes = warc.parse(d.metadata)
    conv, text = warc.parse(d.conversion)
    assert meta["warc-type"] == "metadata" and conv["warc-type"] == "conversion"
    for h in (meta, conv):
        assert h["warc-refers-to"] == headers["warc-record-id"] == d.refers_to
        assert h["warc-target-uri"] == headers["warc-target-uri"]
        assert h["warc-date"] == headers["warc-date"]
    assert meta["warc-concurrent-to"] == conv["warc-record-id"] == d.conversion_id
    assert len({meta["warc-record-id"], conv["warc-record-id"], headers["warc-record-id"]}) == 3
    body = block.partition(b"\r\n\r\n")[2]
    assert body == page.encode()
    sha = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    assert headers["warc-payload-digest"] == sha(body) == d.payload_digest
    assert headers["warc-block-digest"] == sha(block)
    assert conv["warc-block-digest"] == sha(text) and meta["warc-block-digest"] == sha(notes)
    assert text.decode() == d.text == warc.plain(page)
    fields = [x.partition(": ")[::2] for x in notes.decode().split("\r\n") if x]
    assert ("source-payload-digest", sha(body)) in fields and ("digest-verified", "true") in fields
    assert sum(k == "outlink" for k, _ in fields) == d.n_links


def test_records_of_pages(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    rows = {r["page_id"]: r for r in df.collect()}
    got = warc.derivatives(warc.responses(df)).collect()
    assert {r["page_id"] for r in got} == set(rows)
    for r in got:
        made = warc.derive(warc.response(rows[r["page_id"]]["url"], rows[r["page_id"]]["html"]))
        assert bytes(r["metadata"]) == made.metadata and bytes(r["conversion"]) == made.conversion
        check(rows[r["page_id"]]["url"], rows[r["page_id"]]["html"], made)
    digests = {r["page_id"]: r for r in warc.digests(df).collect()}
    for r in got:
        d = digests[r["page_id"]]
        assert d["text_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest() and d["text_chars"] == len(r["text"])
        assert d["conversion_bytes"] == len(r["conversion"]) and d["metadata_sha256"] == hashlib.sha256(bytes(r["metadata"])).hexdigest()


def test_stated_digest_is_kept_and_marked():
    raw = warc.response("http://a/", "<p>x").replace(b"<p>x", b"<p>y")
    d = warc.derive(raw)
    assert not d.digest_ok and d.payload_digest == warc.digest(b"<p>x")


def test_nulls_repeats_long_empty_and_clashes(spark, tmp_path):
    rows = [(1, None, None, "a"), (2, "http://x/\r\nA: b", "<p>x</p>", "b"), (2, "http://x/\r\nA: b", "<p>x</p>", "b"), (None, "u", "<p>" * 100_000 + "z", "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record string")
    got = warc.digests(df).collect()
    assert len(got) == 4
    twice = [tuple(r) for r in got if r["page_id"] == 2]
    assert twice[0] == twice[1]
    assert {r["page_id"]: r["text_chars"] for r in got} == {1: 0, 2: 1, None: 1}
    assert warc.digests(df.limit(0)).count() == 0
    made = warc.derivatives(warc.responses(df))
    warc.write(made, f"{tmp_path}/out")
    members = spark.read.parquet(f"{tmp_path}/out").where("page_id = 1").head()["members"]
    whole = gzip.decompress(bytes(members))
    assert whole.count(b"WARC/1.1") == 2 and whole.startswith(b"WARC/1.1\r\nWARC-Type: metadata")


BLOCKS = set("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 article section header footer nav title head body html blockquote pre hr form main aside dd dt dl td th".split())


class Visible(HTMLParser):
    """Text of a page by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden, self.links = [], 0, 0

    def handle_starttag(self, tag, attrs):
        self.links += tag == "a" and any(k == "href" and v is not None for k, v in attrs)
        if tag in ("script", "style", "template", "noscript"):
            self.hidden += 1
        elif tag in BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "template", "noscript"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def visible(page):
    parser = Visible()
    parser.feed(page)
    parser.close()
    lines = [re.sub(r"\s+", " ", x).strip() for x in "".join(parser.out).split("\n")]
    return "\n".join(x for x in lines if x), parser.links


def test_text_of_pages_against_the_standard_parser(spark):
    rows = [(r["url"], r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert len(rows) >= 50
    for url, page in rows:
        d = warc.derive(warc.response(url, page))
        text, links = visible(page)
        squeeze = lambda x: re.sub(r"\s+", " ", x)
        assert squeeze(d.text) == squeeze(text) and d.n_links == links


def test_records_that_are_no_responses(spark):
    good = warc.response("http://a/", "<p>x")
    bad = [None, b"", b"no record", good.replace(b"WARC-Type: response", b"WARC-Type: request"), re.sub(rb"Content-Length: \d+", b"Content-Length: many", good, count=1), re.sub(rb"Content-Length: \d+", b"Content-Length: -4", good, count=1), good]
    df = spark.createDataFrame(list(enumerate(bad)), "page_id long, record binary")
    got = {r["page_id"]: r for r in warc.derivatives(df).collect()}
    assert sorted(got) == list(range(7))
    assert all(got[k]["metadata"] is None and got[k]["text"] is None and got[k]["n_links"] is None for k in range(6))
    assert got[6]["text"] == "x"


def test_source_headers_and_encoded_bodies():
    page = "<p>héllo</p>" * 50
    packed = gzip.compress(page.encode(), mtime=0)
    chunks = b"".join(b"%x;ext=1\r\n%s\r\n" % (len(packed[i : i + 40]), packed[i : i + 40]) for i in range(0, len(packed), 40)) + b"0\r\n\r\n"
    block = b"HTTP/1.1 200 OK\r\nServer: s/1\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n" + chunks
    raw = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-IP-Address", "10.0.0.1"), ("WARC-Payload-Digest", warc.digest(packed))], block)
    d = warc.derive(raw)
    assert d.text == "\n".join(["héllo"] * 50) and d.digest_ok
    notes = warc.parse(d.metadata)[1].decode().split("\r\n")
    for line in ("source-http-header: Server: s/1", "source-http-header: Set-Cookie: a=1", "source-http-header: Set-Cookie: b=2", "source-warc-header: WARC-IP-Address: 10.0.0.1"):
        assert notes.count(line) == 1
    cut = warc.derive(warc.record([("WARC-Type", "response")], block[:-60]))
    assert cut.text.startswith("héllo") or cut.text == ""


def test_open_tags_take_linear_time():
    for part in ("<html ", "<a ", "<script ", "<title ", "<!--", "<a href=\"", "<", "<p", "<script>", "</script"):
        began = time.process_time()
        warc.derive(warc.response("u", part * (1_000_000 // len(part))))
        assert time.process_time() - began < 2, part
