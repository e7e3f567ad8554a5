import base64
import gzip
import hashlib
import time

import pytest

from chronoledger.llm import warc

PAGE = '<!DOCTYPE html><html lang="fr"><head><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script></head><body><!-- ad --><h1>Head&eacute;</h1><p>One<b>two</b> &lt;3<br>next<p>x&nbsp;y <a href="/a?b=1&amp;c=2">l</a><a href=\'u\'>m</a></body></html>'


def test_text_title_and_links():
    assert warc.plain_text(PAGE) == "Headé\nOnetwo <3\nnext\nx y lm"
    meta, text = warc.derive(warc.response("http://x/", PAGE, "2024-01-01T00:00:00Z"))
    fields = meta.block.decode().split("\r\n")
    assert {"title: A & B", "language: fr", "outlink: /a?b=1&c=2", "outlink: u", "source-status: HTTP/1.1 200 OK", "source-header-content-type: text/html; charset=utf-8"} <= set(fields)
    assert text.block.decode() == warc.plain_text(PAGE)


def test_links_to_the_source_and_digests():
    source = warc.response("http://x/é", PAGE, "2024-01-01T00:00:00Z", [("Content-Type", "text/html"), ("X-Odd", "1")], "HTTP/1.1 404 Not Found")
    _, _, body = warc.http_parts(source.block)
    want = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    assert source["WARC-Payload-Digest"] == want and body.decode() == PAGE
    for r in warc.derive(source):
        assert r["WARC-Refers-To"] == source["WARC-Record-ID"] and r["WARC-Target-URI"] == "http://x/é" and r["WARC-Date"] == source["WARC-Date"]
        assert r["WARC-Block-Digest"] == warc.digest(r.block) and int(r["Content-Length"]) == len(r.block)
    meta, text = warc.derive(source)
    assert "source-header-x-odd: 1" in meta.block.decode() and f"source-payload-digest: {want}" in meta.block.decode()
    assert text["WARC-Source-Payload-Digest"] == want
    assert len({source["WARC-Record-ID"], meta["WARC-Record-ID"], text["WARC-Record-ID"]}) == 3


def test_written_records_read_back():
    source = warc.response("http://x/", PAGE, "2024-01-01T00:00:00Z")
    records = [source, *warc.derive(source), warc.response(None, None, "2024-01-01T00:00:00Z")]
    back = list(warc.read_records(b"".join(r.encode() for r in records)))
    assert [(r.fields, r.block) for r in back] == [(r.fields, r.block) for r in records]


def test_header_values_stay_on_their_line():
    bad = warc.response("http://x/\r\nWARC-Type: fake", "<title>a\r\nb</title>", "2024-01-01T00:00:00Z")
    assert bad["WARC-Target-URI"] == "http://x/ WARC-Type: fake"
    meta, _ = warc.derive(bad)
    assert "title: a b" in meta.block.decode().split("\r\n")


def test_tables_with_nulls_repeats_and_clashes(spark):
    rows = [(1, "http://x/", PAGE), (1, "http://x/", PAGE), (2, None, None), (None, "http://y/", ""), (3, "http://z/", "<p>" * 20000), (4, "http://w/", "no tags"), (5, "u", "<!-- open <p>text")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, header string, block string")
    got = warc.derivatives(df).collect()
    assert len(got) == 2 * len(rows) and {r.warc_type for r in got} == {"metadata", "conversion"}
    assert len({r.record_id for r in got if r.page_id == 1}) == 2
    assert all(len(r.block) == r.content_length and r.block_digest == warc.digest(bytes(r.block)) for r in got)
    texts = {r.page_id: bytes(r.block).decode() for r in got if r.warc_type == "conversion"}
    assert texts[4] == "no tags" and texts[5] == "" and texts[2] == ""
    assert next(r for r in got if r.page_id == 2).target_uri is None
    assert warc.derivatives(df.limit(0)).count() == 0


HEADERS = [("Content-Type", "text/html; charset=latin-1"), ("X-A", "1"), ("X-A", "2")]


def test_responses_keep_their_own_columns(spark):
    kind = "page_id long, url string, html string, at string, line string, head array<struct<name:string,value:string>>, rid string, sum string"
    rows = [(1, "http://x/", PAGE, "2023-05-06T07:08:09Z", "HTTP/1.1 404 Not Found", HEADERS, "<urn:uuid:1>", "sha1:ABC"), (2, "http://y/", PAGE, None, None, None, None, None)]
    got = warc.derivatives(spark.createDataFrame(rows, kind), dates="at", status="line", headers="head", record="rid", digests="sum").collect()
    own = [r for r in got if r.page_id == 1]
    assert {r.refers_to for r in own} == {"<urn:uuid:1>"} and {r.source_payload_digest for r in own} == {"sha1:ABC"}
    assert all("WARC-Date: 2023-05-06T07:08:09Z" in r.header for r in own)
    facts = next(bytes(r.block).decode() for r in own if r.warc_type == "metadata").split("\r\n")
    assert {"source-status: HTTP/1.1 404 Not Found", "source-header-x-a: 1", "source-header-x-a: 2", "source-payload-digest: sha1:ABC"} <= set(facts)
    plain = {r.record_id for r in got if r.page_id == 2}
    assert plain == {r.record_id for r in warc.derivatives(spark.createDataFrame([r[:3] for r in rows[1:]], "page_id long, url string, html string")).collect()}


@pytest.mark.parametrize("packed", [False, True])
def test_files_are_read_and_derived(spark, tmp_path, packed):
    sources = [warc.response(f"http://x/{i}", PAGE * i, "2024-01-01T00:00:00Z", HEADERS) for i in range(40)]
    info = warc.Record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<i>"), ("Content-Length", "4")], b"\r\n\r\n")
    for n in (0, 1):
        records = [info, *sources[n::2]]
        data = b"".join(gzip.compress(r.encode()) if packed else r.encode() for r in records)
        (tmp_path / f"{n}.warc").write_bytes(data)
    records = warc.read_warc(spark, str(tmp_path))
    assert records.count() == 42
    got = warc.derive_records(records).collect()
    assert len(got) == 80
    for s in sources:
        want = {r["WARC-Record-ID"]: r for r in warc.derive(s)}
        mine = [r for r in got if r.source_id == s["WARC-Record-ID"]]
        assert {r.record_id for r in mine} == set(want)
        for r in mine:
            assert bytes(r.block) == want[r.record_id].block and r.refers_to == s["WARC-Record-ID"] and r.source_payload_digest == s["WARC-Payload-Digest"]


def test_damaged_files_are_refused():
    whole = warc.response("u", PAGE, "2024-01-01T00:00:00Z").encode()
    for bad in (whole[:-60], b"no record" + whole, gzip.compress(whole)[:-9]):
        with pytest.raises(ValueError):
            list(warc.read_records(bad))
    assert list(warc.read_records(b"")) == []


@pytest.mark.parametrize("unit", ["<svg>", "<p ", "<a ", "<a <", "<title>", "<html ", "<!-- ", "<script>", "</script "])
def test_hostile_pages_take_linear_time(unit):
    began = time.perf_counter()
    warc.derive(warc.response("u", unit * 100_000, "2024-01-01T00:00:00Z"))
    assert time.perf_counter() - began < 5


def test_what_is_not_shown():
    assert warc.plain_text("a<svg>b<p>c</svg>d<noscript>e") == "a de"
    assert warc.plain_text("a<script>b") == "a" and warc.plain_text("a<!-- b --> c <!-- d") == "a c"
    assert warc.plain_text("1 < 2 <b") == "1 < 2 <b" and warc.title_of("<title>x") is None
