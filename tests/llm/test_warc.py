import gzip
import json

from seriesmill.llm import warc
from seriesmill.llm.warc import derivatives, header, record_bytes, sha1, split_headers

PAGE = '<html><head><title>A &amp; B</title><meta name="author" content="me"><script>x("<p>no</p>")</script></head><body><p>One <b>two</b></p><p>three&nbsp;é<br>four</p><a href="/x?a=1&amp;b=2">link</a></body></html>'
TEXT = "One two\nthree é\nfour\nlink"


def response(body=PAGE.encode(), http=(("Content-Type", "text/html; charset=utf-8"),), extra=(), status="HTTP/1.1 200 OK"):
    block = "".join([f"{status}\r\n", *(f"{k}: {v}\r\n" for k, v in http), "\r\n"]).encode() + body
    headers = [
        ("WARC-Type", "response"), ("warc-record-id", "<urn:uuid:1>"), ("WARC-Target-URI", "http://e.org/"), ("WARC-Date", "2024-05-05T00:00:00Z"),
        ("WARC-Warcinfo-ID", "<urn:uuid:0>"), ("WARC-Payload-Digest", sha1(body)), *extra, ("Content-Length", str(len(block))),
    ]
    return record_bytes(headers, block)


def parsed(row):
    version, headers, rest = split_headers(row[-1])
    length = int(header(headers, "content-length"))
    assert version == "WARC/1.1" and rest[length:] == b"\r\n\r\n" and header(headers, "warc-block-digest") == sha1(rest[:length]) == row[7]
    return headers, rest[:length]


def test_two_linked_records():
    rows = derivatives(response(extra=[("X-Own", "1"), ("X-Own", "2")]))
    (first, meta), (second, text) = map(parsed, rows)
    assert text.decode() == TEXT
    for headers, kind, other in ((first, "metadata", second), (second, "conversion", first)):
        assert header(headers, "warc-type") == kind and header(headers, "warc-refers-to") == "<urn:uuid:1>"
        assert header(headers, "warc-concurrent-to") == header(other, "warc-record-id")
        assert header(headers, "warc-target-uri") == "http://e.org/" and header(headers, "warc-warcinfo-id") == "<urn:uuid:0>"
    meta = json.loads(meta)
    assert meta["Source"]["Headers"][0] == ["WARC-Type", "response"] and ["X-Own", "2"] in meta["Source"]["Headers"]
    assert meta["Source"]["Digests-Agree"] == {"block": None, "payload": True} and meta["Source"]["Payload-Digest"] == sha1(PAGE.encode())
    assert meta["HTTP"]["Status"] == "HTTP/1.1 200 OK" and meta["HTTP"]["Payload-Length"] == len(PAGE.encode())
    assert meta["HTML"]["Title"] == "A & B" and meta["HTML"]["Links"] == [{"path": "a", "url": "/x?a=1&b=2"}] and meta["HTML"]["Metas"][0]["content"] == "me"
    assert meta["Conversion"] == header(second, "warc-record-id")
    assert derivatives(response()) == derivatives(response())


def test_encodings():
    zipped = response(gzip.compress(PAGE.encode()), (("Content-Type", "text/html"), ("Content-Encoding", "gzip")))
    assert parsed(derivatives(zipped)[1])[1].decode() == TEXT
    body = PAGE.encode()
    chunked = b"%x\r\n%s\r\n%x;x=1\r\n%s\r\n0\r\n\r\n" % (50, body[:50], len(body) - 50, body[50:])
    assert parsed(derivatives(response(chunked, (("Content-Type", "text/html"), ("Transfer-Encoding", "chunked"))))[1])[1].decode() == TEXT
    latin = response("<p>é</p>".encode("latin-1"), (("Content-Type", "text/html; charset=ISO-8859-1"),))
    assert parsed(derivatives(latin)[1])[1].decode() == "é"


def test_other_records():
    assert [r[0] for r in derivatives(response(b"\x00\xff", (("Content-Type", "image/png"),)))] == ["metadata"]
    assert derivatives(record_bytes([("WARC-Type", "request"), ("WARC-Record-ID", "<x>")], b"GET / HTTP/1.1\r\n\r\n")) == []
    for bad in (None, b"", b"no record", b"WARC/1.1\r\nWARC-Type: response\r\n\r\n", b"WARC/1.1\r\nbroken\r\n\r\n", response()[:200] + b"\r\n\r\n"):
        assert [r[0] for r in derivatives(bad)] == ["invalid"]
    assert parsed(derivatives(response(b""))[1])[1] == b""


def test_pages(spark):
    rows = [(1, "http://a/", PAGE, "clash"), (2, None, None, None), (2, None, None, None), (None, "http://b/", "<p>" + "word " * 100000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record string").repartition(2)
    records = warc.page_responses(pages)
    got = warc.derive(records).collect()
    assert sorted((r.id or 0, r.kind) for r in got) == sorted([(i, k) for i in (0, 1, 2, 2) for k in ("conversion", "metadata")])
    assert next(r for r in got if r.id == 1 and r.kind == "conversion").record.split(b"\r\n\r\n")[1].decode() == TEXT
    assert all(r.refers_to for r in got)
    assert warc.derive(warc.page_responses(pages.limit(0))).count() == 0


def test_every_page_gives_both(spark):
    got = warc.op4_warc_derivatives(spark, "/root/testdata/sf0.001")
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()
    assert {r.kind: r["count"] for r in got.groupBy("kind").count().collect()} == {"metadata": pages, "conversion": pages}


def test_all_links_of_a_page():
    page = (
        '<link href=/s.css><script src="/a.js">var x = "<a href=/no>";</script><img data-src="/lazy" src=\'/i.png\' ><a data-href=/no href=/x>t</a>'
        '<iframe src=/f></iframe><noscript><img src="/n.png"><template><a href=/deep></a></template></noscript><video src=/v poster=/p></video>'
    )
    _, found = warc.page_parts(page)
    assert [(x["path"], x["url"]) for x in found["Links"]] == [
        ("link", "/s.css"), ("script", "/a.js"), ("img", "/i.png"), ("a", "/x"), ("iframe", "/f"), ("video", "/v"), ("img", "/n.png"), ("a", "/deep"),
    ]


def test_whole_payloads_decide():
    late = "<!-- " + "x" * 5000 + " --><html><head><meta charset=latin-1><title>Caf\xe9</title></head><body><p>word</p></body></html>"
    members = gzip.compress(late[:3000].encode("latin-1")) + gzip.compress(late[3000:].encode("latin-1")) + b"trailing"
    rows = warc.derivatives(response(members, (("Content-Encoding", "gzip"),)))
    assert [r[0] for r in rows] == ["metadata", "conversion"]
    _, _, block = warc.split_headers(rows[1][-1])
    assert "Caf\xe9" in rows[0][-1].decode() and block.startswith(b"word")
