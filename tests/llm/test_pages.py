"""Operators on pages: URL rules and WARC archives."""

import base64
import hashlib

import pytest

from tidemark.llm import url_filters, warc
from tidemark.llm.queries import URL_RULES

URLS = [
    "https://www.Example.ORG/es/a?x#y", "http://example.org/en/12", "http://example.org/en/2", "http://notexample.org/es/", "https://a.com/fr/x", "https://a.com/de/", "https://a.com/de",
    "ftp://com/fr/", "no scheme", "", None, "http://", "http://?q=/es/", "http://x.org?://y.com/de/", "HTTP://EXAMPLE.ORG/ES/", "http://é.com/de/é", "http://org/",
]


def slow(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = rest[:end].translate({c: c + 32 for c in range(65, 91)})
        path = rest[end:].split("#")[0].split("?")[0]
    fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_urls(spark):
    rows = [(i, u, "rule") for i, u in enumerate(URLS)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    for limit in (20_000, 0):
        url_filters.BROADCAST_RULES, before = limit, url_filters.BROADCAST_RULES
        out = url_filters.url_verdicts(pages, url_filters.rule_table(spark, URL_RULES)).collect()
        url_filters.BROADCAST_RULES = before
        assert sorted(map(repr, map(tuple, out))) == sorted(repr((i, *slow(u))) for i, u, _ in rows)


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    out = url_filters.url_verdicts(pages, url_filters.rule_table(spark, [])).collect()
    assert [tuple(r) for r in out] == [(1, "a.org", "/", None, "allow")]
    assert url_filters.url_verdicts(pages.limit(0), url_filters.rule_table(spark, URL_RULES)).count() == 0


PAGES = [(1, "http://a/", "same"), (2, "http://b/\r\nx", "same"), (3, None, ""), (4, "http://d/", None), (5, "http://e/", "é" * 4000), (6, "u", "x" * 200_000), (None, "n", "same"), (2, "again", "same")]


def test_archives(spark):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES * 1], "page_id long, url string, html string, payload string")
    owner = {}
    for i, _, html in PAGES:
        if i is not None:
            owner[html or ""] = max(owner.get(html or "", i), i)
    want = []
    for i, _, html in PAGES:
        raw = (html or "").encode()
        kind = ("response", None) if i == owner[html or ""] else ("revisit", owner[html or ""])
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), *kind))
    assert sorted(map(repr, map(tuple, warc.archived(pages).collect()))) == sorted(map(repr, want))


def test_payloads_survive_and_records_stand_alone(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>page {i} " + "common words of all pages " * (i % 9)) for i in range(200)], "page_id long, url string, html string")
    archives = warc.write_archives(pages, archive_bytes=5000)
    back = {r.page_id: bytes(r.payload).decode() for r in warc.read_archives(archives, payloads=True).collect() if r.record_type == "response"}
    assert all(back[r.page_id] == r.html for r in pages.collect() if r.page_id in back) and len(back) == 200
    content = bytes(archives.first().content)
    assert int.from_bytes(content[:4], "little") == warc.SKIPPABLE and archives.count() > 4


def test_no_pages(spark):
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_long_hosts_and_hot_pairs(spark, monkeypatch):
    monkeypatch.setattr(url_filters, "HOT", 3)
    urls = ["http://a.example.org/es/x"] * 5 + ["http://" + "a." * 3000 + "com/de/"] + URLS + ["http://none.net/"] * 4
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = url_filters.url_verdicts(pages, url_filters.rule_table(spark, URL_RULES)).collect()
    assert sorted(map(repr, map(tuple, out))) == sorted(repr((i, *slow(u))) for i, u in enumerate(urls))


def test_cut_archives_are_errors():
    dictionary = warc.train([b"some words of a page " * 4] * 3)
    import zstandard

    shared = zstandard.ZstdCompressionDict(dictionary)
    records = [warc.record(i, "u", b"x%d " % i * 900 * i, warc.digest32(b"x%d " % i * 900 * i), None) for i in range(5)]
    content = warc.front(dictionary) + b"".join(zstandard.ZstdCompressor(dict_data=shared).compress(r) for r in records)
    assert [r["page_id"] for r in warc.read_archive(content)] == list(range(5))
    with pytest.raises(ValueError):
        list(warc.read_archive(content[:-3]))
