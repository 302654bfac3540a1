import base64
import hashlib
import os

import pytest
from oracle import check

from fieldglass.llm import url_filter, warc
from fieldglass.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    check(spark, QUERIES[name], ORACLE[name], "/root/testdata/sf0.001")


def test_digests_survive_collisions(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda s: len(s))
    path = str(tmp_path / "d")
    (tmp_path / "d").write_bytes(url_filter.digest_bytes([("aa", 1), ("bb", 0), ("cc", 1), ("dddd", 1)]))
    d = url_filter.Digests(path)
    at = d.probe([b"cc", b"aa", b"xx", b"dddd", b"", b"bb", b"eeeee"])
    assert (at >= 0).tolist() == [True, True, False, True, False, True, False]
    assert [int(d.verdicts[i]) for i in at[[0, 1, 3, 5]]] == [1, 1, 1, 0]


def test_empty_digests(tmp_path):
    (tmp_path / "d").write_bytes(url_filter.digest_bytes([]))
    assert url_filter.Digests(str(tmp_path / "d")).probe([b"x"]).tolist() == [-1]


def test_digests_from_a_table_equal_those_from_a_list(spark):
    from pyspark import SparkFiles

    entries = [(f"host{i % 900}.example.{'é' * (i % 3)}", i % 2) for i in range(1500)] + [("", 1)]
    table = spark.createDataFrame([*entries, (None, 1)], "string string, verdict int").repartition(5)
    best = {}
    for k, v in entries:
        best[k] = max(v, best.get(k, 0))
    with open(SparkFiles.get(url_filter.ship(spark, table, [3, 1])), "rb") as f:
        assert f.read() == url_filter.digest_bytes(best.items(), [1, 3])
    with open(SparkFiles.get(url_filter.ship(spark, table.limit(0))), "rb") as f:
        assert f.read() == url_filter.digest_bytes([])


def test_a_list_of_a_million_hosts(spark):
    hosts = spark.range(1_000_000).selectExpr("concat('h', id, '.example.net') AS host")
    pages = spark.createDataFrame([(1, "http://h999999.example.net/"), (2, "http://www.h0.example.net/x"), (3, "http://h1000000.example.net/"), (4, "http://example.net/"), (5, "http://xh5.example.net")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(pages, listed=hosts).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}


CASES = [
    ("http://A.Example.ORG/es/1?x", "a.example.org", "/es/1", "example.org/es/", "block"),
    ("http://example.org/en/123", "example.org", "/en/123", "example.org/en/1", "block"),
    ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("http://x.com/de/#a", "x.com", "/de/", "com/de/", "block"),
    ("http://x.com/fr", "x.com", "/fr", None, "allow"),
    ("http://org", "org", "", None, "allow"),
    ("http://blog.cheap-pills.example.com/en/", "blog.cheap-pills.example.com", "/en/", None, "block"),
    ("a\nb://k://x/ÄA\n?q", "k:", "//x/ÄA\n", None, "allow"),
    ("no scheme/x", "", "", None, "allow"),
    (None, "", "", None, "allow"),
]


def test_url_cases(spark, rows):
    data = [(i, c[0], "h", "r") for i, c in enumerate(CASES)] + [(None, "http://org/", "h", "r"), (0, CASES[0][0], "h", "r")]
    pages = spark.createDataFrame(data, "page_id long, url string, host string, rule string")
    want = [(i, *c[1:]) for i, c in enumerate(CASES)] + [(None, "org", "/", "org/", "allow"), (0, *CASES[0][1:])]
    assert rows(url_filter.filter_urls(pages)) == sorted(want, key=repr)
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


EVIL = "before WARC/1.1\r\nWARC-Type: response\r\nX-Page: 666\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n after"
PAGES = [(5, "http://a", "same"), (3, "http://b", "same"), (9, None, "same"), (3, "http://b", "same"), (1, "http://c\r\nX: y", None), (2, "u", ""), (7, "u", EVIL), (8, "u", "é" * 3000 + "\r\n\r\n"), (None, "u", "nobody"), (11, "u", EVIL + "2"), (12, "u", EVIL)]


def test_round_trip_with_magic_inside(spark, rows):
    pages = spark.createDataFrame([(*p, "c") for p in PAGES], "page_id long, url string, html string, digest string")
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in PAGES:
        again = i is not None and i > first[h or ""]
        want.append((i, len((h or "").encode()), digest(h), "revisit" if again else "response", first[h or ""] if again else None))
    out = warc.round_trip(pages).select("id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert rows(out) == sorted(want, key=repr)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_archives_are_well_formed_and_splits_agree(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 50 + EVIL * (i % 7 == 0)) for i in range(200)], "page_id long, url string, html string").coalesce(1)
    path = str(tmp_path / "w")
    warc.write_warc(pages, path)
    (name,) = [n for n in os.listdir(path) if n.startswith("part-") and os.path.getsize(f"{path}/{n}")]
    data, at, ids = open(f"{path}/{name}", "rb").read(), 0, []
    while at < len(data):
        head, _, rest = data[at:].partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        n = int(fields[b"Content-Length"])
        block = rest[:n]
        assert rest[n : n + 4] == b"\r\n\r\n" and int(block.partition(b"Content-Length: ")[2].partition(b"\r\n")[0]) == len(block.partition(b"\r\n\r\n")[2])
        ids.append((at, int(fields[b"X-Page"])))
        at += len(head) + 4 + n + 4
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = sorted((r.offset, r.id) for r in warc.records(spark, path).select("offset", "id").collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted(ids) and len(ids) == 200


def test_a_broken_chain_ends_there(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i}") for i in range(4)], "page_id long, url string, html string").coalesce(1)
    warc.write_warc(pages, str(tmp_path / "w"))
    (name,) = [n for n in os.listdir(tmp_path / "w") if n.startswith("part-") and os.path.getsize(tmp_path / "w" / n)]
    data = (tmp_path / "w" / name).read_bytes()
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "cut.warc").write_bytes(data[:-9])
    assert sorted(r.id for r in warc.records(spark, str(tmp_path / "x")).collect()) == [0, 1, 2]


def test_urls_can_not_forge_headers(spark, rows):
    """Line ends of any kind in a url neither give a record another id nor break the chain."""
    urls = [f"http://b/{c}{tail}" for c in ("\x85", "\u2028", "\u2029", "\x7f", "\x0b", "\x0c", "\x1c", "\xa0", "\r\n", "\n") for tail in ("X-Page:77", "Content-Length:3", "WARC-Type: revisit")]
    pages = spark.createDataFrame([(i, u, f"<p>{i}</p>") for i, u in enumerate(urls)] + [(1000, "u", "x\u2028Content-Length: 3\r\n\r\nX-Page: 5")], "page_id long, url string, html string")
    got = rows(warc.round_trip(pages.coalesce(1)).select("id", "record_type", "payload_bytes"))
    assert got == sorted([(i, "response", len(f"<p>{i}</p>")) for i in range(len(urls))] + [(1000, "response", len("x\u2028Content-Length: 3\r\n\r\nX-Page: 5".encode()))], key=repr)


def test_long_payloads_and_those_cut_by_splits(spark, tmp_path, rows):
    """Payloads of megabytes, with and without magic lines, through splits far smaller than they are."""
    big = ("é" * 700_000, EVIL * 4_000, "")
    pages = spark.createDataFrame([(i, f"u{i}", h) for i, h in enumerate(big)], "page_id long, url string, html string").coalesce(1)
    path = str(tmp_path / "w")
    warc.write_warc(pages, path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        got = rows(warc.records(spark, path).select("id", "payload_bytes", "payload_digest"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted([(i, len(h.encode()), digest(h)) for i, h in enumerate(big)], key=repr)
