"""Cases at the limits: long hosts, splits that change between scans, characters newer than the library, many cells in one task."""

import resource
import time

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fieldglass.llm import simhash, token_counts, url_filter, warc

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def test_every_code_point_is_counted_as_the_library_does():
    library, counter = Tokenizer.from_file(BYTE), token_counts.Counter(BYTE, token_counts.differing(BYTE))
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and not 0x323B0 <= c < 0xE0000]  # the planes between hold nothing yet
    for at in range(0, len(points), 1 << 14):
        texts = ["".join(f"a{c}b 1{c}2 {c}." for c in points[i : i + 64]) for i in range(at, min(at + (1 << 14), len(points)), 64)]
        assert [counter.count(t) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("host", ["." * 1_000_000, "x" * 1_000_000, "a." * 500_000 + "spam-farm.example.com", "é." * 100 + "net", "..net", "net.", "net", "xnet", ""])
def test_long_hosts(tmp_path, host):
    for name, entries, lengths in (("r", [(h + p, int(v == url_filter.BLOCK)) for v, h, p in url_filter.RULES], [len(p) for _, _, p in url_filter.RULES]), ("l", [(h, 1) for h in url_filter.LISTED], ())):
        (tmp_path / name).write_bytes(url_filter.digest_bytes(entries, lengths))
    rules, listed = (url_filter.Digests(str(tmp_path / n)) for n in "rl")
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    rule, verdict = url_filter.judge(rules, listed, [host] * 3, ["/a", "", "/" + "b" * 1_000_000])
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000 and time.time() - began < 5
    plain = [max(((h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), key=lambda x: len(x[0]), default=(None, None)) for path in ("/a", "", "/b")]
    on = any(host == n or host.endswith("." + n) for n in url_filter.LISTED)
    assert rule == [p[0] for p in plain] and verdict == [p[1] or ("block" if on else "allow") for p in plain]


def test_records_survive_other_splits_in_the_second_scan(spark):
    html = lambda i: f"<p>{i}</p>" + warc.MAGIC + f"Content-Length: {i}\r\n\r\n" + "x" * (i * 37 % 3000) + warc.MAGIC * (i % 3)
    pages = spark.createDataFrame([(i, f"http://h/{i}", html(i)) for i in range(200)], "page_id long, url string, html string").repartition(2)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        read = warc.round_trip(pages)
        for size in ("64k", "20k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert sorted((r.id, r.payload_bytes) for r in read.collect()) == [(i, len(html(i))) for i in range(200)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_many_cells_of_one_task(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**63), 2**63, 20_000)
    near = base ^ (1 << rng.integers(0, 63, len(base)))
    distinct = spark.createDataFrame([(int(x),) for x in {*base.tolist(), *near.tolist()}], "bits long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        edges = {tuple(sorted(r)) for r in simhash.links(distinct).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert edges == {tuple(sorted((int(a), int(b)))) for a, b in zip(base, near)}


@pytest.mark.parametrize("name", ["op2_decontamination", "op4_simhash_dedup", "op5_warc", "op11_vector_codes", "op13_nearest_neighbours"])
def test_a_query_leaves_only_its_result(spark, tmp_path, monkeypatch, name):
    import os

    from fieldglass.llm import common
    from fieldglass.llm.queries import QUERIES

    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    rows = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert rows.count() > 0 and [n.rsplit("-", 1)[0] for n in os.listdir(tmp_path)] == [name]
