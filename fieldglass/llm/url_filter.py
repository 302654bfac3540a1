"""URL filters by a sorted digest array.

Rules and listed hosts are kept as one file each: sorted 64-bit xxhash keys, the place of each entry's full
string, its verdict, and the strings. Workers memory-map the file, probe it for all candidates of a batch by
vectorised binary search, and confirm every hit against the stored string, so that colliding digests cannot
decide. A url's candidates are its host and each parent domain, joined with each prefix of its path that has
the length of some rule's path. The file goes out once per executor, and again to those that replace it.
A list of hosts may be a table of any size that fits an executor's disk: its keys are hashed and sorted by
Spark, in ranges, and the driver streams the sorted blocks into the file, a block at a time.

The longest fitting rule decides (of equal lengths, the one with the longer host). Without one, the method
decides: hosts that are listed, or under a listed one, are blocked, all others allowed. A null url, or one
without ``://``, has an empty host and path and is allowed. A null id is carried; repeated rows are judged
each. An empty table gives no rows. Other columns than the two named are not read.
"""

from __future__ import annotations

import itertools
import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, discard, materialise, require, shared_dir

ALLOW, BLOCK = "allow", "block"
#: The production rules: verdict, host, path.
RULES = ((ALLOW, "org", "/"), (BLOCK, "example.org", "/es/"), (BLOCK, "example.org", "/en/1"), (ALLOW, "com", "/fr/"), (BLOCK, "com", "/de/"))
#: The production list of hosts.
LISTED = tuple(f"{name}.example.{end}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for end in ("com", "net", "org"))
HEAD = struct.Struct("<8sQQ")
DOT = ord(".")


ENTRIES = 1 << 16  # of a sorted block


def digest_bytes(entries: Iterable[tuple[str, int]], lengths: Iterable[int] = ()) -> bytes:
    """The file of (string, verdict) entries; of one string's entries the last counts. ``lengths`` are stored beside them."""
    found = {k.encode("utf-8"): v for k, v in entries}
    strings = sorted(found, key=lambda s: (xxhash.xxh64_intdigest(s), s))
    ends = np.cumsum([0, *map(len, strings)]).astype("<u8")
    extra = np.array(sorted(set(lengths)), "<u8")
    keys, verdicts = np.array([xxhash.xxh64_intdigest(s) for s in strings], "<u8"), np.array([found[s] for s in strings], np.uint8)
    return b"".join([HEAD.pack(b"digests1", len(strings), len(extra)), *(block.tobytes() for block in (keys, ends, extra, verdicts)), *strings])


def digest_blocks(entries: DataFrame) -> DataFrame:
    """(place, n, keys, sizes, verdicts, pool) of rows of (string, verdict): sorted blocks whose places are in the order of their keys. Of a string's verdicts the largest counts; null strings are none."""
    distinct = entries.filter("string IS NOT NULL").groupBy("string").agg(F.max("verdict").cast("int").alias("verdict"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.array([xxhash.xxh64_intdigest(s.as_py().encode("utf-8")) for s in batch.column(0)], np.uint64)
            place = keys ^ np.uint64(1 << 63)  # as signed numbers these are in the order of the unsigned keys
            yield pa.RecordBatch.from_arrays([pa.array(place.view(np.int64)), pa.array(keys.view(np.int64)), batch.column(0), batch.column(1)], names=["place", "key", "string", "verdict"])

    ordered = distinct.mapInArrow(hashed, "place long, key long, string string, verdict int").repartitionByRange("place", "string").sortWithinPartitions("place", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ENTRIES):
                part = batch.slice(at, ENTRIES)
                strings = [s.as_py().encode("utf-8") for s in part.column(2)]
                keys, sizes = part.column(1).to_numpy().astype("<i8"), np.array([len(s) for s in strings], "<u8")
                verdicts = part.column(3).to_numpy().astype(np.uint8)
                first = part.column(0)[0].as_py(), strings[0].decode("utf-8")
                yield pa.RecordBatch.from_pylist([{"place": first[0], "first": first[1], "n": len(strings), "keys": keys.tobytes(), "sizes": sizes.tobytes(), "verdicts": verdicts.tobytes(), "pool": b"".join(strings)}])

    return ordered.mapInArrow(run, "place long, first string, n long, keys binary, sizes binary, verdicts binary, pool binary")


class Digests:
    """The stored entries, memory-mapped."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        _, n, k = HEAD.unpack(data[: HEAD.size].tobytes())
        cuts = np.cumsum([HEAD.size, 8 * n, 8 * (n + 1), 8 * k, n])
        part = [data[a:b] for a, b in zip(cuts, cuts[1:])]
        self.keys, self.ends, self.lengths = (p.view("<u8") for p in part[:3])
        self.verdicts, self.pool = part[3], data[cuts[-1] :]
        sizes: set[int] = set()
        for at in range(0, n, 1 << 20):
            sizes.update(np.unique(np.diff(self.ends[at : at + (1 << 20) + 1])).tolist())
        self.sizes = sorted(sizes, reverse=True)  # of the stored strings: no other can be found

    def probe(self, strings: list[bytes]) -> np.ndarray:
        """The entry of each string, or -1."""
        digests = np.array([xxhash.xxh64_intdigest(s) for s in strings], np.uint64)
        at = np.searchsorted(self.keys, digests)
        out = np.full(len(strings), -1, np.int64)
        live = np.flatnonzero(at < len(self.keys))
        while len(live):
            live = live[self.keys[at[live]] == digests[live]]
            for i in live:  # a digest that is there: confirm the string
                if self.pool[self.ends[at[i]] : self.ends[at[i] + 1]].tobytes() == strings[i]:
                    out[i] = at[i]
            live = live[out[live] < 0]
            at[live] += 1  # the next entry may have the same digest
            live = live[at[live] < len(self.keys)]
        return out


def suffixes(host: bytes, sizes: Iterable[int]) -> Iterator[bytes]:
    """The host and its parent domains that have one of these sizes. Work and memory follow the sizes, not the host."""
    for n in sizes:
        if 0 < n <= len(host) and (n == len(host) or host[-n - 1] == DOT):
            yield host[-n:]


def judge(rules: Digests, listed: Digests, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str]]:
    """The deciding rule (or None) and the verdict for each host and path."""
    keys: list[bytes] = []
    names: list[bytes] = []
    counts, on = [], []
    lengths = rules.lengths.tolist()
    for host, path in zip(hosts, paths):
        own, host = [], host.encode("utf-8")
        for n in lengths:
            if n <= len(path):
                start = path[:n].encode("utf-8")
                own += [(len(h), h + start) for h in suffixes(host, [size - len(start) for size in rules.sizes])]
        own.sort(key=lambda x: (-len(x[1].decode("utf-8")), -x[0]))
        keys += [k for _, k in own]
        counts.append(len(own))
        before = len(names)
        names += suffixes(host, listed.sizes)
        on.append(len(names) - before)
    hit, on_list = rules.probe(keys), listed.probe(names) >= 0
    rule, verdict, a, b = [], [], 0, 0
    for n, m in zip(counts, on):
        found = np.flatnonzero(hit[a : a + n] >= 0)
        if len(found):
            rule.append(keys[a + found[0]].decode("utf-8"))
            verdict.append(BLOCK if rules.verdicts[hit[a + found[0]]] else ALLOW)
        else:
            rule.append(None)
            verdict.append(BLOCK if on_list[b : b + m].any() else ALLOW)
        a, b = a + n, b + m
    return rule, verdict


def stored(spark: SparkSession, parts: Iterable[bytes]) -> str:
    """One file of those parts in the shared folder, fetched once by every executor; its name."""
    path = f"{shared_dir(spark).rstrip('/')}/digests-{uuid.uuid4().hex}"  # not in a scratch block: executors that join later fetch it too
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
    for part in parts:
        out.write(part)
    out.close()
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[1]


def ship(spark: SparkSession, entries: Iterable[tuple[str, int]] | DataFrame, lengths: Iterable[int] = ()) -> str:
    """The file of the entries, or of a table of (string, verdict), for ``Digests(SparkFiles.get(name))`` on any executor."""
    if not isinstance(entries, DataFrame):
        return stored(spark, [digest_bytes(entries, lengths)])
    blocks = materialise(digest_blocks(entries), "digest-blocks")
    extra = np.array(sorted(set(lengths)), "<u8")

    def column(name: str) -> Iterator[bytes]:
        return (bytes(r[0]) for r in blocks.orderBy("place", "first").select(name).toLocalIterator())  # a partition at a time

    def ends() -> Iterator[bytes]:
        last = np.uint64(0)
        yield last.tobytes()
        for sizes in column("sizes"):
            block = np.cumsum(np.frombuffer(sizes, "<u8"), dtype="<u8") + last
            last = block[-1]
            yield block.tobytes()

    n = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    try:
        return stored(spark, itertools.chain([HEAD.pack(b"digests1", n, len(extra))], column("keys"), ends(), [extra.tobytes()], column("verdicts"), column("pool")))
    finally:
        discard(blocks)


def filter_urls(pages: DataFrame, rules=RULES, listed: Iterable[str] | DataFrame = LISTED, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of every row. ``listed``: hosts, or a table whose first column holds them."""
    spark = pages.sparkSession
    rule_file = ship(spark, [(h + p, int(v == BLOCK)) for v, h, p in rules], [len(p) for _, _, p in rules])
    host_file = ship(spark, listed.select(F.col(listed.columns[0]).alias("string"), F.lit(1).alias("verdict")) if isinstance(listed, DataFrame) else [(h, 1) for h in listed])
    form = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(pages[url_col], F.lit(""))
    parts = require(pages, id_col, url_col).select(id_col, ascii_lower(F.regexp_extract(url, form, 1)).alias("host"), F.regexp_extract(url, form, 2).alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, listed = Digests(SparkFiles.get(rule_file)), Digests(SparkFiles.get(host_file))
        for batch in batches:
            rule, verdict = judge(rules, listed, batch.column(1).to_pylist(), batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[*batch.schema.names, "rule", "verdict"])

    return parts.mapInArrow(run, f"`{id_col}` {parts.schema[0].dataType.simpleString()}, host string, path string, rule string, verdict string")


def oracle() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for v, h, p in RULES)
    listed = ", ".join(f"('{h}')" for h in LISTED)
    form = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    return f"""
        WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {rules}), listed(name) AS (VALUES {listed}),
        p AS (
            SELECT row_number() OVER () AS n, page_id, translate(regexp_extract(coalesce(url, ''), '{form}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '{form}', 2) AS path
            FROM pages),
        fit AS (
            SELECT n, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
            FROM p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY n),
        bad AS (SELECT DISTINCT n FROM p JOIN listed ON host = name OR ends_with(host, '.' || name))
        SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN bad.n IS NULL THEN 'allow' ELSE 'block' END) AS verdict
        FROM p LEFT JOIN fit USING (n) LEFT JOIN bad ON p.n = bad.n"""
