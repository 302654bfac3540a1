"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Archives are plain text sinks whose line end is the record's own, so Spark's committer writes them to any
store. Of equal payloads the row with the least id is a response with the payload, the others are revisits
that carry only the HTTP head. Which rows those are is decided on digests alone, over salted groups; pages
move through a shuffle only where the table of revisits is too large to broadcast.

The reader parts the files at every magic line, in splits. Each task emits, for each candidate, its length
and that of the record its header declares (so its successor), and what the record says if it ends where
the next candidate begins. Per file, pointer jumping over successors keeps what the chain from the file's
start reaches; a magic line inside a payload starts no record. Records that hold such lines are put together
again from their parts, found in a second scan by 128 bits of hash, however that scan is split: no more of a file than
those records moves. A part that is not found ends the job with an error.

A null html is an empty payload; a null url is written as ``about:blank``, and controls, spaces and line
separators of any kind in urls are percent-encoded. Only CRLF ends a header line, and only a record's own header is read. Rows that repeat the least id of their payload are responses too, as are rows with a
null id, to which nothing refers. Payloads of any length are kept whole. An empty table gives no records.
Bytes before a file's first magic, or after the chain breaks, are no records. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, fresh_path, materialise, require

MAGIC, END = "WARC/1.1\r\n", "\r\n"
GAP = END + END
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed value: the alphabet of base32.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SALTS = 32


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: character i is bits 5i to 5i+4 of the 160."""
    nibbles = [(5 * i // 4, 3 - 5 * i % 4) for i in range(32)]

    def spelled(h: Column) -> Column:
        value = [F.shiftright(F.conv(F.substring(h, d + 1, 2), 16, 10).cast("int"), s).bitwiseAND(31) for d, s in nibbles]
        return F.concat(*[F.substring(F.lit(ALPHABET), v + 1, F.lit(1)) for v in value])

    return F.transform(F.array(F.sha1(data)), spelled)[0]  # so that the SHA-1 is computed once


def revisits(digests: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(id, digest, first) of rows of (id, digest, n) that repeat a payload first seen at a smaller id."""
    firsts = digests.filter(F.col("n") >= least_bytes).groupBy("digest", "n").agg(F.min("id").alias("first"), F.count("*").alias("rows")).filter("rows > 1")
    spread = firsts.select("digest", "n", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = digests.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    return salted.join(spread, ["digest", "n", "salt"]).filter("id > first").select("id", "digest", "first").distinct()


def uuid_of(*parts: Column) -> Column:
    return F.regexp_replace(F.md5(F.concat_ws("/", *parts)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")


#: What may end a line, or is read as a space, in any reader: C0 and C1 controls, space, delete, and Unicode's line ends.
UNSAFE = "".join(map(chr, [*range(0x21), *range(0x7F, 0xA1), 0x2028, 0x2029, 0xFEFF]))


def one_line(url: Column) -> Column:
    """``url`` with every control, space and line separator percent-encoded, byte by byte of its UTF-8."""
    safe = url
    for c in UNSAFE:
        safe = F.replace(safe, F.lit(c), F.lit("".join(f"%{b:02X}" for b in c.encode("utf-8"))))
    return F.when(url.rlike("[" + "".join(f"\\u{ord(c):04X}" for c in UNSAFE) + "]"), safe).otherwise(url)


def write_warc(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """One record per row under ``path``."""
    url = one_line(F.coalesce(pages[url_col], F.lit("about:blank")))
    rows = require(pages, id_col, url_col, html_col).select(F.col(id_col).cast("long").alias("id"), url.alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("html").cast("binary")), "n": F.octet_length("html").cast("long")})
    again = materialise(revisits(rows.select("id", "digest", "n"), least_bytes), "revisits")
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    seen = F.col("first").isNotNull()
    head = text("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ", F.col("n").cast("string"), GAP)
    fields = text(
        "WARC-Type: ", F.when(seen, "revisit").otherwise("response"), END,
        "WARC-Record-ID: ", uuid_of(F.coalesce(F.col("id").cast("string"), F.lit("none")), F.col("digest")), END,
        "WARC-Date: ", date, END,
        "WARC-Target-URI: ", F.col("url"), END,
        "WARC-Payload-Digest: sha1:", F.col("digest"), END,
        F.when(seen, text("WARC-Profile: ", PROFILE, END, "WARC-Refers-To: ", uuid_of(F.col("first").cast("string"), F.col("digest")), END, "X-Refers-To-Page: ", F.col("first").cast("string"), END)).otherwise(""),
        F.when(F.col("id").isNotNull(), text("X-Page: ", F.col("id").cast("string"), END)).otherwise(""),
        "Content-Type: application/http;msgtype=response\r\n",
    )
    block = text(head, F.when(seen, "").otherwise(F.col("html")))
    record = text(MAGIC, fields, "Content-Length: ", F.octet_length(block).cast("string"), GAP, block, END)
    rows.join(again, ["id", "digest"], "left").select(record.alias("value")).write.option("lineSep", END).text(path)


def field_of(header: Column, name: str) -> Column:
    """A header's first field of that name, null where it is missing or empty. Lines end with CRLF and with nothing else."""
    return F.nullif(F.regexp_extract(header, rf"(?i)(?:\A|\r\n){name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def field(name: str) -> Column:
    return field_of(F.col("header"), name)


def number(text: Column) -> Column:
    """A whole number, null for anything else."""
    return F.when(text.rlike(r"\A-?[0-9]{1,18}\z"), text).try_cast("long")


def parts_of(spark: SparkSession, path: str) -> DataFrame:
    """What stands between magic lines: file, split, order in the split, text."""
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("seq"), "value", F.xxhash64("value").alias("h1"), F.xxhash64("value", F.lit(1)).alias("h2"))


SAID = "file string, split long, seq long, h1 long, h2 long, size long, declared long, record_type string, id long, refers_to long, payload_bytes long, payload_digest string, said_digest string, target_uri string"


def parsed(value: DataFrame) -> DataFrame:
    """Adds to rows with a whole or cut record in ``value`` what its headers and payload say; columns as in SAID."""
    whole = value.withColumns({"size": F.octet_length("value").cast("long"), "header": F.substring_index("value", GAP, 1)})
    whole = whole.withColumns({"length": number(field("Content-Length")), "record_type": field("WARC-Type"), "at": F.octet_length("header") + 4})
    heads = F.substring_index("value", GAP, 2)  # the record's own and, in its block, the HTTP head
    revisit = F.col("record_type") == "revisit"
    whole = whole.withColumns({"declared": F.col("at") + F.col("length") + 4, "body_at": F.octet_length(heads) + 4})
    payload = F.substring(F.col("value").cast("binary"), F.col("body_at") + 1, F.greatest(F.col("declared") - 4 - F.col("body_at"), F.lit(0)).cast("int"))
    is_whole = F.col("declared") == F.col("size")
    said = F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "")
    http = F.substring(heads, F.length("header") + 5, F.length(heads))
    whole = whole.withColumn("payload", F.when(is_whole & ~revisit, payload))
    return whole.withColumns(
        {
            "id": number(field("X-Page")),
            "refers_to": number(field("X-Refers-To-Page")),
            "payload_bytes": F.when(revisit, number(field_of(http, "Content-Length"))).otherwise(F.octet_length("payload").cast("long")),
            "payload_digest": F.when(revisit, said).otherwise(base32_sha1(F.col("payload"))),
            "said_digest": said,
            "target_uri": field("WARC-Target-URI"),
        }
    ).drop("payload")


def chained(rows: pd.DataFrame) -> pd.DataFrame:
    """The candidates of one file that the chain from its start reaches, with their offsets."""
    rows = rows.sort_values(["split", "seq"], ignore_index=True)
    size = rows["size"].to_numpy(np.int64)
    start = np.concatenate(([0], np.cumsum(size + len(MAGIC))[:-1]))  # of each part's text; its magic stands before
    n = len(rows)
    after = start + rows["declared"].fillna(-1).to_numpy(np.int64) + len(MAGIC)
    end = start[-1] + size[-1] + len(MAGIC)
    at = np.searchsorted(start, after)
    jump = np.where((rows["declared"].notna().to_numpy()) & (at < n) & (start[np.minimum(at, n - 1)] == after), at, n)
    broken = (jump == n) & (after != end)
    jump = np.append(np.where(np.arange(n) == 0, 1 if n > 1 and size[0] == 0 else n, jump), n)  # the first part stands before any magic
    reached = np.zeros(n + 1, bool)
    reached[0] = True
    step, hop = 1, jump
    while step < n + 1:  # after k rounds all that 2**k links reach
        reached[hop[np.flatnonzero(reached)]] = True
        hop, step = hop[hop], 2 * step
    keep = reached[:n] & ~broken & (np.arange(n) > 0)
    out = rows[keep].copy()
    out["offset"] = start[keep] - len(MAGIC)
    ends = jump[:n][keep]
    for name in ("h1", "h2"):
        h = rows[name].to_numpy()
        out[f"parts_{name}"] = [h[i:j] if j > i + 1 else None for i, j in zip(np.flatnonzero(keep), ends)]
    return out


def records(spark: SparkSession, path: str) -> DataFrame:
    """Every record under ``path``: file, offset, record_type, id, refers_to, payload_bytes, payload_digest, said_digest, target_uri."""
    names = [c.split()[0] for c in SAID.split(", ")]
    candidates = parsed(parts_of(spark, path)).select(*names)
    kept = materialise(candidates.groupBy("file").applyInPandas(chained, f"{SAID}, offset long, parts_h1 array<long>, parts_h2 array<long>"), "records")
    out = ["file", "offset", *names[names.index("declared") + 1 :]]
    whole = kept.filter("parts_h1 IS NULL").select(*out)
    cut = kept.filter("parts_h1 IS NOT NULL")
    if cut.isEmpty():
        return whole
    # records with magic lines inside: only their own parts move, found by what they hold, so that splits may be cut otherwise in this scan
    each = F.posexplode(F.arrays_zip("parts_h1", "parts_h2")).alias("k", "h")
    wanted = cut.select("file", "offset", each).select("file", "offset", "k", F.col("h.parts_h1").alias("h1"), F.col("h.parts_h2").alias("h2"))
    asked = bounded(wanted.select("file", "h1", "h2").distinct(), "asked-parts")
    inside = parts_of(spark, path).join(asked, ["file", "h1", "h2"]).groupBy("file", "h1", "h2").agg(F.first("value").alias("value"))  # equal parts are the same text
    found = wanted.join(inside, ["file", "h1", "h2"], "left")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda x: x["value"]), MAGIC)  # one record
    joined = found.groupBy("file", "offset").agg(text.alias("value"), (F.count("value") == F.count("*")).alias("complete"))
    again = parsed(joined).withColumn("record_type", F.when(F.col("complete") & (F.col("declared") == F.col("size")), F.col("record_type")).otherwise(F.raise_error(F.lit("WARC: parts of a record are missing"))))
    return whole.unionByName(again.select(*out))


def round_trip(pages: DataFrame, **names: str) -> DataFrame:
    """Write all pages to archives in the shared folder and read those back."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_warc(pages, path, **names)
    return records(spark, path)


ORACLE = f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
    q AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
    SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
           array_to_string(list_transform(range(32), lambda i: substring('{ALPHABET}', (((('0x' || substring(h, (5 * i // 4 + 1)::INTEGER, 2))::INTEGER >> (3 - 5 * i % 4)::INTEGER) & 31) + 1)::INTEGER, 1)), '') AS payload_digest,
           CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN page_id > first THEN first END AS refers_to
    FROM q"""
