"""WARC archives and a globally ordered capture index.

Writing is native: each page becomes one WARC record (an HTTP response, or a
revisit that names the response with the same payload) in gzipped archive files
of the shared folder.  Reading opens the archives through Spark's binary source
and parses them record by record.  Each archive yields an index run sorted by
(URL key, timestamp); the runs are cut at common split points into ranges, and
each range merges its k run segments with a loser tree.  Ranges are bounded by
their split points (a URL with a third of all captures is split by timestamp,
page and place), so no task holds more than a range.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator, Sequence
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinlake.llm.common import read, scratch, staged

CRLF = "\r\n"
HTTP_HEAD = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
INDEX = ("urlkey string, ts string, page_id long, payload_bytes long, payload_digest string, record_type string, "
         "refers_to long, archive string, offset long")
KEY = ["urlkey", "ts", "page_id", "archive", "offset"]


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of SHA-1: four 40-bit pieces, eight digits each."""
    h = F.sha1(payload)
    digits = [F.lpad(F.conv(F.substring(h, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*digits)), "0123456789ABCDEFGHIJKLMNOPQRSTUV",
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _uuid(page: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page.cast("string"), F.lit(""))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", captured_at: str = "2024-01-01T00:00:00Z",
                   date_col: str | None = None, min_bytes: int = 0, records_per_file: int = 20_000) -> None:
    """Write one record per row as gzipped WARC files under ``path``.

    Of the rows whose payloads are equal and have at least ``min_bytes`` bytes,
    the one with the largest id is the response and the others revisit it (rows
    that repeat that id are responses too, and if all ids are null, all are).
    Nulls: a null payload is empty, a null URL or id leaves its header out."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"))  # noqa: E731  null: left out
    text = F.coalesce(F.col(payload_col), F.lit(""))
    date = F.date_format(F.col(date_col).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'") if date_col else F.lit(None)
    p = pages.select(
        F.col(id_col).cast("long").alias("id"), F.regexp_replace(F.col(url_col), r"[\r\n]", " ").alias("u"),
        F.coalesce(date, F.lit(captured_at)).alias("at"), text.alias("t"),
        F.octet_length(text).cast("long").alias("n"), base32_sha1(F.encode(text, "UTF-8")).alias("d"))
    # only the payloads that occur under several ids need their response looked up
    dup = (p.select("id", "n", "d").filter(F.col("n") >= min_bytes).groupBy("d", "n")
           .agg(F.max("id").alias("of"), F.min("id").alias("least"), F.count("*").alias("c"), F.count("id").alias("ids"))
           .filter((F.col("of") != F.col("least")) | ((F.col("ids") > 0) & (F.col("ids") < F.col("c"))))
           .select(F.col("d").alias("dd"), F.col("n").alias("dn"), "of"))
    p = p.join(dup, (F.col("d") == F.col("dd")) & (F.col("n") == F.col("dn")), "left")
    again = F.coalesce(F.col("of").isNotNull() & ~F.col("id").eqNullSafe(F.col("of")), F.lit(False))
    only = lambda c: F.when(again, c)
    body = F.concat(F.lit(HTTP_HEAD), F.when(again, F.lit("")).otherwise(F.col("t")))
    head = F.concat_ws(
        CRLF, F.lit("WARC/1.0"), line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), _uuid(F.col("id")), F.lit(">")),
        line("WARC-Date", F.col("at")), line("WARC-Target-URI", F.col("u")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("d"))), line("X-Payload-Length", F.col("n")),
        line("X-Page-ID", F.col("id")), only(line("X-Refers-To-Page-ID", F.col("of"))),
        only(F.concat(F.lit("WARC-Refers-To: <urn:uuid:"), _uuid(F.col("of")), F.lit(">"))),
        only(line("WARC-Profile", F.lit(PROFILE))), F.lit("Content-Type: application/http; msgtype=response"),
        line("Content-Length", F.octet_length(body)))
    record = F.concat(head, F.lit(CRLF * 2), body)  # the writer's separator ends the record
    (p.select(record.alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(path))


def url_key(url: str | None) -> str:
    """Sort-friendly URL: host labels reversed, no scheme, "www." or fragment;
    null or unparsable: the text itself."""
    if not url:
        return ""
    try:
        u = urlsplit(url.strip())
        host = (u.hostname or "").removeprefix("www.")
    except ValueError:
        return url
    port = f":{u.netloc.rpartition(':')[2]}" if u.netloc.rpartition(":")[2].isdigit() else ""
    return ",".join(reversed(host.split("."))) + port + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")


def parse_archive(name: str, content: bytes) -> Iterator[tuple]:
    """Index rows of one archive; payloads are read by their Content-Length and
    checked against their digest."""
    with gzip.GzipFile(fileobj=io.BytesIO(content)) as f:
        while True:
            at = f.tell()
            version = f.readline()
            if not version:
                return
            if version != b"WARC/1.0\r\n":
                raise ValueError(f"{name}: no record at {at}")
            h = {}
            while (raw := f.readline()) not in (b"\r\n", b""):
                k, _, v = raw.decode("utf-8").rstrip(CRLF).partition(": ")
                h[k] = v
            block = f.read(int(h["Content-Length"]))
            if f.read(4) != b"\r\n\r\n":
                raise ValueError(f"{name}: record at {at} does not end where its length says")
            n, digest = int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:")
            if h["WARC-Type"] == "response":
                payload = block[block.index(b"\r\n\r\n") + 4:]
                n, found = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                if found != digest:
                    raise ValueError(f"{name}: payload at {at} does not match its digest")
            page, refers = h.get("X-Page-ID"), h.get("X-Refers-To-Page-ID")
            yield (url_key(h.get("WARC-Target-URI")), h["WARC-Date"], int(page) if page else None, n, digest,
                   h["WARC-Type"], int(refers) if refers else None, name, at)


def _order(row: tuple) -> tuple:
    """Index order; a null page id sorts first."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[7], row[8]


def read_runs(spark, path: str) -> DataFrame:
    """One locally sorted index run per archive."""
    def parse(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                rows = sorted(parse_archive(name.rpartition("/")[2], bytes(content)), key=_order)
                yield pd.DataFrame(rows, columns=INDEX_NAMES).astype(INDEX_TYPES)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInPandas(parse, INDEX)


INDEX_NAMES = [c.split()[0] for c in INDEX.split(", ")]
INDEX_TYPES = {"page_id": "Int64", "refers_to": "Int64"}


def loser_tree_merge(runs: Sequence[Iterator], key=lambda x: x) -> Iterator:
    """Merge k sorted iterators with a tournament tree of losers: after each
    output only the path from the winner's leaf to the root is replayed."""
    k = len(runs)
    if not k:
        return
    head = [next(r, None) for r in runs]
    keys = [None if h is None else (key(h), i) for i, h in enumerate(head)]

    def beats(a, b):  # an exhausted run loses to every other
        return keys[b] is None or (keys[a] is not None and keys[a] < keys[b])

    losers, winners = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    champion = winners[1] if k > 1 else 0
    while head[champion] is not None:
        yield head[champion]
        nxt = next(runs[champion], None)
        head[champion], keys[champion] = nxt, None if nxt is None else (key(nxt), champion)
        node = (champion + k) // 2
        while node:
            if beats(losers[node], champion):
                champion, losers[node] = losers[node], champion
            node //= 2


def _splits(runs: DataFrame, range_rows: int) -> list[tuple]:
    """Split points of the index order from a bounded sample (at most 20,000 keys)."""
    n = runs.count()
    ranges = max(1, -(-n // range_rows))
    if ranges == 1:
        return []
    keep = min(10_000, 200 * ranges) / n  # half of the limit at most: the draw covers all archives
    sample = (runs.filter(F.shiftrightunsigned(F.xxhash64("archive", "offset"), 1) < F.lit(int(min(keep, 1) * (2 ** 63 - 1))))
              .select(*KEY).limit(20_000).collect())
    keys = sorted((r[0], r[1], r[2] is not None, r[2] or 0, r[3], r[4]) for r in sample)
    return sorted({keys[i * len(keys) // ranges] for i in range(1, ranges) if keys})


def merge_runs(runs: DataFrame, range_rows: int = 100_000) -> DataFrame:
    """Globally ordered index: ``position`` is gapless from 0 along
    (URL key, timestamp, page id).  ``runs`` is a written table, each archive's
    rows sorted.  An empty table gives an empty table."""
    splits = _splits(runs, range_rows)
    me = F.struct(F.col("urlkey"), F.col("ts"), F.col("page_id").isNotNull(),
                  F.coalesce(F.col("page_id"), F.lit(0).cast("long")), F.col("archive"), F.col("offset"))

    def search(lo, hi):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi + 1) // 2
        s = splits[mid - 1]
        cut = F.struct(F.lit(s[0]), F.lit(s[1]), F.lit(s[2]), F.lit(s[3]).cast("long"), F.lit(s[4]),
                       F.lit(s[5]).cast("long"))
        return F.when(me < cut, search(lo, mid - 1)).otherwise(search(mid, hi))
    ranged = runs.withColumn("rng", search(0, len(splits)))

    def merge(pdf):
        pdf = pdf.sort_values(["archive"], kind="stable")
        segments = []
        for _, seg in pdf.groupby("archive", sort=True):
            rows = list(seg[INDEX_NAMES].astype(object).where(seg[INDEX_NAMES].notna(), None).itertuples(index=False))
            segments.append(iter(sorted((tuple(r) for r in rows), key=_order)))  # a shuffle may reorder a segment
        out = pd.DataFrame(list(loser_tree_merge(segments, _order)), columns=INDEX_NAMES).astype(INDEX_TYPES)
        out["rng"], out["pos"] = int(pdf["rng"].iloc[0]), range(len(out))
        return out
    merged = ranged.groupBy("rng").applyInPandas(merge, INDEX + ", rng int, pos long")
    before = Window.orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = ranged.groupBy("rng").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("rng").alias("orng"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("o"))
    return merged.join(offsets, F.col("rng") == F.col("orng")).select(
        *INDEX_NAMES, (F.col("pos") + F.col("o")).alias("position"))


def round_trip(pages: DataFrame, **kw) -> DataFrame:
    """Write ``pages`` as archives, read them back, return the merged index."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_archives(pages, path, **kw)
    return merge_runs(staged(read_runs(spark, path), "cdx"))


def op8_warc_merge(spark, sf_dir):
    index = round_trip(read(spark, sf_dir, "pages", "page_id", "url", "html"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "position")


QUERIES = {"op8_warc_merge": op8_warc_merge}
