"""WARC archives, and an external merge of their capture indexes.

Writing: every page becomes a WARC/1.1 record, payload the html in UTF-8. Of the records with
one payload (at least `least` bytes) that with the largest id is a response, the others are
revisits that name it and carry no payload. Each record is a gzip member of its own, so that an
index's offset can be sought and read alone (one of 16 MB or more is several members in a row).
Members are gathered to blobs of bounded bytes, and Spark's text writer writes a bounded count
of blobs to a file: a member's last byte is the top of its size, zero, and so is the writer's
line separator. So archives land on any file system that Spark reaches, and a lost task's files
are written again whole.

Reading: archives are read whole, one file a row, member by member; their size is bounded by
bytes (ARCHIVE_BLOBS blobs of about BLOB_BYTES before compression, and one record over).

Index: captures (url key, timestamp, id, file, offset, length) are dealt to key ranges. In each,
the captures of a set of archives, RUNS sets in all, are a locally sorted run, and a loser tree
merges the runs, so that the ranges one after another are the captures of each key in order of
time. A key that holds more captures than a range should is cut further by timestamp and id.

Null html is an empty payload; null urls are empty. Repeated rows each get a record: ids are
expected to be unique, and rows that repeat an id with one payload are all responses or all
revisits. Rows without an id are left out. An empty table gives no records. Other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.common import buffers, groups_for, shared_dir, written

#: Bytes (before compression) and records in one blob, about; blobs in one archive file; bytes in one gzip member.
BLOB_BYTES, BLOB_RECORDS, ARCHIVE_BLOBS, MEMBER_BYTES = 4 << 20, 256, 8, (1 << 24) - 1
#: Captures in one range of the index, about, and sorted runs in a range, at most.
RANGE, RUNS = 200_000, 64
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def digest(payload: Column) -> Column:
    """Bare upper-case base32 of the payload's SHA-1: each 5 hex digits make 4 characters."""
    sha = F.sha1(payload)
    out = []
    for i in range(8):
        n = F.conv(F.substring(sha, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(_ALPHABET), F.shiftright(n, 15 - 5 * k).bitwiseAND(31) + 1, F.lit(1)) for k in range(4)]
    return F.concat(*out)


def url_key(url: Column) -> Column:
    """Sort-friendly form: host labels reversed, no scheme, www, port or fragment, lower case."""
    rest = F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?|#.*$", "")
    host = F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^www[0-9]*\.|:[0-9]*$", "")
    path = F.regexp_extract(rest, r"^[^/?#]*(.*)$", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(path == "", "/").otherwise(path))


def _with_digests(pages: DataFrame, id_col: str, url_col: str, body_col: str, time: Column, least: int) -> DataFrame:
    """Each page with its payload, digest, record type and the response it refers to."""
    body = F.coalesce(F.col(body_col), F.lit(""))
    rows = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), time.alias("time"), body.alias("body"))
    rows = rows.withColumn("bytes", F.octet_length("body").cast("long")).withColumn("digest", digest(F.col("body").cast("binary")))
    # Only digests meet here: counted before the shuffle, one row each after it. Written, so that their true size decides the join.
    first = written(rows.select("id", "bytes", "digest").where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("id").alias("response"), F.count("*").alias("copies")).where("copies > 1").drop("copies"))
    shared = rows.join(first, ["digest", "bytes"], "left")
    again = F.col("response").isNotNull() & (F.col("id") != F.col("response"))
    return shared.select("id", "url", "time", "body", "bytes", "digest", F.when(again, "revisit").otherwise("response").alias("type"), F.when(again, F.col("response")).alias("refers_to"))


def _record(date: Column) -> Column:
    """The record's text."""
    uuid = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    revisit = F.col("type") == "revisit"
    body = F.when(revisit, "").otherwise(F.col("body"))
    head = [
        "WARC/1.1\r\nWARC-Type: ", F.col("type"), "\r\nWARC-Record-ID: ", uuid(F.col("id")), "\r\nWARC-Date: ", date,
        "\r\nWARC-Target-URI: ", F.regexp_replace("url", r"[\r\n]", "%0A"), "\r\nWARC-Payload-Digest: sha1:", F.col("digest"), "\r\nWARC-Payload-Length: ", F.col("bytes").cast("string"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), uuid(F.col("refers_to")))).otherwise(""),
        "\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ", F.octet_length(body).cast("string"), "\r\n\r\n", body, "\r\n\r\n",
    ]
    return F.concat(*(F.lit(x) if isinstance(x, str) else x for x in head))


def _member(record: bytes) -> bytes:
    """A record as gzip members that each hold less than 16 MB, so that the last byte is zero."""
    out = []
    for i in range(0, len(record), MEMBER_BYTES):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += [z.compress(record[i : i + MEMBER_BYTES]), z.flush()]
    return b"".join(out)


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records gathered to blobs, without their last byte."""
    held, size = [], 0
    blob = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["value"])
    for batch in batches:
        data, off = buffers(batch.column(0))
        for a, b in zip(off[:-1], off[1:], strict=True):
            held.append(_member(data[a:b].tobytes()))
            size += int(b - a)
            if size >= BLOB_BYTES or len(held) >= BLOB_RECORDS:
                yield blob()
                held, size = [], 0
    if held:
        yield blob()


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", time_col: str | None = None, least: int = 0) -> None:
    """Writes archives under path. Without a time column, captures are one second apart by id."""
    time = F.col(time_col).cast("timestamp") if time_col else F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.col(id_col).cast("long"), F.lit(1 << 30)))
    rows = _with_digests(pages, id_col, url_col, body_col, time, least)
    at = F.date_format(F.to_utc_timestamp(F.coalesce("time", F.timestamp_seconds(F.lit(0))), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    blobs = rows.select(_record(at).alias("value")).mapInArrow(_blobs, "value binary")
    blobs.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", ARCHIVE_BLOBS).text(path)


RECORD = "file string, start long, length long, id long, type string, date string, url string, digest string, payload_bytes long, refers_to long, payload binary"
_TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def members(content) -> Iterator[tuple[int, int, dict, bytes]]:
    """(offset, length, header fields, payload) of each record of an archive, or of a piece of one that starts at a record."""
    at, size = 0, len(content)
    while at < size:
        start, data, end = at, bytearray(), -1
        while end < 0 or len(data) < end + 8 + int(head[b"Content-Length"]):
            if at >= size:
                raise ValueError(f"broken record at {start}")
            z = zlib.decompressobj(31)
            while not z.eof:
                piece = content[at : at + 65536]
                if not len(piece):
                    raise ValueError(f"broken member at {start}")
                data += z.decompress(piece)
                at += len(piece)
            at -= len(z.unused_data)
            if end < 0 and (end := data.find(b"\r\n\r\n")) >= 0:
                head = dict(line.split(b": ", 1) for line in bytes(data[:end]).split(b"\r\n")[1:])
        body = bytes(data[end + 4 : -4])
        if len(body) != int(head[b"Content-Length"]) or data[-4:] != b"\r\n\r\n":
            raise ValueError(f"broken record at {start}")
        yield start, at - start, head, body


def _cut(with_payload: bool):
    names, types = zip(*(x.split() for x in RECORD.split(", ")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_of = lambda out: pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out, held = [], 0
                for start, length, head, body in members(memoryview(content.as_buffer())):
                    page = lambda key: int(head[key].rsplit(b":", 1)[1][:-1]) if key in head else None  # noqa: B023, E731
                    kind, sha = head[b"WARC-Type"].decode(), head[b"WARC-Payload-Digest"].split(b":")[1].decode()
                    if kind == "response" and base64.b32encode(hashlib.sha1(body).digest()).decode() != sha:
                        raise ValueError(f"{path}: wrong digest at {start}")
                    out.append((path, start, length, page(b"WARC-Record-ID"), kind, head[b"WARC-Date"].decode(), head[b"WARC-Target-URI"].decode(), sha, int(head[b"WARC-Payload-Length"]), page(b"WARC-Refers-To"), body if with_payload else None))
                    held += len(body) if with_payload else 0
                    if len(out) >= 1000 or held >= BLOB_BYTES:
                        yield batch_of(out)
                        out, held = [], 0
                if out:
                    yield batch_of(out)

    return run


def read(spark, path: str, payload: bool = False) -> DataFrame:
    """The records of all archives under path; payload null unless asked for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content")
    return files.mapInArrow(_cut(payload), RECORD)


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, the top the winner."""

    def __init__(self, runs: list[Iterable[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        k = len(self.runs)
        self.losers = [-1] * max(k, 1)
        for i in range(k):
            self._play(i)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None and (x is not None or a < b) or (x is not None and y is not None and (x, a) < (y, b))

    def _play(self, i: int) -> None:
        """Run i plays from its leaf to the top; an empty node keeps it until its rival comes."""
        node = (i + len(self.runs)) // 2
        while node:
            held = self.losers[node]
            if held < 0:
                self.losers[node] = i
                return
            if self._before(held, i):
                self.losers[node], i = i, held
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and self.heads[w := self.losers[0]] is not None:
            yield self.heads[w]
            self.heads[w] = next(self.runs[w], None)
            self._play(w)


ENTRY = "key string, date string, id long, file string, start long, length long, type string, digest string, payload_bytes long, refers_to long"


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """One range's sorted runs, merged; before is the date of the key's capture before, in this range."""
    runs = [map(tuple, map(dict.values, run)) for run in pdf.sort_values("run").captures]
    names = [x.split()[0] for x in ENTRY.split(", ")]
    out = pd.DataFrame(list(LoserTree(runs)), columns=names).astype({"refers_to": "Int64"})
    out["before"] = out["date"].shift().where(out["key"] == out["key"].shift())
    out.insert(0, "range", pdf["range"].iloc[0])
    out.insert(1, "position", range(len(out)))
    return out


def index(records: DataFrame, per_range: int = RANGE, runs: int = RUNS) -> DataFrame:
    """Globally ordered capture index: range, position, ENTRY's columns, before.

    The captures of a range that come from one set of archives are a run, sorted where it is
    gathered. Ranges are cut from a sample of (key, date, id), so one hot key spans several of them.
    """
    # Written, so that archives are unzipped once and not again to count and to sample.
    captures = written(records.withColumn("key", url_key(F.col("url"))).select(*(x.split()[0] for x in ENTRY.split(", "))))
    ranges = groups_for(captures.count(), per_range)
    dealt = captures.repartitionByRange(ranges, "key", "date", "id").withColumn("range", F.spark_partition_id().cast("long"))
    run = F.pmod(F.xxhash64("file"), F.lit(runs)).alias("run")
    sorted_runs = dealt.groupBy("range", run).agg(F.array_sort(F.collect_list(F.struct(*captures.columns))).alias("captures"))
    return sorted_runs.groupBy("range").applyInPandas(_merge, f"range long, position long, {ENTRY}, before string")


def histories(index: DataFrame) -> DataFrame:
    """The index with before complete: a range's first capture follows the last of the range before, if that has its key.

    Only the ranges' last captures meet, a row for each range; no key's captures do.
    """
    entries = written(index)
    last = entries.groupBy(F.col("range").alias("r")).agg(F.max_by(F.struct("key", "date"), "position").alias("last"))
    last = last.select(F.lead("r").over(Window.orderBy("r")).alias("range"), F.lit(0).cast("long").alias("position"), F.col("last.key").alias("last_key"), F.col("last.date").alias("last_date"))
    joined = entries.join(last, ["range", "position"], "left")
    return joined.withColumn("before", F.coalesce("before", F.when(F.col("key") == F.col("last_key"), F.col("last_date")))).drop("last_key", "last_date")


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """The pages written as archives and read back: one row for each record."""
    path = shared_dir(pages.sparkSession)
    write(pages, path, least=least)
    return read(pages.sparkSession, path)
