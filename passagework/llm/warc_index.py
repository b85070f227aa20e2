"""WARC archives with a two-level capture index.

Writing: each task packs pages into WARC files of gzip members, one record a member, in a folder that all
executors share. Pages with equal payloads of at least ``REVISIT_BYTES`` bytes are stored once: the one with
the largest page_id is a response, the others are revisits that name it.

Index: captures are range-sorted by reversed-host key and page_id; each range is written as one file of
compressed blocks of ``BLOCK_LINES`` lines, with a sparse directory of the blocks' first keys beside it. The
list of files (one row for each range, so bounded by the number of shuffle partitions) is all that lookups
broadcast.

Lookup: keys are range-sorted too; a task finds the file, then the block, then the line by binary search,
reads the block and the record by their byte ranges, and unpacks the record.

Defined cases: null html is an empty payload; null url has the key of no host; rows that repeat page_id and
payload are of one type and are all kept; rows without page_id are never responses that others refer to; an
empty table gives empty archives and no rows. A task that is run again writes new files, and only files named
in the written capture table are read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.session import scratch_path, written

REVISIT_BYTES = 1000
FILE_BYTES = 64_000_000
BLOCK_LINES = 2000
DATE = "1970-01-01T00:00:00Z"
CAPTURE = "sort string, page_id long, file string, offset long, length long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"


def key_of(url: Column) -> Column:
    """The reversed-host key, ``org,example,www)/path?query``; white space and control characters are one plus sign."""
    url = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[^:/?#]+://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    rest = F.regexp_extract(url, r"(?s)^[^:/?#]+://[^/?#]*(.*)$", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", F.lit("/")).otherwise(rest))
    return F.regexp_replace(key, r"[\x00-\x20\x7f\x{85}\x{2028}\x{2029}]+", "+")


def sort_of(url: Column, page_id: Column) -> Column:
    """Key and page_id in one string that sorts by both."""
    return F.concat_ws(" ", key_of(url), F.coalesce(F.lpad(page_id.cast("string"), 20, "0"), F.lit("-")))


def store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", folder))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": name(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or ""),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
    }
    if refers_to is not None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": name(refers_to)}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(body))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + body + b"\r\n\r\n"


def unpack(raw: bytes) -> dict:
    """The fields of one record. Length and digest are those of the payload as read; of a revisit, which has none, those
    that it claims. ``intact`` tells whether a stored payload has the digest and length that its headers claim."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    h = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(h["Content-Length"])].partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    number = lambda s: int(s) if (s := s.removeprefix("<urn:page:").removesuffix(">")) else None
    whole = True
    if h["WARC-Type"] != "revisit":
        claimed = (size, digest)
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        whole = claimed == (size, digest)
    return {
        "page_id": number(h["WARC-Record-ID"]), "url": h["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest,
        "record_type": h["WARC-Type"], "refers_to": number(h.get("WARC-Refers-To", "<urn:page:>")), "intact": whole,
    }


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write every page; returns the written capture table."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    large = rows.where(F.octet_length("html") >= REVISIT_BYTES).select("page_id", "digest")
    large = written(large, "payloads")
    kept = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = large.join(kept, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to")) & F.col("refers_to").isNotNull()).distinct()
    same = rows["page_id"].eqNullSafe(again["page_id"]) & (rows["digest"] == again["digest"])
    typed = rows.join(again.hint("shuffle_hash"), same, "left").select(sort_of(rows["url"], rows["page_id"]).alias("sort"), rows["page_id"], "url", "html", rows["digest"], "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = store(folder)
        system.create_dir(root, recursive=True)
        out, name, at, done = None, "", 0, []

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pylist(done, pa.schema([("sort", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, at, done = f"{uuid.uuid4().hex}.warc.gz", 0, []
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                raw = record(row["page_id"], row["url"], row["html"].encode(), row["digest"], row["refers_to"])
                member = packer.compress(raw) + packer.flush()
                out.write(member)
                done.append({"sort": row["sort"], "page_id": row["page_id"], "file": name, "offset": at, "length": len(member)})
                at += len(member)
                if at >= FILE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return written(typed.mapInArrow(write, CAPTURE), "captures")


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Write the sorted blocks and their directories; returns the written list of files with their first and last keys."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = store(folder)
        system.create_dir(root, recursive=True)
        name, out, at, directory, lines, first, last = uuid.uuid4().hex, None, 0, [], [], None, None

        def flush() -> None:
            nonlocal at, lines
            data = zlib.compress("\n".join(lines).encode())
            out.write(data)
            directory.append((lines[0].split("\t", 1)[0], at, len(data)))
            at, lines = at + len(data), []

        for batch in batches:
            for sort, _, file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out, first = system.open_output_stream(f"{root}/{name}.blocks", compression=None), sort
                lines.append(f"{sort}\t{file}\t{offset}\t{length}")
                last = sort
                if len(lines) == BLOCK_LINES:
                    flush()
        if out is not None:
            if lines:
                flush()
            out.close()
            with system.open_output_stream(f"{root}/{name}.directory", compression=None) as f:
                f.write(json.dumps(directory).encode())
            yield pa.RecordBatch.from_pylist([{"file": name, "first": first, "last": last}])

    ordered = captures.repartitionByRange("sort", "file", "offset").sortWithinPartitions("sort", "file", "offset")
    return written(ordered.mapInArrow(write, "file string, first string, last string"), "index-files")


class Reader:
    """Reads blocks and records by byte range; keeps a few directories, blocks and open files."""

    def __init__(self, folder: str, index: str, files: list[tuple[str, str, str]]):
        self.system, self.root = store(folder)
        _, self.index = store(index)
        self.files = sorted(files, key=lambda f: (f[1], f[2]))
        self.firsts = [f[1] for f in self.files]
        self.kept: dict = {}

    def keep(self, key: tuple, make):
        if key not in self.kept:
            if len(self.kept) >= 64:
                self.kept.pop(next(iter(self.kept)))
            self.kept[key] = make()
        return self.kept[key]

    def open(self, path: str):
        return self.keep(("open", path), lambda: self.system.open_input_file(path))

    def directory(self, name: str) -> tuple[list[str], list]:
        def load():
            found = json.loads(self.open(f"{self.index}/{name}.directory").readall())
            return [d[0] for d in found], found

        return self.keep(("directory", name), load)

    def lines(self, name: str, at: int, size: int) -> list[str]:
        return self.keep((name, at), lambda: zlib.decompress(self.open(f"{self.index}/{name}.blocks").read_at(size, at)).decode().split("\n"))

    def find(self, sort: str) -> Iterator[dict]:
        """The records of one sort key."""
        upto = bisect.bisect_right(self.firsts, sort)
        n = max(bisect.bisect_left(self.firsts, sort) - 1, 0)  # the key may begin in the file before
        for name, _, last in self.files[n:upto]:
            if last < sort:
                continue
            firsts, directory = self.directory(name)
            for _, at, size in directory[max(bisect.bisect_left(firsts, sort) - 1, 0) : bisect.bisect_right(firsts, sort)]:
                lines = self.lines(name, at, size)
                i = bisect.bisect_left(lines, sort + "\t")
                while i < len(lines) and lines[i].startswith(sort + "\t"):
                    _, file, offset, length = lines[i].split("\t")
                    yield unpack(zlib.decompress(self.open(f"{self.root}/{file}").read_at(int(length), int(offset)), 31))
                    i += 1


def lookup(asked: DataFrame, archives: str, index: str, files: DataFrame) -> DataFrame:
    """Every stored record of the distinct (url, page_id) of ``asked``."""
    sorts = asked.select(sort_of(asked["url"], asked["page_id"]).alias("sort")).distinct()
    listed = files.sparkSession.sparkContext.broadcast([tuple(r) for r in files.select("file", "first", "last").collect()])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(archives, index, listed.value)
        kind = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_())])
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                found = [r for s in batch.column(0).slice(start, 1000).to_pylist() for r in reader.find(s)]
                yield pa.RecordBatch.from_pylist(found, kind)

    # a stated number of tasks: keys are small, and by their bytes all reads would be merged into a few tasks
    parts = max(len(listed.value), int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return sorts.repartitionByRange(parts, "sort").sortWithinPartitions("sort").mapInArrow(read, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive and index pages in the shared folder, then look every page up again."""
    spark = pages.sparkSession
    archives, index = scratch_path(spark, "warc"), scratch_path(spark, "warc-index")
    files = write_index(write_archives(pages, archives), index)
    return lookup(pages, archives, index, files)


def resolved(records: DataFrame) -> DataFrame:
    """Records with the length and digest of the payload that was read back: a revisit's are those of the response it
    refers to. Fails on a damaged payload and on a revisit without the response that it claims to repeat."""
    records = written(records, "records")
    payloads = records.where("record_type = 'response'").select(F.col("page_id").alias("to"), F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("digest")).distinct()
    same = (records["refers_to"] == payloads["to"]) & (records["payload_digest"] == payloads["digest"]) & (records["payload_bytes"] == payloads["n"])
    whole = records.join(payloads, same, "left")
    revisit = F.col("record_type") == "revisit"
    fail = F.when(~F.col("intact"), F.raise_error(F.concat(F.lit("damaged payload of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("-")))))
    fail = fail.when(revisit & F.col("to").isNull(), F.raise_error(F.concat(F.lit("no response for the revisit of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("-")))))
    checked = {"payload_bytes": F.coalesce(fail.cast("long"), F.when(revisit, F.col("n")).otherwise(F.col("payload_bytes"))), "payload_digest": F.when(revisit, F.col("digest")).otherwise(F.col("payload_digest"))}
    return whole.withColumns(checked).select(*records.columns)
