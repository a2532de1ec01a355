"""WARC by boundary-chain verification.

Tasks scan byte ranges of WARC files for the magic at a line's start, wherever it stands,
and emit each candidate record with the offset of the record that would follow it. Payloads can hold
the magic too, so a candidate proves nothing. From the file's start, pointer jumping over the
candidate-to-successor pairs finds what is reachable; only that is a record. Within its own range a
task follows the successors itself and emits where the chain leaves the range, so that the jumping
runs over ranges, in as many rounds as the logarithm of their number in the longest file. A second
scan starts in each range at its reachable entry and reads records only.

Files that begin with gzip's magic are read the same way, by members: every place with the magic is a
candidate, its successor is where its compressed data ends.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, scratch_path

MAGIC = b"WARC/1."
_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*(\d{1,18})[ \t]*(?=\r\n)", re.I)
_START = re.compile(rb"WARC/1\.[01]\r\n")
END = b"\r\n\r\n"
GZIP = b"\x1f\x8b\x08"


@dataclass(frozen=True)
class Params:
    split_bytes: int = 16 << 20  #: bytes of a task's range
    tasks: int = 20_000  #: tasks of a scan at most; a task then has several ranges
    header_bytes: int = 64 << 10  #: bytes first read on for a header; one that is longer is read on until its end


@lru_cache(maxsize=8)
def _filesystem(root: str):
    return pyarrow.fs.FileSystem.from_uri(root)


def _open(path: str):
    root, _, name = path.rpartition("/")
    fs, base = _filesystem(root)
    return fs.open_input_file(f"{base}/{name}")


def header(block: bytes | bytearray, at: int = 0) -> tuple[int, dict[str, str]] | None:
    """Of a record that starts at a place in a block: where its payload begins, and its fields; None if it isn't one."""
    if not _START.match(block, at):
        return None
    end = block.find(END, at)
    if end < 0:
        return None
    length = _LENGTH.search(block, at, end + 2)
    if not length:
        return None
    fields = {}
    for line in block[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields.setdefault(name.strip().lower().decode("latin-1"), value.strip().decode("utf-8", "replace"))
    return end + 4, fields


def _header_at(f, data: bytearray, base: int, at: int, step: int) -> tuple[int, dict[str, str]] | None:
    """header() at a place in data, that begins at base in the file; data grows by what has to be read on for it.

    Reading ends at the blank line, whatever the header's length, or at a line that is no field.
    """
    line = at
    while True:
        while (stop := data.find(b"\r\n", line)) >= 0:
            if stop == line:
                return header(data, at)
            if data.find(b":", line, stop) < 0 and (line > at or not _START.match(data, at)):
                return None
            line = stop + 2
        f.seek(base + len(data))
        more = f.read(step)
        if not more:
            return None
        data += more
        step *= 2


class Member:
    """A gzip member that starts at a place of a file, decompressed as far as it is asked for; data holds the file from base on."""

    STEP = 1 << 16

    def __init__(self, f, data: bytearray, base: int, at: int):
        self.f, self.data, self.base, self.at = f, data, base, at
        self.inflate, self.end = zlib.decompressobj(31), None

    def chunk(self) -> bytes | None:
        """What comes next; None at the member's end, which is then known, or where it is broken."""
        if self.inflate.eof:
            return None
        k = self.at - self.base
        if 0 <= k < len(self.data):
            raw = bytes(memoryview(self.data)[k : k + self.STEP])
        else:
            self.f.seek(self.at)
            raw = self.f.read(self.STEP)
        if not raw:
            return None
        self.at += len(raw)
        try:
            out = self.inflate.decompress(raw)
        except zlib.error:
            return None
        if self.inflate.eof:
            self.end = self.at - len(self.inflate.unused_data)
        return out

    def records(self):
        """(fields, payload) of the records in it, one after the other; ends at the first that is broken."""
        data = bytearray()
        found, line = None, 0
        while True:
            more = self.chunk()
            if more is None:
                return
            data += more
            while True:
                if not found:
                    at = data.find(END, line)
                    if at < 0:
                        line = max(0, len(data) - 3)
                        break
                    found = header(data)
                    if not found:
                        return
                length = int(found[1]["content-length"])
                if len(data) < found[0] + length + 4:
                    break
                yield found[1], bytes(memoryview(data)[found[0] : found[0] + length])
                del data[: found[0] + length + 4]
                found, line = None, 0


def _members(f, data: bytearray, base: int, start: int, most: int, size: int) -> list[tuple[int, int]]:
    """(offset, successor) of all that looks like a member holding a record, starting between two places."""
    out, k = [], data.find(GZIP, start - base)
    while 0 <= k < most - base:
        member = Member(f, data, base, base + k)
        head = b""
        while member.end is None and (more := member.chunk()) is not None:
            if len(head) < 10:
                head += more[:10]
                if len(head) >= 10 and not _START.match(head):
                    break
        if member.end is not None and member.end <= size and _START.match(head):
            out.append((base + k, member.end))
        k = data.find(GZIP, k + 1)
    return out


def _candidates(f, data: bytearray, base: int, most: int, size: int, p: Params) -> list[tuple[int, int]]:
    """(offset, successor) of all that looks like a record starting in the first `most` bytes of data."""
    out, k = [], data.find(MAGIC)
    while 0 <= k < most:
        found = _header_at(f, data, base, k, p.header_bytes) if k == 0 or data[k - 1 : k] == b"\n" else None
        if found:
            after = base + found[0] + int(found[1]["content-length"]) + 4
            if after <= size:
                out.append((base + k, after))
        k = data.find(MAGIC, k + 1)
    return out


def _exits(candidates: list[tuple[int, int]], end: int) -> list[tuple[int, int]]:
    """(offset, where its chain leaves the range); a chain that breaks off within the range has no exit: -1."""
    goes = {}
    for at, after in reversed(candidates):
        goes[at] = after if after >= end else goes.get(after, -1)
    return [(at, goes[at]) for at, _ in candidates]


def ranges(files: DataFrame, p: Params = Params()) -> DataFrame:
    """(file, size, start) for each range of each file; files is (path STRING, length BIGINT). Null or empty files have none."""
    some = files.select(F.col("path").cast("string").alias("file"), F.col("length").cast("long").alias("size")).where("file IS NOT NULL AND size > 0").distinct()
    return some.select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(p.split_bytes).cast("long"))).alias("start"))


def reachable_entries(spans: DataFrame, p: Params = Params()) -> Written:
    """A written table (file, entry): the first reachable record of each range that has one."""
    width = p.split_bytes

    def scan(it):
        for pdf in it:
            rows = []
            for file, size, start in pdf.itertuples(index=False):
                with _open(file) as f:
                    zipped = f.read(len(GZIP)) == GZIP
                    lead = 1 if start else 0
                    f.seek(start - lead)
                    data = bytearray(f.read(min(width, size - start) + lead + p.header_bytes))
                    end = min(start + width, size)
                    if zipped:
                        own = _members(f, data, start - lead, start, end, size)
                    else:
                        own = [c for c in _candidates(f, data, start - lead, end - start + lead, size, p) if c[0] >= start]
                rows += [(file, at, to) for at, to in _exits(own, end)]
            yield pd.DataFrame(rows, columns=["file", "at", "to"])

    jumps = Written(spans.mapInPandas(scan, "file string, at long, to long"), "jumps")
    reached = Written(jumps.df.where("at = 0").select("file", F.col("at").alias("entry")), "reached")
    while True:
        #: all that lies 2^k ranges on is added to what is reached; then the pointers double
        on = reached.df.join(jumps.df, (reached.df["file"] == jumps.df["file"]) & (F.col("entry") == F.col("at"))).where("to >= 0").select(reached.df["file"], F.col("to").alias("entry"))
        after = Written(reached.df.union(on).distinct(), "reached")
        grown = after.df.count() > reached.df.count()
        reached.drop()
        reached = after
        if not grown:
            jumps.drop()
            return reached
        first, then = jumps.df.alias("x"), jumps.df.alias("y")
        doubled = Written(first.join(then, F.expr("x.file = y.file AND x.to = y.at")).select("x.file", "x.at", "y.to"), "jumps")
        jumps.drop()
        jumps = doubled


def records(spark: SparkSession, files: DataFrame, p: Params = Params()) -> DataFrame:
    """The records: (file, offset, warc_type, target_uri, record_id, date, content_type, length, payload BINARY).

    files: (path, length), as spark.read.format('binaryFile') lists them. Fields a record lacks are
    null. A file that doesn't begin with a record has none; after a broken record the rest of the
    file isn't reachable, and isn't given. Empty files and null paths give nothing; a path listed
    twice is read once. Of gzip files offset is that of the record's member in the compressed file.

    The ranges are a small table, but each is work of its own: they are dealt out by their number,
    a task a range up to p.tasks tasks, or else a few small partitions would read all the files.
    """
    spans = Written(ranges(files, p), "spans").df
    tasks = max(1, min(spans.count(), p.tasks))
    spans = spans.repartition(tasks)
    reached = reachable_entries(spans, p)
    width = p.split_bytes
    entries = reached.df.groupBy("file", (F.floor(F.col("entry") / width) * width).cast("long").alias("start")).agg(F.min("entry").alias("entry"))
    own = spans.join(entries, ["file", "start"]).select("file", "size", "start", "entry").repartition(tasks)
    names = ["file", "offset", "warc_type", "target_uri", "record_id", "date", "content_type", "length", "payload"]

    def extract(it):
        for batch in it:
            for file, size, start, entry in zip(*(c.to_pylist() for c in batch.columns)):
                rows, held = [], 0
                with _open(file) as f:
                    zipped = f.read(len(GZIP)) == GZIP
                    at, end, base = entry, min(start + width, size), entry
                    f.seek(at)
                    data = bytearray(f.read(end - at))
                    while zipped and at is not None and at < end:
                        member = Member(f, data, base, at)
                        for fields, payload in member.records():
                            rows.append(_row(file, at, fields, payload))
                            held += len(payload)
                            if held > 8 << 20:
                                yield _batch(rows, names)
                                rows, held = [], 0
                        at = member.end
                    while not zipped and at < end:
                        found = _header_at(f, data, base, at - base, p.header_bytes)
                        if not found:
                            break
                        length = int(found[1]["content-length"])
                        body = base + found[0]
                        if body + length + 4 > size:
                            break
                        payload = bytes(memoryview(data)[body - base : body - base + length])
                        if len(payload) < length:
                            f.seek(body)
                            payload = f.read(length)
                        rows.append(_row(file, at, found[1], payload))
                        held += length
                        if held > 8 << 20:
                            yield _batch(rows, names)
                            rows, held = [], 0
                        at = body + length + 4
                if rows:
                    yield _batch(rows, names)

    return own.mapInArrow(extract, "file string, offset long, warc_type string, target_uri string, record_id string, date string, content_type string, length long, payload binary")


def _row(file: str, at: int, fields: dict[str, str], payload: bytes) -> tuple:
    return (file, at, *map(fields.get, ("warc-type", "warc-target-uri", "warc-record-id", "warc-date", "content-type")), len(payload), payload)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def record(kind: str, uri: str | None, payload: bytes, record_id: str, content_type: str) -> bytes:
    target = f"WARC-Target-URI: {uri}\r\n" if uri is not None else ""
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{record_id}>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\n{target}Content-Type: {content_type}\r\nContent-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload + END


def decoy(page_id: int) -> bytes:
    """A payload that quotes a whole record, and a second one cut short."""
    return b"quoted:\r\n" + record("response", f"http://decoy.example/{page_id}", b"<p>not a record</p>", f"decoy:{page_id}", "text/html") + b"WARC/1.1\r\nContent-Length: 7\r\n\r\nshort"


def write_files(pages: DataFrame, root: str) -> DataFrame:
    """Pages as WARC files, one a task, in the shared folder: a written table's rows (path, length, records).

    A file gets its name only when whole, so a task that is run again can't leave a broken one.
    Each page is a response, followed by a metadata record whose payload quotes records. A page
    without an id is left out; a null url is no target, a null html an empty payload.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.col("url").cast("string"), r"[\r\n]+", " ").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).where("page_id IS NOT NULL")

    def write(it):
        import uuid

        fs, base = pyarrow.fs.FileSystem.from_uri(root)
        fs.create_dir(base, recursive=True)
        name, size, n, out = f"{uuid.uuid4().hex}.warc", 0, 0, None
        for batch in it:
            for i, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    out = fs.open_output_stream(f"{base}/.{name}")
                    size += out.write(record("warcinfo", None, b"format: WARC file version 1.1\r\n", name, "application/warc-fields"))
                size += out.write(record("response", url, html.encode(), f"page:{i}", "text/html"))
                size += out.write(record("metadata", url, decoy(i), f"meta:{i}", "text/plain"))
                n += 1
        if out is not None:
            out.close()
            fs.move(f"{base}/.{name}", f"{base}/{name}")
            yield pa.record_batch([[f"{root}/{name}"], pa.array([size], pa.int64()), pa.array([n], pa.int64())], names=["path", "length", "records"])

    return own.mapInArrow(write, "path string, length long, records long")


def pages_through_warc(spark: SparkSession, pages: DataFrame, p: Params = Params()) -> DataFrame:
    """Pages written as WARC files and read back: (page_id, url, html, length), from the reachable responses only.

    A null html comes back empty, a null url null; line ends in a url come back as blanks, and blanks
    at its ends don't come back. Pages without an id are left out, rows that repeat come back each,
    pages of any length whole; an empty table gives no rows.
    """
    listed = Written(write_files(pages, scratch_path(spark, "warc")), "warc-files")
    kept = records(spark, listed.df.select("path", "length"), p).where("warc_type = 'response'")
    return kept.select(F.regexp_extract("record_id", r"page:(-?\d+)", 1).cast("long").alias("page_id"), F.col("target_uri").alias("url"), F.col("payload").cast("string").alias("html"), "length")


ORACLE = """
SELECT page_id, trim(url) AS url, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS length FROM pages WHERE page_id IS NOT NULL
"""
