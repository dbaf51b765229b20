"""WARC archives as seekable Zstandard bundles, with an index of record positions."""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import pick
from tidemark.sources.shared import as_table, fresh_path

# records of a frame, and frames of a bundle, before compression
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 128 << 20
LEVEL = 3
# frames that a task reads, and the most tasks
TASK_FRAMES, MOST_TASKS = 16, 8192
# fixed values of the seekable format: a skippable frame with the table, and its closing number
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6f0c1c1e-5f0e-5b7a-9d1a-7f4f9e0c5a11")


def record_id(page_id: int | None, sha1: bytes, row_no: int | None = None) -> str:
    """Of a page and its payload, so the same in every run; ``row_no`` tells further rows of a payload apart."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{_b32(sha1)}' + ('' if row_no is None else f'/{row_no}'))}>"


def _b32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, refers_to: int | None, revisit: bool,
           row_no: int | None = None) -> bytes:
    """One WARC/1.1 record. A revisit holds no payload; its length stays in a header."""
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, sha1, row_no)),
            ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{_b32(sha1)}"),
            ("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    if url:
        # control signs, blanks and non-ASCII letters are not allowed in a header's URI
        head.append(("WARC-Target-URI", urllib.parse.quote(url, safe="%/:=&?~#+!$,;'@()*[]-._")))
    if revisit:
        head += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", record_id(refers_to, sha1)), ("X-Refers-To-Page", str(refers_to))]
    body = b"" if revisit else payload
    head += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode()
    return b"WARC/1.1\r\n" + lines + b"\r\n" + body + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record at ``at``."""
    stop = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:stop].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("no WARC record here")
    head = dict(line.split(": ", 1) for line in lines)
    start, size = stop + 4, int(head["Content-Length"])
    return head, data[start:start + size], start + size + 4


class Bundle:
    """Writes one file: independent Zstandard frames of whole records, then the seek table as a skippable frame.

    The file is written under a name of its own and so never replaces that of another attempt.
    """

    def __init__(self, files: fs.FileSystem, path: str):
        self.path, self.out = path, files.open_output_stream(path, compression=None)
        self.frames: list[tuple[int, int]] = []
        self.held, self.size, self.total = [], 0, 0
        self.press = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, write_checksum=True)

    def add(self, rec: bytes) -> tuple[int, int, int]:
        """(frame, offset in the frame, length) of the record."""
        if self.held and self.size + len(rec) > FRAME_BYTES:
            self.flush()
        place = (len(self.frames), self.size, len(rec))
        self.held.append(rec)
        self.size += len(rec)
        self.total += len(rec)
        return place

    def flush(self) -> None:
        if self.held:
            frame = self.press.compress(b"".join(self.held))
            self.out.write(frame)
            self.frames.append((len(frame), self.size))
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)
        self.out.close()


def seek_table(file) -> list[tuple[int, int, int]]:
    """(place in the file, compressed size, plain size) of each frame, read from the footer."""
    size = file.size()
    file.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != _SEEKABLE:
        raise ValueError("no seek table")
    step = 12 if flags & 0x80 else 8
    file.seek(size - 9 - count * step)
    raw, at, out = file.read(count * step), 0, []
    for k in range(count):
        packed, plain = struct.unpack_from("<II", raw, k * step)
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(file, table: list[tuple[int, int, int]], frame: int) -> bytes:
    at, size, plain = table[frame]
    file.seek(at)
    return zstandard.ZstdDecompressor().decompress(file.read(size), max_output_size=plain)


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    """The folder's file system: local or mounted paths, and what pyarrow reaches by URI; Spark's names of S3 are S3."""
    for name in ("s3a://", "s3n://"):
        if folder.startswith(name):
            folder = "s3://" + folder[len(name):]
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _uri(folder: str) -> str:
    return "file://" + folder[5:] if folder.startswith("file:/") and not folder.startswith("file://") else folder


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """(page_id, url, payload binary, sha1 binary, refers_to, revisit, row_no): what each page is to be written as.

    Of equal payloads of at least ``least`` bytes the one with the smallest page_id is the response; further rows of
    that same id are responses too. Null ids come last. ``row_no`` is null for the first row of a payload, which gives the
    record that others refer to, and tells the further ones apart; for that the rows must come in the same order when they
    are read again, as those of files do. Copies are counted by digest in the map tasks, and only the
    digests of several pages are joined back, so a payload that very many pages share never meets in one task.
    """
    named = (pick(pages, page_id=f"{page_id} bigint", url=f"{url} string", html=f"{html} string")
             .select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
             .withColumn("sha1", F.unhex(F.sha1("payload"))).withColumn("row_no", F.monotonically_increasing_id()))
    # a null id is larger than any other here
    firsts = (named.groupBy("sha1").agg(F.min(F.struct(F.col("page_id").isNull().alias("z"), "page_id", "row_no")).alias("f"), F.count("*").alias("n"))
              .where("n > 1").select(F.col("sha1").alias("same"), F.col("f.page_id").alias("first"), F.col("f.row_no").alias("first_row")))
    joined = named.join(as_table(firsts, "warc-firsts"), F.col("sha1") == F.col("same"), "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.octet_length("payload") >= least)
    return joined.select("page_id", "url", "payload", "sha1", F.when(again, F.col("first")).alias("refers_to"), again.alias("revisit"),
                         F.when(F.col("row_no") != F.col("first_row"), F.col("row_no")).alias("row_no"))


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Write a record per row into bundles under ``folder``; returns the index, a written table.

    Index: (page_id, record_id, bundle, frame, offset, length), the offset within the plain frame. A task streams its
    rows into one bundle after the other and holds one frame at most. File names are fresh for each attempt, and only
    those of the attempts that Spark counts are in the index; files of lost attempts are left over, unread.
    Null html is an empty payload, null url no header; repeated rows and rows without an id are records of their own,
    each under its own record id; an empty table gives an empty index. ``folder`` must be one that all executors share.
    """
    rows = with_revisits(pages, page_id, url, html, least)
    folder = _uri(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)
        files.create_dir(root, recursive=True)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
        names = ["page_id", "record_id", "bundle", "frame", "offset", "length"]
        bundle = None
        for b in batches:
            index = []
            for page, link, payload, sha1, first, again, row_no in zip(*(c.to_pylist() for c in b.columns)):
                if bundle is None:
                    bundle = Bundle(files, f"{root}/{uuid.uuid4().hex}.warc.zst")
                place = bundle.add(record(page, link, payload, sha1, first, again, row_no))
                index.append((page, record_id(page, sha1, row_no), bundle.path[len(root) + 1:], *place))
                if bundle.total >= BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
            if index:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*index), kinds)], names=names)
        if bundle is not None:
            bundle.close()

    return as_table(rows.mapInArrow(run, "page_id bigint, record_id string, bundle string, frame int, offset bigint, length bigint"), "warc-index")


def read(index: DataFrame, folder: str) -> DataFrame:
    """(page_id, record_type, refers_to, payload_digest, payload_bytes, url, payload): the records the index points to.

    Rows are dealt by frame, so each frame is opened once and only frames that hold a wanted record are read; give a
    filtered index to look up single records. A task reads about ``TASK_FRAMES`` frames, more from ``MOST_TASKS`` tasks on.
    """
    folder = _uri(folder)
    # the number is set, as adaptive execution would merge tasks by the bytes of the index, a small part of what they read
    tasks = max(1, min(MOST_TASKS, -(-index.select("bundle", "frame").distinct().count() // TASK_FRAMES)))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = ["page_id", "record_type", "refers_to", "payload_digest", "payload_bytes", "url", "payload"]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)
        name, file, table, at, data = None, None, [], None, b""
        for b in batches:
            rows, size = [], 0
            for bundle, frame, offset in zip(*(c.to_pylist() for c in b.columns)):
                if bundle != name:
                    name, file, at = bundle, files.open_input_file(f"{root}/{bundle}"), None
                    table = seek_table(file)
                if frame != at:
                    at, data = frame, read_frame(file, table, frame)
                head, block, _ = parse(data, offset)
                page, first, link = head.get("X-Page-Id"), head.get("X-Refers-To-Page"), head.get("WARC-Target-URI")
                # a response's digest and length are taken from its payload, a revisit's from its headers
                fresh = head["WARC-Type"] == "response"
                rows.append((page and int(page), head["WARC-Type"], first and int(first),
                             _b32(hashlib.sha1(block).digest()) if fresh else head["WARC-Payload-Digest"].split(":")[1],
                             len(block) if fresh else int(head["X-Payload-Length"]), link and urllib.parse.unquote(link), block))
                size += len(block)
                if size > 8_000_000:
                    yield out(rows)
                    rows, size = [], 0
            if rows:
                yield out(rows)

    return (index.select("bundle", "frame", "offset").repartition(tasks, "bundle", "frame")
            .sortWithinPartitions("bundle", "frame", "offset").mapInArrow(
                run, "page_id bigint, record_type string, refers_to bigint, payload_digest string, "
                     "payload_bytes bigint, url string, payload binary"))


def fresh_folder(spark: SparkSession) -> str:
    """A folder for archives in the shared one."""
    return fresh_path(spark, "warc")
