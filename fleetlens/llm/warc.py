"""Web archives in ZIP packages: writing them, and reading records by byte ranges.

A package is a ZIP file whose members are stored, not compressed: ``archive/data.warc.gz`` with
one gzip member per record, and ``indexes/index.cdxj`` with each record's place in it. A reader
finds the members through the central directory and then reads single records by range.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import urllib.parse
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import as_arrow, giving_back, quoted
from fleetlens.session import shared_dir

#: Payloads below this many bytes are stored again each time.
REVISIT_BYTES = 100
#: Compressed bytes after which a package is closed.
PACKAGE_BYTES = 8_000_000
#: Bytes of a package whose records one task of the reader takes.
RANGE_BYTES = 8_000_000

# Fixed values of the formats: WARC 1.1 and the ZIP application note.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"

LOCATED = "path string, member string, start long, length long"
RECORDS = ("page_id string, url string, record_type string, refers_to string, payload binary, "
           "payload_bytes long, payload_digest string, date string")


# Writing

def record_bytes(page_id: object, url: str | None, payload: bytes | None, size: int, digest: str,
                 refers_to: object, date: str) -> bytes:
    """One WARC record. A revisit has the HTTP headers only; its payload is with ``refers_to``."""
    target = urllib.parse.quote(url or f"urn:page:{page_id}", safe="%/:=&?~#+!$,;'@()*[]")
    revisit = payload is None
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n").encode()
    block = http if revisit else http + payload
    lines = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>",
             f"WARC-Target-URI: {target}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


class Package:
    """A package under construction."""

    def __init__(self) -> None:
        self.archive, self.index = io.BytesIO(), []

    def add(self, record: bytes, url: str | None, page_id: object, date: str) -> None:
        packed = gzip.compress(record, 4, mtime=0)
        where = {"url": url or "", "record": f"urn:page:{page_id}", "filename": "data.warc.gz",
                 "offset": str(self.archive.tell()), "length": str(len(packed))}
        key = " ".join((url or "").split()).replace(" ", "%20") or "-"
        self.index.append(f"{key} {''.join(c for c in date if c.isdigit())} {json.dumps(where)}\n")
        self.archive.write(packed)

    def bytes(self, comment: bytes = b"") -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as package:
            for name, content in (("archive/data.warc.gz", self.archive.getvalue()),
                                  ("indexes/index.cdxj", "".join(sorted(self.index)).encode()),
                                  ("datapackage.json", b'{"profile": "data-package", "wacz_version": "1.1.1"}')):
                package.writestr(zipfile.ZipInfo(name), content)
            package.comment = comment
        return out.getvalue()


def mark_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Each page's payload, digest and, where an equal payload of at least ``least`` bytes has a
    smaller page id, that id as ``refers_to`` with the payload left out.

    The first id per digest is an aggregate with a partial step, and only digests that occur
    more than once are joined back, so a payload of a third of all pages is split by the
    skew handling of the join. Rows that share the smallest id are all responses; a null id
    never is one's response, and revisits it if another has an id. Null html is an empty payload.
    """
    payload = F.coalesce(quoted("html").cast("string"), F.lit("")).cast("binary")
    own = pages.select(
        quoted("page_id").alias("page_id"), quoted("url").cast("string").alias("url"), payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    shared = own.where(F.col("size") >= least).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n")
    met = own.join(shared, "digest", "left")
    later = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return met.select("page_id", "url", "digest", "size", F.when(~later, F.col("payload")).alias("payload"),
                      F.when(later, F.col("first")).alias("refers_to"))


def write_packages(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z",
                   package_bytes: int = PACKAGE_BYTES) -> None:
    """Write ``pages (page_id, url, html)`` as ZIP packages of WARC records below ``path``.

    Every task streams its rows into packages that close at ``package_bytes``, so nothing is
    gathered by key. Spark's text writer puts each package into a file of its own on any file
    system, with its commit protocol; the line end it adds is the package's ZIP comment. An empty
    table writes no package.
    """
    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package = Package()
        for batch in batches:
            for row in batch.to_pylist():
                record = record_bytes(row["page_id"], row["url"], row["payload"], row["size"], row["digest"],
                                      row["refers_to"], date)
                package.add(record, row["url"], row["page_id"], date)
                if package.archive.tell() >= package_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([package.bytes(b"\n")[:-1]], pa.binary())], ["package"])
                    package = Package()
        if package.index:
            yield pa.RecordBatch.from_arrays([pa.array([package.bytes(b"\n")[:-1]], pa.binary())], ["package"])

    packages = mark_revisits(pages).mapInArrow(giving_back(build), "package binary")
    packages.select(F.col("package").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


# Reading

class Entry(NamedTuple):
    name: str
    method: int
    size: int
    header: int


def directory(read: Callable[[int, int], bytes], length: int) -> list[Entry]:
    """The central directory of a ZIP file of ``length`` bytes; ``read(start, size)`` reads a range.

    Sizes and offsets that are all ones stand in a ZIP64 field or in the ZIP64 end record.
    """
    tail_start = max(0, length - 22 - 0xFFFF)
    tail = read(tail_start, length - tail_start)
    at = len(tail)
    while True:
        at = tail.rfind(END, 0, at + 3 if at < len(tail) else at)
        if at < 0:
            raise ValueError("no end of central directory: not a ZIP file, or cut off")
        if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
    count, size, start = struct.unpack_from("<HII", tail, at + 10)
    locator = tail_start + at - 20
    if locator >= 0 and read(locator, 4) == LOCATOR64:
        end64 = struct.unpack("<Q", read(locator + 8, 8))[0]
        record = read(end64, 56)
        if record[:4] != END64:
            raise ValueError("the ZIP64 end record is not where its locator says")
        count, size, start = struct.unpack_from("<QQQ", record, 32)
    raw, entries, at = read(start, size), [], 0
    for _ in range(count):
        if raw[at:at + 4] != ENTRY:
            raise ValueError("the central directory is damaged")
        method, = struct.unpack_from("<H", raw, at + 10)
        packed, plain, name_len, extra_len, comment_len = struct.unpack_from("<IIHHH", raw, at + 20)
        header, = struct.unpack_from("<I", raw, at + 42)
        name = raw[at + 46:at + 46 + name_len].decode("utf-8", "replace")
        extra = raw[at + 46 + name_len:at + 46 + name_len + extra_len]
        while len(extra) >= 4:
            kind, size_ = struct.unpack_from("<HH", extra)
            if kind == 1:  # ZIP64: the fields that did not fit, in this order
                wide = iter(struct.unpack_from(f"<{size_ // 8}Q", extra, 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            extra = extra[4 + size_:]
        entries.append(Entry(name, method, packed, header))
        at += 46 + name_len + extra_len + comment_len
    return entries


def content_start(read: Callable[[int, int], bytes], entry: Entry) -> int:
    """Where a member's bytes begin; the local header has lengths of its own."""
    if entry.method != zipfile.ZIP_STORED:
        raise ValueError(f"{entry.name} is compressed inside the package; ranges of it cannot be read")
    header = read(entry.header, 30)
    if header[:4] != LOCAL:
        raise ValueError(f"{entry.name}: no local header")
    return entry.header + 30 + sum(struct.unpack_from("<HH", header, 26))


def places(read: Callable[[int, int], bytes], length: int) -> Iterator[tuple[str, int, int]]:
    """``(member, start, length)`` of every record in a package, by the index or, without one, by a scan."""
    entries = directory(read, length)
    starts = {e.name.rsplit("/", 1)[-1]: (e, content_start(read, e)) for e in entries if e.name.startswith("archive/")}
    indexes = [e for e in entries if e.name.startswith("indexes/") and ".cdx" in e.name]
    for index in indexes:
        raw = read(content_start(read, index), index.size)
        for line in (gzip.decompress(raw) if index.name.endswith(".gz") else raw).decode().splitlines():
            where = json.loads(line[line.index("{"):])
            member, start = starts[where["filename"]]
            yield member.name, start + int(where["offset"]), int(where["length"])
    if not indexes:
        for member, start in starts.values():
            at, end = start, start + member.size
            while at < end:
                size = _packed_length(read, at, end)
                yield member.name, at, size
                at += size


def _packed_length(read: Callable[[int, int], bytes], at: int, end: int) -> int:
    """Bytes of the gzip member that begins at ``at``."""
    unpack, size = zlib.decompressobj(31), 0
    while not unpack.eof:
        part = read(at + size, min(1 << 16, end - at - size))
        if not part:
            raise ValueError("a record is cut off")
        unpack.decompress(part)
        size += len(part) - len(unpack.unused_data)
    return size


def parse_record(packed: bytes) -> dict:
    """A record's fields. Payload size and digest of a revisit are the stored ones, of a response the real ones."""
    raw = gzip.decompress(packed)
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    http, _, payload = block[:int(fields["Content-Length"])].partition(b"\r\n\r\n")
    revisit = fields["WARC-Type"] == "revisit"
    stated = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    digest = stated if revisit else hashlib.sha256(payload).hexdigest()
    if digest != stated:
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not have its digest")
    length = next(int(line.split(b":", 1)[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    return {
        "page_id": _page(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"],
        "refers_to": _page(fields.get("WARC-Refers-To")), "payload": None if revisit else payload,
        "payload_bytes": length if revisit else len(payload), "payload_digest": digest, "date": fields["WARC-Date"]}


def _page(record_id: str | None) -> str | None:
    page = record_id and record_id.removeprefix("<urn:page:").removesuffix(">")
    return None if page == "None" else page


def _opened(path: str) -> BinaryIO:
    parts = urllib.parse.urlsplit(path)
    if parts.scheme in ("", "file"):
        return open(urllib.parse.unquote(parts.path), "rb")
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def _ranges(file: BinaryIO) -> Callable[[int, int], bytes]:
    def read(start: int, size: int) -> bytes:
        file.seek(start)
        return file.read(size)

    return read


def locate(spark: SparkSession, path: str) -> DataFrame:
    """``(path, member, start, length)`` of every record in the packages below ``path``.

    Spark lists the files; a task reads a package's directory and index, nothing else of it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with _opened(row["path"]) as file:
                    found = [{"path": row["path"], "member": m, "start": s, "length": n}
                             for m, s, n in places(_ranges(file), row["length"])]
                yield pa.RecordBatch.from_pylist(found, as_arrow(LOCATED))

    return files.mapInArrow(giving_back(look), LOCATED)


def read_records(located: DataFrame) -> DataFrame:
    """Read located records by range, columns ``RECORDS``. Tasks take neighbouring records of a package."""
    near = located.repartition("path", F.floor(F.col("start") / RANGE_BYTES)).sortWithinPartitions("path", "start")

    def fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, path, file = as_arrow(RECORDS), None, None
        for batch in batches:
            found, held = [], 0
            for row in batch.to_pylist():
                if row["path"] != path:
                    if file is not None:
                        file.close()
                    path, file = row["path"], _opened(row["path"])
                found.append(parse_record(_ranges(file)(row["start"], row["length"])))
                held += len(found[-1]["payload"] or b"")
                if held > 16_000_000:
                    yield pa.RecordBatch.from_pylist(found, schema)
                    found, held = [], 0
            if found:
                yield pa.RecordBatch.from_pylist(found, schema)
        if file is not None:
            file.close()

    return near.mapInArrow(giving_back(fetch), RECORDS)


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """The same records for a store that only Spark can read: packages come whole through ``binaryFile``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")

    def fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                raw = content.as_py()
                read = _ranges(io.BytesIO(raw))
                found = [parse_record(read(s, n)) for _, s, n in places(read, len(raw))]
                yield pa.RecordBatch.from_pylist(found, as_arrow(RECORDS))

    return files.mapInArrow(giving_back(fetch), RECORDS)


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """All records of the packages below ``path``, by ranges where tasks can open the store themselves."""
    if urllib.parse.urlsplit(path).scheme in ("", "file", "s3", "gs"):
        return read_records(locate(spark, path))
    return read_whole(spark, path)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to packages in the shared folder and read them back."""
    path = shared_dir(pages.sparkSession, "packages")
    write_packages(pages, path)
    return read_packages(pages.sparkSession, path)
