import gzip
import hashlib
import io
import zipfile
from collections import defaultdict

import pytest

from fleetlens.llm import warc
from fleetlens.session import shared_dir

PAGES = "page_id long, url string, html string"
LONG = "<p>" + "long enough to be revisited " * 10


@pytest.fixture(scope="module")
def odd_pages(spark):
    return spark.createDataFrame([
        (5, "http://a/ b\r\nInjected: x", LONG), (3, "http://b/ü?x=1", LONG), (9, None, LONG), (3, "http://again", LONG), (None, "http://n", LONG),
        (1, "u", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"), (7, "u", "é" * 50), (8, "u", "é" * 50), (10, "u", "x" * 99), (11, "u", "x" * 99),
        (12, "u", "a\r\n\r\nb\x00\n" * 30), (13, "u", "日本" * 200_000), (None, "u", "only null id " * 20),
    ], PAGES)


def expected(rows):
    first = {}
    for page_id, _, html in rows:
        raw = (html or "").encode()
        if page_id is not None and len(raw) >= 100:
            first[raw] = min(first.get(raw, page_id), page_id)
    out = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        least = first.get(raw)
        revisit = least is not None and page_id != least
        out.append((page_id, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", least if revisit else None))
    return sorted(out, key=str)


def told(records):
    number = lambda v: None if v is None else int(v)
    return sorted(((number(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], number(r["refers_to"]))
                   for r in records.collect()), key=str)


def test_round_trip(odd_pages, spark):
    assert told(warc.archive_round_trip(odd_pages)) == expected(odd_pages.collect())
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    back = warc.archive_round_trip(pages)
    assert told(back) == expected(pages.collect())
    texts = {p["page_id"]: p["html"] for p in pages.collect()}
    responses = back.where("record_type = 'response'").collect()
    assert all(bytes(r["payload"]).decode() == texts[int(r["page_id"])] for r in responses)


def test_whole_packages_read_the_same(odd_pages, spark):
    path = shared_dir(spark, "packages")
    warc.write_packages(odd_pages, path, package_bytes=300)
    assert told(warc.read_whole(spark, path)) == told(warc.read_packages(spark, path)) == expected(odd_pages.collect())
    files = spark.read.format("binaryFile").load(path).select("path", "content").collect()
    assert len(files) > 3
    for f in files:  # any ZIP reader takes them
        with zipfile.ZipFile(io.BytesIO(bytes(f["content"]))) as package:
            assert package.testzip() is None and "archive/data.warc.gz" in package.namelist()
            assert gzip.decompress(package.read("archive/data.warc.gz")).startswith(b"WARC/1.1\r\n")


def test_only_ranges_are_read(spark, odd_pages):
    path = shared_dir(spark, "packages")
    warc.write_packages(odd_pages, path)
    for f in spark.read.format("binaryFile").load(path).collect():
        raw, touched = bytes(f["content"]), 0

        def read(start, size):
            nonlocal touched
            touched += size
            return raw[start:start + size]

        found = list(warc.places(read, len(raw)))
        assert touched < 70_000 + 400 * len(found)
        covered = sorted((s, n) for _, s, n in found)
        assert all(a + n == b for (a, n), (b, _) in zip(covered, covered[1:]))


def packages(zip64=False, index=True, comment=b"", monkeypatch=None):
    if zip64:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    package = warc.Package()
    for i in range(40):
        body = f"page {i} ".encode() * (i + 1)
        record = warc.record_bytes(i, f"http://x/{i}", body, len(body), hashlib.sha256(body).hexdigest(), None, "2024-01-01T00:00:00Z")
        package.add(record, f"http://x/{i}", i, "2024-01-01T00:00:00Z")
    raw = package.bytes(comment)
    if not index:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            z.writestr("archive/data.warc.gz", package.archive.getvalue())
        raw = out.getvalue()
    return raw


@pytest.mark.parametrize("zip64, index, comment", [
    (False, True, b""), (True, True, b""), (True, True, b"a comment PK\5\6 with a signature in it"), (False, True, b"\n"), (True, False, b""), (False, False, b"")])
def test_directories(zip64, index, comment, monkeypatch):
    raw = packages(zip64, index, comment, monkeypatch)
    assert (warc.LOCATOR64 in raw) == zip64
    read = lambda start, size: raw[start:start + size]
    entries = warc.directory(read, len(raw))
    known = raw if b"signature" not in comment else packages(zip64, index, b"", monkeypatch)  # zipfile itself stumbles there
    with zipfile.ZipFile(io.BytesIO(known)) as package:
        assert [(e.name, e.size, e.header) for e in entries] == [(i.filename, i.compress_size, i.header_offset) for i in package.infolist()]
    records = [warc.parse_record(read(s, n)) for _, s, n in warc.places(read, len(raw))]
    assert sorted(int(r["page_id"]) for r in records) == list(range(40))
    assert all(r["payload"] == f"page {r['page_id']} ".encode() * (int(r["page_id"]) + 1) for r in records)


def test_damage_is_told():
    raw = packages()
    read = lambda start, size: cut[start:start + size]
    for cut in (raw[:-30], b"", b"no zip at all"):
        with pytest.raises(ValueError):
            warc.directory(read, len(cut))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/data.warc.gz", b"x" * 1000)
    cut = out.getvalue()
    with pytest.raises(ValueError, match="compressed"):
        list(warc.places(read, len(cut)))


def test_empty_table(spark):
    assert told(warc.archive_round_trip(spark.createDataFrame([], PAGES + ", payload string, digest int"))) == []
