"""Round trips, against digests of the pages themselves; foreign ZIP files for the reader."""

import base64
import hashlib
import io
import zipfile

import pytest

from postlabel.llm import warc_zip
from postlabel.llm.warc_zip import INDEX_MEMBER, PackageReader, op5_warc_zip, read_packages, write_packages


def expected(rows):
    first = {}
    for page, html in rows:
        payload = (html or "").encode()
        first[payload] = min(first.get(payload, page), page)
    out = []
    for page, html in rows:
        payload = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        revisit = first[payload] < page
        out.append((page, len(payload), digest, "revisit" if revisit else "response", first[payload] if revisit else None))
    return sorted(out, key=str)


def test_whole_table(spark, sf):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in op5_warc_zip(spark, sf).collect()]
    assert sorted(got, key=str) == expected(rows)


def test_nulls_copies_odd_addresses_and_small_packages(spark, tmp_path):
    rows = [(5, "same"), (3, "same"), (9, None), (8, ""), (4, "é\r\n\r\nx"), (7, "same"), (7, "other"), (3, "same"), (1, "\0" * 70000)]
    data = [(p, f"http://x/ü \n{p}" if p != 9 else None, h, "extra") for p, h in rows]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, page string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in op5_warc_zip(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == expected(rows)
    packages = write_packages(pages, str(tmp_path / "small"), 100)
    assert packages.count() > 1
    back = {(r.page, bytes(r.payload)) for r in read_packages(packages).collect() if r.record_type == "response"}
    assert back == {(p, (h or "").encode()) for p, h in rows if (p, h) not in {(5, "same"), (7, "same"), (9, None)}}


def test_null_id_and_no_pages(spark):
    schema = "page_id long, url string, html string"
    packages = write_packages(spark.createDataFrame([(None, "u", "a"), (2, "u", "a")], schema))
    kinds = {r.record_type: r.refers_to for r in read_packages(packages).collect()}
    assert kinds == {"response": None, "revisit": 2}
    assert read_packages(write_packages(spark.createDataFrame([], schema))).count() == 0


def test_reader_on_other_packages(tmp_path):
    data = warc_zip.record(1, "http://a", b"hello", None)
    index = b'urn:page:1 {"filename": "archive/x.warc.gz", "offset": 3, "length": %d}\n' % len(data)
    path = tmp_path / "x.wacz"
    with zipfile.ZipFile(path, "w") as out:
        out.comment = b"PK\x05\x06 in a comment " + b"c" * 300
        out.writestr("notes.txt", b"n" * 1000, zipfile.ZIP_DEFLATED)
        with out.open("archive/x.warc.gz", "w", force_zip64=True) as member:
            member.write(b"???" + data)
        out.writestr(INDEX_MEMBER, index)
    package = PackageReader(str(path))
    (place,) = package.records()
    assert warc_zip.parse_record(package._range(*place))[1] == b"hello"
    with pytest.raises(ValueError, match="not stored"):
        package.start(package.members["notes.txt"])
    (tmp_path / "bad").write_bytes(b"nothing here")
    with pytest.raises(ValueError, match="not a ZIP"):
        PackageReader(str(tmp_path / "bad"))


def test_zip64_end_record(tmp_path, monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)  # writes the ZIP64 records for two members
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as out:
        out.writestr("a", b"1")
        out.writestr("b", b"22")
    assert b"PK\x06\x06" in buffer.getvalue()
    (tmp_path / "z").write_bytes(buffer.getvalue())
    package = PackageReader(str(tmp_path / "z"))
    assert {n: package._range(package.start(m), m.size) for n, m in package.members.items()} == {"a": b"1", "b": b"22"}
