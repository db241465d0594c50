import io
import struct
import zipfile
import zlib

import pyarrow as pa
import pytest

from tickloom.llm import warc_zip as wz

ROWS = [(5, "http://a/ b\r\nc", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (9, None, "<p>same</p>"), (3, "u", None), (4, "u", ""),
        (6, "é漢", "é漢\r\n\r\nWARC/1.1"), (None, "n", "<p>same</p>"), (None, "n", "alone without id"), (7, "u", "x" * 3_000_000), (8, "u", "twice"), (8, "v", "twice")]


def expected(rows, least=0):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        target = first.get(html or "")
        revisit = target is not None and i != target and len(raw) >= least
        out.append((i, len(raw), wz.base32_sha1(raw), "revisit" if revisit else "response", target if revisit else None))
    return sorted(out, key=str)


def rows_of(df):
    return sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()], key=str)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, refers_to int").repartition(3)


@pytest.mark.parametrize("least,package,ranges", [(0, wz.PACKAGE_BYTES, wz.RANGE_BYTES), (12, 300, 100)])
def test_round_trip(spark, least, package, ranges):
    packages = wz.write_packages(pages(spark, ROWS), min_bytes=least, package_bytes=package)
    got = wz.read_packages(packages, with_payload=True, range_bytes=ranges)
    assert rows_of(got) == expected(ROWS, least)
    held = {(r.page_id, bytes(r.payload).decode()) for r in got.filter("record_type = 'response'").collect()}
    assert held == {(i, html or "") for i, _, html in ROWS if (i, "response") in {(e[0], e[3]) for e in expected(ROWS, least)}
                    and (i is None or not any(e[0] == i and e[3] == "revisit" for e in expected(ROWS, least)))
                    and not (i is None and html == "<p>same</p>" and least <= 11)}
    if package > 300:  # an ordinary reader opens the package, too
        path = packages.first().path.removeprefix("file:")
        with zipfile.ZipFile(path) as z:
            assert z.testzip() is None and {wz.MEMBER, wz.INDEX} == set(z.namelist())


def test_empty_table_and_query(spark):
    assert wz.read_packages(wz.write_packages(pages(spark, ROWS).filter("false"))).count() == 0


def zip64(members: dict[str, bytes]) -> bytes:
    """A package whose directory holds all sizes and offsets in ZIP64 form."""
    out, central = bytearray(), bytearray()
    for name, data in members.items():
        at, n = len(out), name.encode()
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data))
        out += struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0, 0, 0, 0, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, len(n), len(extra)) + n + extra + data
        extra = struct.pack("<HHI", 0x5455, 4, 7) + struct.pack("<HHQQQ", 1, 24, len(data), len(data), at)
        central += struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0, 0, 0, 0, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, len(n), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + n + extra
    start = len(out)
    end = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, len(members), len(members), len(central), start)
    locator = struct.pack("<4sIQI", b"PK\6\7", 0, start + len(central), 1)
    tail = struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 5) + b"hello"
    return bytes(out) + bytes(central) + end + locator + tail


def test_zip64_directories_and_members_without_index(spark, tmp_path):
    def squeezed(data):
        deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
        return deflate.compress(data) + deflate.flush()

    records = b"".join(squeezed(wz.record(i, f"u{i}", "response", b"p" * i, i, wz.base32_sha1(b"p" * i), None)) for i in range(20))
    data = zip64({"datapackage.json": b"{}", "archive/one.warc.gz": records, "archive/two.warc.gz": records})
    members = {m["name"]: m for m in wz.zip_members(pa.BufferReader(data), len(data))}
    assert {n: data[m["offset"]:m["offset"] + m["size"]] for n, m in members.items()} == {
        "datapackage.json": b"{}", "archive/one.warc.gz": records, "archive/two.warc.gz": records}
    (tmp_path / "p.wacz").write_bytes(data)
    packages = spark.createDataFrame([(f"file:{tmp_path}/p.wacz",)], "path string")
    got = wz.read_packages(packages).collect()
    assert sorted(r.payload_bytes for r in got) == sorted([*range(20)] * 2) and {r.record_type for r in got} == {"response"}


def test_compressed_members_are_refused(spark, tmp_path):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/one.warc.gz", b"abc" * 100)
    (tmp_path / "q.wacz").write_bytes(held.getvalue())
    with pytest.raises(Exception, match="not stored"):
        wz.record_ranges(spark.createDataFrame([(f"file:{tmp_path}/q.wacz",)], "path string")).collect()
    with pytest.raises(ValueError):
        wz.zip_members(pa.BufferReader(b"no package at all"), 17)


def test_large_ids_beside_nulls(spark):
    big = 2 ** 53
    rows = [(big + 1, "same"), (big + 3, "same"), (big + 5, "other"), (None, "same")]
    pages = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: r.refers_to for r in wz.read_packages(wz.write_packages(pages)).collect()}
    assert got == {big + 1: None, big + 3: big + 1, big + 5: None, None: big + 1}
