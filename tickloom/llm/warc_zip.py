"""WARC records in ZIP packages: writing them, and reading ranges of records without extraction.

A package is a ZIP file with stored (uncompressed) members: ``archive/data.warc.gz``, whose records are gzip
members of their own, and ``indexes/index.cdxj``, a line of JSON per record with its offset and length. The
reader parses the end record, the ZIP64 records if there are any and the central directory, finds where the
stored bytes of each member begin, reads the index, and lets tasks read ranges of records from the package.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import fresh_folder, id_text, open_random, open_uri, shuffle_partitions, written

MEMBER, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PACKAGE_BYTES = 256 << 20  # a task closes a package beyond this size
RANGE_BYTES = 8 << 20  # records of about this many stored bytes are read at once
READ_BYTES = 1 << 20
DATE = "1970-01-01T00:00:00Z"


# ---- ZIP directories -----------------------------------------------------------------------------------

def zip_members(file, size: int) -> list[dict]:
    """name, method, size (stored bytes), offset (of the stored bytes) of all members, from the directories."""
    tail = min(size, 65557)
    end = file.read_at(tail, size - tail)
    at = end.rfind(b"PK\5\6")
    if at < 0:
        raise ValueError("no ZIP end record")
    count, length, start = struct.unpack("<HII", end[at + 10:at + 20])
    where = size - tail + at - 20
    if where >= 0 and 0xFFFF in (count,) or 0xFFFFFFFF in (length, start) or (where >= 0 and file.read_at(4, where) == b"PK\6\7"):
        locator = file.read_at(20, where)
        if locator[:4] != b"PK\6\7":
            raise ValueError("no ZIP64 locator")
        record = file.read_at(56, struct.unpack("<Q", locator[8:16])[0])
        if record[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end record")
        count, length, start = struct.unpack("<QQQ", record[32:56])
    directory, out, p = file.read_at(length, start), [], 0
    for _ in range(count):
        if directory[p:p + 4] != b"PK\1\2":
            raise ValueError("broken central directory")
        method, stored, whole = struct.unpack("<H", directory[p + 10:p + 12])[0], *struct.unpack("<II", directory[p + 20:p + 28])
        n, x, c = struct.unpack("<HHH", directory[p + 28:p + 34])
        offset, = struct.unpack("<I", directory[p + 42:p + 46])
        name = directory[p + 46:p + 46 + n].decode("utf-8", "replace")
        extra, q = directory[p + 46 + n:p + 46 + n + x], 0
        while q + 4 <= len(extra):
            kind, width = struct.unpack("<HH", extra[q:q + 4])
            if kind == 1:  # 64-bit values stand in for those that are all ones, in this order
                values = iter(struct.unpack(f"<{width // 8}Q", extra[q + 4:q + 4 + width // 8 * 8]))
                whole = next(values) if whole == 0xFFFFFFFF else whole
                stored = next(values) if stored == 0xFFFFFFFF else stored
                offset = next(values) if offset == 0xFFFFFFFF else offset
            q += 4 + width
        local = file.read_at(30, offset)
        if local[:4] != b"PK\3\4":
            raise ValueError(f"no local header of {name}")
        out.append({"name": name, "method": method, "size": stored, "offset": offset + 30 + sum(struct.unpack("<HH", local[26:30]))})
        p += 46 + n + x + c
    return out


# ---- records -------------------------------------------------------------------------------------------

def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _field(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(page_id, url: str | None, kind: str, payload: bytes, size: int, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit has the HTTP headers, with the length of the payload that it leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = [f"WARC/1.1\r\nWARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_field(url)}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(http) + len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """Fields of one record, its payload digested anew."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page = lambda key: (lambda v: int(v) if v.lstrip("-").isdigit() else None)(fields.get(key, "").strip("<>").rpartition(":")[2])
    kind = fields["warc-type"]
    stated = fields.get("warc-payload-digest", "").rpartition(":")[2]
    size = len(payload)
    if kind == "revisit":
        size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
    elif stated and base32_sha1(payload) != stated:
        raise ValueError(f"payload of {fields['warc-record-id']} does not have its digest")
    return {"page_id": page("warc-record-id"), "payload_bytes": size, "payload_digest": stated or base32_sha1(payload),
            "record_type": kind, "refers_to": page("warc-refers-to") if kind == "revisit" else None,
            "url": fields.get("warc-target-uri"), "payload": payload}


def records_in(file, begin: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of the gzip members between two offsets, read in pieces."""
    at, held, start = begin, b"", begin
    while at < end or held:
        inflate, out = zlib.decompressobj(31), []
        used = 0
        while not inflate.eof:
            if not held:
                if at >= end:
                    raise ValueError("a record ends before its gzip member")
                held = bytes(file.read_at(min(READ_BYTES, end - at), at))
                at += len(held)
            out.append(inflate.decompress(held))
            used += len(held) - len(inflate.unused_data)
            held = inflate.unused_data
        yield start, b"".join(out)
        start += used


# ---- Spark ---------------------------------------------------------------------------------------------

def with_roles(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html, digest, refers_to: who is a response (refers_to null) and who revisits whom.

    Of the pages with equal payloads of at least ``min_bytes`` bytes, those with the smallest page_id are
    responses. Only payloads that occur more than once take part in the join. A null payload is empty. A page
    without id is no target; it revisits if an equal page has an id, else it is a response.
    """
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    slim = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        html.alias("html"), F.sha1(html).alias("digest"))
    first = (slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
             .filter("n > 1").select("digest", "first"))
    first = written(first, "repeated")  # both sides of the join are dealt anew, so that a payload of many pages can be split
    revisits = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.length("html") >= min_bytes)
    return slim.join(first, "digest", "left").select(
        "page_id", "url", "html", "digest", F.when(revisits, F.col("first")).alias("refers_to"))


def write_packages(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, package_bytes: int = PACKAGE_BYTES,
                   id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per row of ``pages``; returns the table of packages (path, records).

    Every row gets its record, repeated rows too; an empty table gives no package. A task names its packages
    anew at each attempt, and only those in the returned table count.
    """
    folder = folder or fresh_folder(pages.sparkSession, "warc")

    def packages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {}

        def close() -> pd.DataFrame:
            state["member"].close()
            with state["zip"].open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as index:
                index.write("".join(state["lines"]).encode())
            state["zip"].close()
            state["out"].close()
            done = pd.DataFrame({"path": [state["path"]], "records": [len(state["lines"])]})
            state.clear()
            return done

        for batch in batches:
            for page_id, url, html, digest, refers in zip(*(batch[c] for c in ("page_id", "url", "html", "digest", "refers_to"))):
                if not state:
                    name = f"{folder}/pages-{uuid.uuid4().hex}.wacz"
                    fs, path = open_uri(name)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(path)
                    package = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                    state |= {"path": name, "out": out, "zip": package, "lines": [], "at": 0,
                              "member": package.open(zipfile.ZipInfo(MEMBER), "w", force_zip64=True)}
                revisit = not pd.isna(refers)
                page = "null" if pd.isna(page_id) else int(page_id)
                text = base64.b32encode(bytes.fromhex(digest)).decode()
                data = record(page, url, "revisit" if revisit else "response", b"" if revisit else html, len(html), text, int(refers) if revisit else None)
                deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = deflate.compress(data) + deflate.flush()
                state["member"].write(data)
                line = {"url": url, "offset": state["at"], "length": len(data), "filename": MEMBER, "digest": f"sha1:{text}"}
                state["lines"].append(f"{page} {DATE} {json.dumps(line)}\n")
                state["at"] += len(data)
                if state["at"] >= package_bytes:
                    yield close()
        if state:
            yield close()

    roles = with_roles(pages, min_bytes, id_col, url_col, html_col)
    rows = roles.withColumn("page_id", id_text(F.col("page_id"))).withColumn("refers_to", id_text(F.col("refers_to")))
    return written(rows.mapInPandas(packages, "path string, records long"), "packages")


def record_ranges(packages: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, begin, end, indexed): ranges of stored records of every package, from its directories and index.

    A WARC member without an index is one range. Members that are compressed once more are refused: their
    records cannot be read by offset.
    """
    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                out = []
                with open_random(path) as file:
                    members = {m["name"]: m for m in zip_members(file, file.size())}
                    offsets: dict[str, list[tuple[int, int]]] = {}
                    for name, m in members.items():
                        if m["method"] and name.startswith(("archive/", "indexes/")):
                            raise ValueError(f"{name} in {path} is not stored")
                        if name.startswith("indexes/") and name.endswith((".cdxj", ".cdx")):
                            for line in bytes(file.read_at(m["size"], m["offset"])).decode().splitlines():
                                entry = json.loads(line[line.index("{"):])
                                offsets.setdefault(entry["filename"], []).append((int(entry["offset"]), int(entry["length"])))
                    for name, m in members.items():
                        if not name.startswith("archive/"):
                            continue
                        begin = end = None
                        for at, n in sorted(offsets.get(name, [(0, m["size"])])):
                            if begin is not None and (at != end or end - begin >= range_bytes):
                                out.append((path, m["offset"] + begin, m["offset"] + end, name in offsets))
                                begin = None
                            begin = at if begin is None else begin
                            end = at + n
                        if begin is not None and end > begin:
                            out.append((path, m["offset"] + begin, m["offset"] + end, name in offsets))
                yield pd.DataFrame(out, columns=["path", "begin", "end", "indexed"])

    n = shuffle_partitions(packages.sparkSession)
    return packages.select("path").repartition(n, "path").mapInPandas(ranges, "path string, begin long, end long, indexed boolean")


def read_packages(packages: DataFrame, with_payload: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, url, path, offset."""
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "path", "offset"]
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, path string, offset long"
    if with_payload:
        columns, schema = [*columns, "payload"], schema + ", payload binary"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, begin, end in zip(batch["path"], batch["begin"], batch["end"]):
                rows, size = [], 0
                with open_random(path) as file:
                    for offset, data in records_in(file, begin, end):
                        rows.append(parsed(data) | {"path": path, "offset": offset})
                        size += len(data)
                        if not with_payload:
                            rows[-1].pop("payload")
                        if len(rows) >= 10_000 or with_payload and size > RANGE_BYTES:
                            yield _frame(rows, columns)
                            rows, size = [], 0
                if rows:
                    yield _frame(rows, columns)

    def _frame(rows: list[dict], columns: list[str]) -> pd.DataFrame:
        exact = {c: pd.array([r[c] for r in rows], "Int64") for c in ("page_id", "refers_to")}
        return pd.DataFrame({c: exact[c] if c in exact else [r[c] for r in rows] for c in columns})

    n = shuffle_partitions(packages.sparkSession)
    return record_ranges(packages, range_bytes).repartition(n, "path", "begin").mapInPandas(read, schema)
