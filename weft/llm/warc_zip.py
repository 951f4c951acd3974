"""WARC records in ZIP packages: a writer, and a reader that extracts nothing.

An archive is a ZIP file whose members are stored, not compressed: ``archive/data.warc.gz`` (one
gzip member for each WARC record) and ``indexes/index.cdxj`` (a line for each record: target,
offset and length). The reader parses the end-of-central-directory record, the ZIP64 record if
there is one, and the central directory; finds where each stored member begins; reads the index;
and reads each record by its byte range. Payloads that occur more than once are written once, as
the response with the smallest page id; the others are revisit records that refer to it.

Archives lie in the folder that driver and executors share. Each has a name of its own attempt, so
a task that is run again overwrites nothing, and the table of archives names those that count.

Defined results: a null html is an empty payload; a null url writes no target; of rows that repeat
the smallest page id of a payload all are responses; a payload whose page ids are all null has
responses only; a url comes back as it was, blanks at its ends included; an empty table writes no
archive and reads as no rows; an archive whose members are compressed or missing is an error.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import os
import struct
import uuid
import zipfile
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm._shared import cut, shared_dir, ship

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_DATE = "2000-01-01T00:00:00Z"  # fixed, so that reruns write equal bytes


def _local(path: str) -> str | None:
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if "://" not in path else None


def _open(path: str, mode: str) -> BinaryIO:
    """A file of the shared folder: a path that is mounted everywhere, or any store pyarrow knows."""
    at = _local(path)
    if at is not None:
        if mode == "wb":
            os.makedirs(os.path.dirname(at), exist_ok=True)
        return open(at, mode)
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    if mode == "wb":
        store.create_dir(os.path.dirname(inner), recursive=True)
        return store.open_output_stream(inner)
    return store.open_input_file(inner)


# -- ZIP ------------------------------------------------------------------------------------------


def members(f: BinaryIO) -> dict[str, tuple[int, int] | None]:
    """name -> (first byte, length) of the members of a ZIP file, from its directories; None for one
    that is compressed, which has no byte ranges."""
    f.seek(0, 2)
    size = f.tell()
    tail_at = max(0, size - 65_557)
    f.seek(tail_at)
    tail = f.read(size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and (len(tail) < end + 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP file, or cut short")
    n, length, start = struct.unpack_from("<HII", tail, end + 10)
    locator = tail_at + end - 20
    if locator >= 0:
        f.seek(locator)
        sign, _, at, _ = struct.unpack("<4sIQI", f.read(20))
        if sign == b"PK\x06\x07":
            f.seek(at)
            record = f.read(56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("bad ZIP64 end of central directory")
            n, length, start = struct.unpack_from("<QQQ", record, 32)
    f.seek(start)
    central = f.read(length)
    out, p = {}, 0
    for _ in range(n):
        if central[p : p + 4] != b"PK\x01\x02":
            raise ValueError("bad central directory")
        flags, method = struct.unpack_from("<HH", central, p + 8)
        packed, plain, name_n, extra_n, comment_n = struct.unpack_from("<IIHHH", central, p + 20)
        offset = struct.unpack_from("<I", central, p + 42)[0]
        name = central[p + 46 : p + 46 + name_n].decode("utf-8" if flags & 0x800 else "cp437")
        extra, q = central[p + 46 + name_n : p + 46 + name_n + extra_n], 0
        while q + 4 <= len(extra):
            kind, size_ = struct.unpack_from("<HH", extra, q)
            if kind == 1:  # 64-bit values, only of the fields that are full
                body, r = extra[q + 4 : q + 4 + size_], 0
                if plain == 0xFFFFFFFF:
                    plain, r = struct.unpack_from("<Q", body, r)[0], r + 8
                if packed == 0xFFFFFFFF:
                    packed, r = struct.unpack_from("<Q", body, r)[0], r + 8
                if offset == 0xFFFFFFFF:
                    offset = struct.unpack_from("<Q", body, r)[0]
            q += 4 + size_
        p += 46 + name_n + extra_n + comment_n
        if method:
            out[name] = None  # a compressed member has no byte ranges
            continue
        f.seek(offset)
        head = f.read(30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header of {name}")
        local_name, local_extra = struct.unpack_from("<HH", head, 26)
        out[name] = (offset + 30 + local_name + local_extra, packed)
    return out


def member(found: dict[str, tuple[int, int] | None], name: str) -> tuple[int, int]:
    if found.get(name) is None:
        raise ValueError(f"the archive has no member {name}" if name not in found else f"{name} is compressed: only stored members can be read by ranges")
    return found[name]


def read_range(f: BinaryIO, start: int, length: int) -> bytes:
    f.seek(start)
    data = f.read(length)
    if len(data) != length:
        raise ValueError("the archive is cut short")
    return data


# -- WARC -----------------------------------------------------------------------------------------


_ESCAPES = (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"))  # undone in the opposite order


def escaped(url: str) -> str:
    """A url as the value of a header line: no line ends, and blanks at its ends survive."""
    for plain, code in _ESCAPES:
        url = url.replace(plain, code)
    inner = url.strip(" \t")
    at = url.find(inner) if inner else len(url)
    blank = lambda s: "".join("%20" if c == " " else "%09" for c in s)
    return blank(url[:at]) + inner + blank(url[at + len(inner) :])


def unescaped(value: str) -> str:
    for plain, code in ((" ", "%20"), ("\t", "%09"), *reversed(_ESCAPES)):
        value = value.replace(code, plain)
    return value


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    head = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Date: " + _DATE.encode(), f"WARC-Record-ID: <urn:weft:page:{'' if page_id is None else page_id}>".encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + escaped(url).encode())
    head += [f"WARC-Payload-Digest: sha1:{digest}".encode(), f"X-Payload-Length: {size}".encode(), b"Content-Type: application/http; msgtype=response"]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if kind == "revisit":
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:weft:page:{refers_to}>".encode()]
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}".encode())
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip(" \t") for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def _page(uri: str | None) -> int | None:
    digits = (uri or "").strip("<>").rpartition(":")[2]
    return int(digits) if digits else None


# -- Spark ----------------------------------------------------------------------------------------


def marked(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, _payload, _sha1 and _first, the page whose response has this payload."""
    p = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("_payload")).withColumn("_sha1", F.sha1("_payload"))
    counted = p.filter(F.octet_length("_payload") >= least_bytes)
    # only a payload that occurs twice can be referred to: where these are few, no payload is shuffled
    first = cut(counted.groupBy(F.col("_sha1").alias("_digest")).agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n"))
    few = first.count() * 80 < 24e6
    return p.join(F.broadcast(first) if few else first, F.col("_sha1") == F.col("_digest"), "left").drop("_digest")


def write(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, most_bytes: int = 256 << 20) -> DataFrame:
    """Write the archives; returns the table of those that count: path, records."""
    spark = pages.sparkSession
    ship(spark)
    top = f"{folder or shared_dir(spark)}/warc-{uuid.uuid4().hex}"

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, part = TaskContext.get(), 0
        rows = (r for b in batches for r in zip(b["page_id"], b["url"], b["_payload"], b["_sha1"], b["_first"]))
        nxt = next(rows, None)
        while nxt is not None:
            path = f"{top}/{task.partitionId():06d}-{task.taskAttemptId()}-{part:04d}.zip"
            index, at = [], 0
            with _open(path, "wb") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
                with z.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as data:
                    while nxt is not None and at < most_bytes:
                        page, url, payload, sha1, first = nxt
                        page, first = (None if pd.isna(x) else int(x) for x in (page, first))
                        payload = bytes(payload)
                        kind = "response" if first is None or page == first else "revisit"
                        digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                        raw = gzip.compress(record(kind, page, url if isinstance(url, str) else None, payload, digest, len(payload), first), 6, mtime=0)
                        data.write(raw)
                        index.append(json.dumps({"url": url if isinstance(url, str) else None, "offset": at, "length": len(raw), "filename": DATA}))
                        at += len(raw)
                        nxt = next(rows, None)
                z.writestr(zipfile.ZipInfo(INDEX), "\n".join(index).encode())
            part += 1
            yield pd.DataFrame({"path": [path], "records": [len(index)]})

    return cut(marked(pages, least_bytes).select("page_id", "url", "_payload", "_sha1", "_first").mapInPandas(pack, "path string, records long"))


def records(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and payload of each record of one archive, by its index."""
    with _open(path, "rb") as f:
        at = members(f)
        for line in read_range(f, *member(at, INDEX)).decode().split("\n"):
            if not line.strip():
                continue
            entry = json.loads(line)
            start, length = member(at, entry["filename"])
            if entry["offset"] + entry["length"] > length:
                raise ValueError("the index points outside the archive")
            fields, block = parse(gzip.decompress(read_range(f, start + entry["offset"], entry["length"])))
            yield fields, block.partition(b"\r\n\r\n")[2]


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """page_id, url, payload (null for a revisit or if not asked for), payload_bytes,
    payload_digest, record_type, refers_to of every record."""
    ship(archives.sparkSession)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                rows, held = [], 0
                for fields, payload in records(path):
                    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{path}: a payload does not match its digest")
                    size = len(payload) if kind == "response" else int(fields["x-payload-length"])
                    url = fields.get("warc-target-uri")
                    url = url if url is None else unescaped(url)
                    rows.append((_page(fields["warc-record-id"]), url, payload if payloads and kind == "response" else None, size, digest, kind, _page(fields.get("warc-refers-to"))))
                    held += len(payload) if payloads else 0
                    if held > 16 << 20 or len(rows) >= 5000:
                        yield _frame(rows)
                        rows, held = [], 0
                if rows:
                    yield _frame(rows)

    n = max(1, archives.count())
    return archives.repartition(n).mapInPandas(unpack, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    return out.astype({"page_id": "Int64", "refers_to": "Int64"})


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    return read(write(pages, least_bytes=least_bytes), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
