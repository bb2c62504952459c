r"""WARC archives with a salvage reader (operator 5).

Writer: one record per page, each a gzip member of its own. Of pages with
equal payloads of at least ``min_bytes`` the one with the smallest id is a
``response`` and the others are ``revisit`` records that refer to it. Spark's
text writer stores the members: a member ends with its length as four
little-endian bytes, whose last byte is zero below 16 MiB, so the row is the
member without that byte and the line separator is the zero byte. (A longer
record is followed by an empty member, which ends in zero as well.) Files are
named by Spark; readers know the format by its content.

Reader: a file is read member by member (gzip) or record by record (plain).
A member fails its check if it does not decompress to its end with a right
CRC; a record fails if it is not whole: version line, headers (folded lines
too), Content-Length, end marks, and a payload that has the SHA-1 digest it
claims (base 32 or hexadecimal, in any case). A member's content is searched in
the same way, so many records in one member are read, and what a broken member
gives before its error is searched too. After a failure the reader searches for
the next place where a valid member or version line begins, goes on there, and
logs the bytes between as a quarantined gap; a gap inside a member's content is
logged by its place there. Decompression is fed in blocks, so a file costs time
linear in its size.

Scale: payloads are compared by SHA-1 in one aggregate (combined before its
shuffle) and joined by digest with frequent payloads dealt out
(``joins.spread_join``), so copies of an empty page are spread. Members are
bundled into rows of about ``BUNDLE`` bytes and a file holds ``BUNDLES`` rows
(a long member counts for as many as it is long), so files stay below about
``BUNDLE * BUNDLES`` bytes and one member, which bounds a reading task's memory.

Defined cases: null payloads are empty; null urls are left out; null page ids
count as larger than any id (pages with equal payloads and no id at all are
all responses). Rows that repeat the smallest id are all responses. An empty
table gives an empty archive. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from abundance.llm.common import SLICE
from abundance.operators.joins import spread_join
from abundance.session import cut_lineage

BUNDLE = 4 << 20
BUNDLES = 16
BLOCK = 1 << 16
VERSION = re.compile(rb"WARC/1\.[01]\r\n")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_urn(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record_bytes(page_id, url, payload: bytes, refers_to, date: str) -> bytes:
    """One record: a response with its payload, or a revisit without."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_urn(page_id)), ("WARC-Date", date),
            ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", "sha1:" + payload_digest(payload)),
            ("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("WARC-Refers-To", record_urn(refers_to)), ("X-Refers-To-Page", str(refers_to))]
    head.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html",
                   min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> None:
    """Write the pages as archives under ``folder`` (any path Spark can write)."""
    p = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"),
                     F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload")).withColumn("sha1", F.sha1("payload"))
    first = cut_lineage(p.where(F.length("payload") >= min_bytes).groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count("*").alias("__n")))
    found = spread_join(p, first.drop("__n"), "sha1", "left", counts=first.drop("first_id"))
    dealt = found.select("page_id", "url", "payload", F.when(
        F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))

    def members(batches):
        import pyarrow as pa

        def rows(bundle):
            """The bundle without its last byte, and a filler row for every
            further ``BUNDLE`` bytes."""
            if bundle[-1]:
                bundle += gzip_member(b"")
            return [bytes(bundle[:-1])] + [gzip_member(b"")[:-1]] * (len(bundle) // BUNDLE - (len(bundle) % BUNDLE == 0))

        bundle = bytearray()
        for b in batches:
            for k in range(0, b.num_rows, SLICE):
                out = []
                for row in zip(*(b.column(i).slice(k, SLICE).to_pylist() for i in range(4))):
                    m = gzip_member(record_bytes(*row, date))
                    if bundle and len(bundle) + len(m) > BUNDLE:
                        out += rows(bundle)
                        bundle = bytearray()
                    bundle += m
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
        if bundle:
            yield pa.RecordBatch.from_arrays([pa.array(rows(bundle), pa.binary())], names=["value"])

    (dealt.mapInArrow(members, "value binary").select(F.col("value").cast("string")).write
     .option("lineSep", "\0").option("maxRecordsPerFile", BUNDLES).text(folder))


def parse_record(data, start: int = 0, whole: bool = True) -> tuple[dict, bytes, int] | None:
    """(headers, payload, end) of the record that begins at ``start``, or None
    if a check fails. ``whole``: nothing may follow it."""
    v = VERSION.match(data, start)
    stop = data.find(b"\r\n\r\n", start) if v else -1
    if stop < 0:
        return None
    headers, name = {}, None
    for line in data[v.end():stop].split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and name is not None:      # a folded line goes on with the header before
            headers[name] = f"{headers[name]} {line.decode('utf-8', 'replace').strip()}".strip()
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        name = name.decode("utf-8", "replace").strip().lower()
        headers[name] = value.decode("utf-8", "replace").strip()
    size = headers.get("content-length", "")
    if not size.isascii() or not size.isdigit() or "warc-type" not in headers:
        return None
    end = stop + 4 + int(size) + 4
    if end > len(data) or data[end - 4:end] != b"\r\n\r\n" or whole and end != len(data):
        return None
    block = data[stop + 4:end - 4]
    payload = block.partition(b"\r\n\r\n")[2] if "application/http" in headers.get("content-type", "") else block
    kind, _, claim = headers.get("warc-payload-digest", "").partition(":")
    if headers["warc-type"] != "revisit" and kind.strip().lower() == "sha1" and claim.strip().upper() not in (
            payload_digest(payload), hashlib.sha1(payload).hexdigest().upper()):
        return None
    return headers, payload, end


def inflate(data, start: int) -> tuple[bytes, int | None]:
    """(content, end) of the gzip member at ``start``; end None and the
    content so far if it breaks off."""
    d, out, at, view = zlib.decompressobj(31), [], start, memoryview(data)
    try:
        while not d.eof and at < len(data):
            out.append(d.decompress(view[at:at + BLOCK]))
            at += BLOCK
    except zlib.error:
        d, wrong, out = zlib.decompressobj(31), at, []          # again, the block of the error byte by byte
        try:
            for i in range(start, wrong, BLOCK):
                out.append(d.decompress(view[i:i + BLOCK]))
            for i in range(wrong, min(wrong + BLOCK, len(data))):
                out.append(d.decompress(view[i:i + 1]))
        except zlib.error:
            pass
        return b"".join(out), None
    return b"".join(out), min(at, len(data)) - len(d.unused_data) if d.eof else None


STARTS = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")


def inside(content: bytes):
    """Records and gaps of a member's content: (kind, offset, length, headers,
    payload)."""
    at, bad = 0, None
    while at < len(content):
        found = parse_record(content, at, whole=False)
        if found is None:
            bad = at if bad is None else bad
            nxt = VERSION.search(content, at + 1)
            at = nxt.start() if nxt else len(content)
            continue
        if bad is not None:
            yield "gap", bad, at - bad, None, None
            bad = None
        yield "record", at, found[2] - at, found[0], found[1]
        at = found[2]
    if bad is not None:
        yield "gap", bad, len(content) - bad, None, None


def salvage(data: bytes):
    """Yield (kind, offset, length, headers, payload, inner offset, inner
    length) in the order of the file; kind is ``record`` or ``gap``. The
    lengths of a file's rows add up to its size: of several rows from one
    member the first carries its length. The inner ones are places in a
    member's content, null for a row that is a whole member or no member.
    Records recovered from a broken member come before the gap of its bytes."""
    at, bad = 0, None
    while at < len(data):
        found, end = None, None
        if data[at:at + 3] == b"\x1f\x8b\x08":
            content, end = inflate(data, at)
            found = list(inside(content)) if content else []
            if end is None or content and not any(f[0] == "record" for f in found):
                for kind, i, n, headers, payload in found:
                    if kind == "record":
                        yield "record", at, 0, headers, payload, i, n
                found = None
        else:
            record = parse_record(data, at, whole=False)
            if record is not None:
                found, end = [("record", 0, record[2] - at, record[0], record[1])], record[2]
        if found is None:
            bad = at if bad is None else bad
            nxt = STARTS.search(data, at + 1)
            at = nxt.start() if nxt else len(data)
            continue
        if bad is not None:
            yield "gap", bad, at - bad, None, None, None, None
            bad = None
        one = len(found) == 1
        for k, (kind, i, n, headers, payload) in enumerate(found):
            yield kind, at, end - at if k == 0 else 0, headers, payload, None if one else i, None if one else n
        at = end
    if bad is not None:
        yield "gap", bad, len(data) - bad, None, None, None, None


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """All files under ``folder`` as (kind, path, offset, length, headers,
    payload, inner_offset, inner_length): kind is ``record`` or ``gap``
    (quarantined bytes); see ``salvage``."""
    schema = ("kind string, path string, offset long, length long, headers map<string,string>, payload binary, "
              "inner_offset long, inner_length long")
    types = T.StructType.fromDDL(schema)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(types)
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows, size = [], 0
                for kind, at, n, headers, payload, i, m in salvage(content.as_py()):
                    rows.append({"kind": kind, "path": path, "offset": at, "length": n, "headers": list((headers or {}).items()), "payload": payload,
                                 "inner_offset": i, "inner_length": m})
                    size += len(payload or b"")
                    if len(rows) == 2000 or size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(run, types)
