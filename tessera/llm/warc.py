"""WARC archives: segmented records with revisits, written and put together again."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_path, thrifty

#: Bytes of a record's block beyond which it is dealt over continuation records, and bytes of a transfer chunk.
SEGMENT_BYTES, CHUNK_BYTES = 16_384, 4_096
#: Records in a file at most, which bounds what a reader holds.
FILE_RECORDS = 2_000
#: Equal payloads of at least so many bytes are stored once, the others revisit.
REVISIT_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
_END = "\r\n\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def sha1_base32(text: Column) -> Column:
    """The SHA-1 of a string's UTF-8 in upper-case base 32: eight digits for each ten of the hexadecimal form."""
    groups = [F.translate(F.lpad(F.conv(F.substring(F.sha1(text), 10 * k + 1, 10), 16, 32), 8, "0"), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for k in range(4)]
    return F.concat(*groups)


def pieces(data: bytes, size: int) -> list[bytes]:
    """data cut into parts of about that size, between characters of its UTF-8."""
    out, start = [], 0
    while start < len(data):
        end = min(len(data), start + size)
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        out.append(data[start:end])
        start = end
    return out


def chunked(payload: bytes) -> bytes:
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in pieces(payload, CHUNK_BYTES)) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing, whose end must be there."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        n = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if not n:
            if not body[at:].endswith(b"\r\n"):
                raise ValueError("the transfer framing has no end")
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n" or len(body) < at + n:
            raise ValueError("a transfer chunk is not as long as it says")
        out.append(body[at : at + n])
        at += n + 2


def _record(kind: str, name: str, uri: str, digest: str, block: bytes, extra: list[tuple[str, str]]) -> str:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), *extra, ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n" + block.decode()


def records(page_id: int | None, row: int | None, url: str | None, payload: str | None, digest: str, refers_to: int | None, revisit: bool) -> list[str]:
    """The records of a page, without the line ends behind each: a revisit, or a response and its continuations.

    The row number is part of the name of all rows but the first with their id and payload, and of rows without an id.
    """
    name, uri = f"urn:page:{'' if page_id is None else page_id}:{digest}" + ("" if row is None else f":{row}"), (url or "").replace("\r", "%0D").replace("\n", "%0A")
    if revisit:
        about = [("WARC-Refers-To", f"<urn:page:{refers_to}:{digest}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        return [_record("revisit", name, uri, digest, _HTTP, about)]
    block = _HTTP + chunked((payload or "").encode())
    parts = pieces(block, SEGMENT_BYTES)
    if len(parts) == 1:
        return [_record("response", name, uri, digest, block, [])]
    out = [_record("response", name, uri, digest, parts[0], [("WARC-Segment-Number", "1")])]
    for k, part in enumerate(parts[1:], 2):
        extra = [("WARC-Segment-Origin-ID", f"<{name}>"), ("WARC-Segment-Number", str(k))]
        if k == len(parts):
            extra.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(_record("continuation", f"{name}:{k}", uri, digest, part, extra))
    return out


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = REVISIT_BYTES) -> None:
    """Writes gzipped WARC files of all rows to the folder `path`, by Spark's own text writer and commit protocol.

    Null html is an empty payload, a null url an empty one. Of equal payloads of at least revisit_bytes, the row with the
    largest id is the response (repeated rows of that id each are), the others revisit it; rows without an id revisit
    too if there is one with an id, else all are responses.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).alias("_url"), F.coalesce(F.col(html_col), F.lit("")).alias("_html"), F.monotonically_increasing_id().alias("_row"))
    rows = rows.withColumn("_digest", sha1_base32(F.col("_html")))
    # which row is the response is told from ids and digests; payloads move only to what is told of their own id and digest
    same = rows.groupBy("_id", "_digest").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    largest = same.groupBy(F.col("_digest").alias("_d")).agg(F.max("_id").alias("_largest"))
    told = same.join(largest, F.col("_digest") == F.col("_d")).select(F.col("_id").alias("_tid"), F.col("_digest").alias("_td"), "_first", "_n", "_largest")
    of_row = F.col("_id").eqNullSafe(F.col("_tid")) & (F.col("_digest") == F.col("_td"))
    extra = F.when(F.col("_id").isNull() | (F.col("_n") > 1) & (F.col("_row") != F.col("_first")), F.col("_row"))
    judged = rows.join(told, of_row).select("_id", extra.alias("_row"), "_url", "_html", "_digest", "_largest")
    revisit = (F.octet_length("_html") >= revisit_bytes) & F.col("_largest").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_largest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for k in range(0, batch.num_rows, 200):
                out = [r for args in zip(*[c[k : k + 200] for c in columns]) for r in records(*args)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    judged.withColumn("_revisit", revisit).mapInArrow(thrifty(run), "value string").write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse(stored: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of the records of a file, which is expanded as it is read.

    The file may be gzipped as a whole, record by record (any number of members), or not at all.
    """
    zipped = stored[:2] == b"\x1f\x8b"
    expand, buffer, at, given = zlib.decompressobj(31), bytearray(), 0, 0

    def fill(n: int) -> bool:
        nonlocal at, expand, given
        while len(buffer) - at < n and given < len(stored):
            if at > 1 << 20:
                del buffer[:at]
                at = 0
            piece = stored[given : given + (1 << 18)]
            given += len(piece)
            if not zipped:
                buffer.extend(piece)
                continue
            buffer.extend(expand.decompress(piece))
            if expand.eof:  # the next member begins behind this one
                given -= len(expand.unused_data)
                expand = zlib.decompressobj(31)
            elif given == len(stored):
                raise ValueError("the file ends inside a gzip member")
        return len(buffer) - at >= n

    while fill(1):
        end = buffer.find(b"\r\n\r\n", at)
        while end < 0:
            if not fill(len(buffer) - at + 1):
                raise ValueError("a record's header has no end")
            end = buffer.find(b"\r\n\r\n", at)
        head = bytes(buffer[at:end]).decode().split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {}
        for line in head[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        at = end + 4
        n = int(fields["content-length"])
        if not fill(n + 4) or buffer[at + n : at + n + 4] != b"\r\n\r\n":
            raise ValueError("a record is not as long as it says")
        yield fields, bytes(buffer[at : at + n])
        at += n + 4


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response: the body behind its header, out of chunked transfer framing if it is in one."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = [line.partition(b":") for line in head.lower().split(b"\r\n")[1:]]
    if any(name.strip() == b"transfer-encoding" and b"chunked" in value for name, _, value in fields):
        return unchunked(body)
    return body


def _bare(value: str | None) -> str | None:
    return value.strip("<>") if value else None


def read(spark, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every response and revisit with its continuations.

    Segments are grouped by the record they began with and ordered by number; numbers, total length and digest must be
    right. A revisit takes its length from the response that it names, which must be there. Records of other types
    (warcinfo, request, metadata) are passed over. The page id is told by the names that write gives; records of other
    names have none, and a revisit whose target is outside these archives has no length.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["origin", "number", "total", "kind", "refers", "digest", "n", "block"]
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())
        for batch in batches:
            for content in batch.column(0):
                out = []
                for f, block in parse(content.as_py()):
                    if f["warc-type"] not in ("response", "revisit", "continuation"):
                        continue
                    number, n = f.get("warc-segment-number"), None
                    origin, stated = _bare(f.get("warc-segment-origin-id") or f["warc-record-id"]), f.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    if number is None and f["warc-type"] == "response":
                        (n, stated), block = verified(block, stated), None
                    elif f["warc-type"] == "revisit":
                        block = None
                    total = f.get("warc-segment-total-length")
                    out.append((origin, int(number or 1), int(total) if total else None, f["warc-type"], _bare(f.get("warc-refers-to")), stated, n, block))
                    if len(out) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=names)
                        out = []
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=names)

    def verified(block: bytes, stated: str | None) -> tuple[int, str]:
        payload = payload_of(block)
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if stated not in (None, found):
            raise ValueError("a payload is not what its digest says")
        return len(payload), found

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for origin, segments in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                first = segments[0]
                n, stated = first["n"], first["digest"]
                if first["kind"] == "response" and n is None:
                    block = b"".join(s["block"] for s in segments)
                    if [s["number"] for s in segments] != list(range(1, len(segments) + 1)) or segments[-1]["total"] != len(block):
                        raise ValueError("a record lacks a segment")
                    n, stated = verified(block, stated)
                refers = first["refers"]
                out.append((page_of(origin), n, stated, first["kind"], page_of(refers or ""), refers))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()))], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target"])

    def page_of(name: str) -> int | None:
        parts = name.split(":")
        return int(parts[2]) if parts[:2] == ["urn", "page"] and len(parts) > 3 and parts[2] else None

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc}").load(path).select("content")
    segments = files.mapInArrow(thrifty(rows), "origin string, number int, total long, kind string, refers string, digest string, n long, block binary")
    grouped = segments.groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("number", "total", "kind", "refers", "digest", "n", "block"))).alias("segments"))
    found = cut(grouped.mapInArrow(thrifty(assembled), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target string"), "warc-records")
    responses = found.where("record_type = 'response'").drop("target")
    lengths = responses.groupBy(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest")).agg(F.max("payload_bytes").alias("_n"))
    revisits = found.where("record_type = 'revisit'").join(lengths, (F.col("refers_to") == F.col("_page")) & (F.col("payload_digest") == F.col("_digest")), "left")
    missing = F.raise_error(F.lit("a revisit names a record that is not there")).cast("long")
    length = F.when(F.col("refers_to").isNotNull(), F.coalesce("_n", missing))
    return responses.unionByName(revisits.select("page_id", length.alias("payload_bytes"), "payload_digest", "record_type", "refers_to"))


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Archives every row of pages and reads the archives back: see write and read for every case's result."""
    path = fresh_path(pages.sparkSession, "warc")
    write(pages, path, **options)
    return read(pages.sparkSession, path)
