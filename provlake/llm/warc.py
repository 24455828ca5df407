"""WARC archives: write a record for each page, read the archives back, put segmented records together.

Writing. Pages with equal payloads (SHA-1 and length) of at least MIN_REVISIT bytes are one capture and its revisits: the
smallest page_id is the response, others refer to it. A response's HTTP block uses chunked transfer framing; a block of
more than SEGMENT bytes is split into a first segment and continuation records, the last of which states the total
length. Records go to gzip files through Spark's text sink, whose line end is the blank lines that end a record; so the
archives can lie in any store that Spark writes. Files hold at most RECORDS_PER_FILE records, each of bounded size.

Reading. Each task unpacks and parses whole files, of one gzip member or of one a record, or not packed at all, and its
records go to a scratch table. Responses, revisits, resources and continuations are read; warcinfo, request, metadata and
conversion records are passed over. Unsegmented records are decoded where they are parsed: an HTTP head is cut off, and
chunked framing undone where the head names it. The others are grouped by the identifier of their origin record, ordered
by segment number, joined, checked against the stated total length, and only then decoded; a gap, a repeated number or a
wrong length is an error, and so is a payload that differs from a stated SHA-1.

Defined results: null html is the empty payload; a null url is left out and reads back as null; null page_id is allowed,
never is referred to unless all its copies are null; rows that share page_id and payload are all response if that id is
the smallest; records of other writers have no page_id, and their revisits no payload_bytes; an empty table gives an
empty archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, scratch_path

SEGMENT = 32 * 1024
CHUNK = 8 * 1024
MIN_REVISIT = 0
RECORDS_PER_FILE = 2048
_DATE = "2000-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_BLANK = b"\r\n\r\n"


def captures(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, record_type and refers_to. The hot payload's rows meet its one first row in a join that Spark can split."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("same", F.struct(F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("bytes")))
    firsts = rows.groupBy("same").agg(F.min("page_id").alias("first"))
    own = (F.octet_length("payload") < min_revisit) | F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.join(firsts, "same").withColumn("own", own)
    return rows.select("page_id", "url", "payload", F.when(F.col("own"), "response").otherwise("revisit").alias("record_type"), F.when(~F.col("own"), F.col("first")).alias("refers_to"))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, chunk: int = CHUNK) -> bytes:
    parts = [payload[i : i + chunk] for i in range(0, len(payload), chunk)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunk(data: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        size = int(data[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(data[end + 2 : end + 2 + size])
        if len(out[-1]) != size or data[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at = end + 4 + size


def _record(kind: str, name: str, fields: dict[str, object], block: bytes) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{name}>", "WARC-Date": _DATE, **{k: v for k, v in fields.items() if v is not None}, "Content-Length": len(block)}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block


def page_name(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def build(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, unique: str, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page, without the blank lines that end each."""
    name = f"{page_name(page_id)}:{unique}"
    fields: dict[str, object] = {"WARC-Target-URI": None if url is None else quote(url, safe="/:?#[]@!$&'()*+,;=-._~"), "WARC-Payload-Digest": f"sha1:{digest(payload)}"}
    if kind == "revisit":
        fields |= {"WARC-Refers-To": f"<{page_name(refers_to)}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Payload-Length": len(payload), "Content-Type": "application/http; msgtype=response"}
        yield _record(kind, name, fields, _HTTP)
        return
    block = _HTTP + chunked(payload)
    fields["Content-Type"] = "application/http; msgtype=response"
    if len(block) <= segment:
        yield _record(kind, name, fields, block)
        return
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    yield _record(kind, name, fields | {"WARC-Segment-Number": 1}, parts[0])
    for k, part in enumerate(parts[1:], 2):
        total = {"WARC-Segment-Total-Length": len(block)} if k == len(parts) else {}
        yield _record("continuation", f"{name}:{k}", {"WARC-Segment-Origin-ID": f"<{name}>", "WARC-Segment-Number": k, **total}, part)


def write(pages: DataFrame, path: str, segment: int = SEGMENT, min_revisit: int = MIN_REVISIT) -> None:
    """Write pages as gzip WARC files below path."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
                out = [r for row in zip(*(c.to_pylist() for c in part.columns), strict=True) for r in build(*row, segment)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    rows = captures(pages, min_revisit).withColumn("unique", F.expr("uuid()"))
    out = rows.mapInArrow(records, "record binary").select(F.col("record").cast("string").alias("value"))
    out.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


RECORD = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("origin", T.StringType()),
        T.StructField("segment", T.IntegerType()),
        T.StructField("total", T.LongType()),
        T.StructField("block", T.BinaryType()),
        T.StructField("http", T.BooleanType()),
    ]
)


READ = ("response", "revisit", "resource", "continuation")


def unpacked(data: bytes) -> bytes:
    """The content of a file: of all its gzip members, or as it is."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        member = zlib.decompressobj(wbits=31)
        out += [member.decompress(data), member.flush()]
        if not member.eof:
            raise ValueError("a gzip member is cut short")
        data = member.unused_data.lstrip(b"\0")
    return b"".join(out)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The header fields, by lower-case name, and the block of every record of an unpacked archive that READ names."""
    at = 0
    while at < len(data):
        end = data.index(_BLANK, at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start, size = end + 4, int(fields["content-length"])
        if data[start + size : start + size + 4] != _BLANK:
            raise ValueError(f"the record at byte {at} isn't {size} bytes long")
        if fields["warc-type"] in READ:
            yield fields, data[start : start + size]
        at = start + size + 4


def payload_of(block: bytes, claimed: str | None, http: bool = True) -> bytes:
    """The payload of a block, checked against the record's digest."""
    payload = block
    if http:
        head, _, payload = block.partition(_BLANK)
        if re.search(rb"\r\ntransfer-encoding:[^\r]*chunked", head, re.I):
            payload = dechunk(payload)
    if claimed and claimed != digest(payload):
        raise ValueError("a payload differs from its digest")
    return payload


def _page_of(name: str | None) -> int | None:
    found = re.match(r"<?urn:page:(-?\d+)\b", name or "")
    return int(found[1]) if found else None


def _number(fields: dict[str, str], name: str) -> int | None:
    return int(fields[name]) if name in fields else None


def _row(fields: dict[str, str], block: bytes) -> tuple:
    kind, name = fields["warc-type"], fields["warc-record-id"]
    segment, total = _number(fields, "warc-segment-number"), _number(fields, "warc-segment-total-length")
    if kind == "continuation":
        return None, None, None, None, None, None, None, fields["warc-segment-origin-id"], segment, total, block, None
    label, _, claimed = fields.get("warc-payload-digest", "").partition(":")
    claimed = claimed if label == "sha1" else None
    url = unquote(fields["warc-target-uri"].strip("<>")) if "warc-target-uri" in fields else None
    head = (_page_of(name), url, kind, _page_of(fields.get("warc-refers-to")), claimed)
    if kind == "revisit":
        return *head, _number(fields, "x-payload-length"), None, None, None, None, None, None
    http = fields.get("content-type", "").lower().startswith("application/http")
    if segment:
        return *head, None, None, name, segment, total, block, http
    payload = payload_of(block, claimed, http)
    return *head[:4], digest(payload), len(payload), payload, None, None, None, None, None


_ARROW = pa.schema([(f.name, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}[f.dataType.simpleString()]) for f in RECORD])


def _parse_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    for content in (c for b in batches for c in b.column(0)):
        rows: list[tuple] = []
        for fields, block in parse(unpacked(content.as_py())):
            rows.append(_row(fields, block))
            if len(rows) == 256:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)


@F.pandas_udf(T.BinaryType())
def _joined(blocks: pd.Series, totals: pd.Series, claimed: pd.Series, https: pd.Series) -> pd.Series:
    out = []
    for parts, total, sha, http in zip(blocks, totals, claimed, https, strict=True):
        if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)):
            raise ValueError("a segment is missing or there twice")
        block = b"".join(p["block"] for p in parts)
        if len(block) != total:
            raise ValueError(f"segments of {len(block)} bytes should have {total}")
        out.append(payload_of(block, sha, http))
    return pd.Series(out, dtype=object)


def reassemble(segments: DataFrame) -> DataFrame:
    """One row for each origin record: its segments grouped by its identifier, in order, checked, joined and decoded."""
    head = ["page_id", "url", "record_type", "refers_to", "payload_digest"]
    part = F.struct("segment", "block")
    rows = segments.groupBy("origin").agg(*(F.max(c).alias(c) for c in (*head, "total", "http")), F.array_sort(F.collect_list(part)).alias("parts"))
    rows = rows.withColumn("payload", _joined("parts", "total", "payload_digest", "http"))
    return rows.select(*head, F.octet_length("payload").cast("long").alias("payload_bytes"), "payload")


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_digest, payload_bytes and payload (null for revisits) of every record."""
    files = spark.read.format("binaryFile").load(path).select("content")
    rows = materialize(files.mapInArrow(_parse_files, RECORD), "records", compression="zstd")
    whole = rows.where("segment is null").select(*RECORD.names[:7])
    return whole.unionByName(reassemble(rows.where("segment is not null")))


def archive(pages: DataFrame) -> DataFrame:
    """Write pages to an archive in the shared folder and read it back."""
    path = scratch_path(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path)
