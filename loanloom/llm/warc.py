"""A content-addressed WARC archive: payloads once by digest, exact record headers apart."""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanloom.llm.common import row_id, shared_folder, small_batches, text_bytes

#: Fixed values of the format.
VERSION, REVISIT_PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE, STATUS = "2020-01-01T00:00:00Z", "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

_HEADERS = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("row", T.LongType()), T.StructField("address", T.StringType()),
    T.StructField("header", T.BinaryType()), T.StructField("tail", T.BinaryType())])
_PAYLOADS = T.StructType([T.StructField("address", T.StringType()), T.StructField("payload", T.BinaryType())])


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_uri(page_id: int | None, row: int) -> str:
    """A record id that depends on the page and, for repeated pages, on the row."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{row}')}>"


def _field(value: str | None) -> str:
    """A header value on one line; per cent and line ends are escaped, so it reads back."""
    return (value or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _plain(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record_header(page_id, row, url, n_bytes, sha1, first_page, first_row) -> bytes:
    """The exact bytes before the payload: WARC header, blank line, HTTP header.

    A revisit names the record it refers to and holds the HTTP header only. A record for a
    null id has no page header line, a null URL an empty target.
    """
    revisit = first_row is not None
    lines = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_uri(page_id, row)}",
             f"WARC-Date: {DATE}", f"WARC-Target-URI: {_field(url)}", f"WARC-Payload-Digest: sha1:{sha1}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_uri(first_page, first_row)}"]
        if first_page is not None:
            lines.append(f"X-Refers-To-Page-ID: {first_page}")
    size = len(STATUS) + (0 if revisit else n_bytes)
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {size}", f"X-Payload-Length: {n_bytes}"]
    return ("\r\n".join(lines) + "\r\n\r\n" + STATUS).encode()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The address of a payload (SHA-256), its SHA-1 and its size, with the row's other columns."""
    for batch in batches:
        data = batch.column(3).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array([hashlib.sha256(x).hexdigest() for x in data], pa.string()),
             pa.array([base32_sha1(x) for x in data], pa.string()), pa.array([len(x) for x in data], pa.int64())],
            names=["page_id", "row", "url", "address", "sha1", "n_bytes"])


def _write_headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        headers = [record_header(*(r[c] for c in ("page_id", "row", "url", "n_bytes", "sha1", "first_page", "first_row"))) for r in rows]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("row"), batch.column("address"), pa.array(headers, pa.binary()),
             pa.array([b"\r\n\r\n"] * len(rows), pa.binary())], names=["page_id", "row", "address", "header", "tail"])


def write_archive(pages: DataFrame, folder: str, min_bytes: int = 0) -> None:
    """Write ``pages`` (``page_id, url, html``) below ``folder``: tables ``headers`` and ``payloads``.

    Payloads are the UTF-8 bytes of the html, null as empty, and are stored once per SHA-256,
    whose equality is verified with a second digest and the size. Of equal payloads of at
    least ``min_bytes`` the one with the smallest page id is the response (ids before null,
    of repeated ids the first row), the others revisit it; smaller payloads are all
    responses. Records of one payload meet as digests only, summed up before the shuffle.
    """
    small_batches(pages.sparkSession)
    rows = pages.select("page_id", row_id().alias("row"), "url", text_bytes("html").alias("payload"))
    marked = rows.mapInArrow(_digests, "page_id long, row long, url string, address string, sha1 string, n_bytes long")
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    firsts = marked.groupBy("address").agg(F.min(order).alias("first"), F.min("sha1").alias("low"), F.max("sha1").alias("high"),
                                           F.min("n_bytes").alias("least"), F.max("n_bytes").alias("most"))
    clash = F.raise_error(F.concat(F.lit("two payloads have one address: "), F.col("address")))
    same = (F.col("low") == F.col("high")) & (F.col("least") == F.col("most"))
    firsts = firsts.select(F.when(same, F.col("address")).otherwise(clash).alias("address"), "first")
    joined = marked.join(firsts, "address")
    revisit = (F.col("n_bytes") >= min_bytes) & (F.col("first.row") != F.col("row"))
    joined = joined.select("page_id", "row", "url", "address", "sha1", "n_bytes",
                           F.when(revisit, F.col("first.page_id")).alias("first_page"), F.when(revisit, F.col("first.row")).alias("first_row"))
    joined.mapInArrow(_write_headers, _HEADERS).write.parquet(f"{folder}/headers")
    stored = rows.select(F.sha2("payload", 256).alias("address"), "payload")
    stored.groupBy("address").agg(F.first("payload").alias("payload")).write.parquet(f"{folder}/payloads")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """The records of an archive, ``page_id, row, record, payload``: headers joined with their payloads again.

    ``record`` is the WARC record as one byte string: of a response with the payload, of a
    revisit without it. ``payload`` is the full payload for both.
    """
    headers = spark.read.schema(_HEADERS).parquet(f"{folder}/headers")
    payloads = spark.read.schema(_PAYLOADS).parquet(f"{folder}/payloads")
    joined = headers.join(payloads, "address")
    small_batches(spark)
    return joined.select("page_id", "row", "header", "payload", "tail").mapInArrow(
        _assemble, "page_id long, row long, record binary, payload binary")


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        records = [h + (b"" if b"\r\nWARC-Type: revisit\r\n" in h else p) + t
                   for h, p, t in zip(*(batch.column(c).to_pylist() for c in ("header", "payload", "tail")), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("row"), pa.array(records, pa.binary()), batch.column("payload")],
                                         names=["page_id", "row", "record", "payload"])


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record; the lengths are checked."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"not a {VERSION} record")
    fields = {k: _plain(v) for k, v in (line.split(": ", 1) for line in lines[1:])}
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("the record does not end where its length says")
    return fields, rest[:size]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the records say, after checking their payloads against size and digest."""
    for batch in batches:
        out = []
        for record, payload in zip(batch.column("record").to_pylist(), batch.column("payload").to_pylist(), strict=True):
            fields, block = parse_record(record)
            kind, digest = fields["WARC-Type"], base32_sha1(payload)
            body = block.partition(b"\r\n\r\n")[2]
            if f"sha1:{digest}" != fields["WARC-Payload-Digest"] or len(payload) != int(fields["X-Payload-Length"]) or (
                    kind == "response" and body != payload):
                raise ValueError(f"payload of {fields['WARC-Record-ID']} is not the one that was written")
            ids = [int(fields[k]) if k in fields else None for k in ("X-Page-ID", "X-Refers-To-Page-ID")]
            out.append((ids[0], fields["WARC-Target-URI"], len(payload), digest, kind, ids[1]))
        columns = list(zip(*out, strict=True)) or [()] * 6
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=_DESCRIBED)


_DESCRIBED = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def describe_archive(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record read back: ids, target, payload size and digest, type, the page a revisit refers to."""
    return read_records(spark, folder).mapInArrow(
        _describe, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to an archive of their own in the shared folder and describe what it holds."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(pages, folder, min_bytes)
    return describe_archive(spark, folder)
