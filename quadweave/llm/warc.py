"""WARC archives with an index, and coalesced reads of selected records.

Tasks write archives of one gzip member per record into a shared folder and return an index row for each: archive,
offset, length, URL, digest. The index is written as a table when all tasks are done and is what makes a record exist:
an archive left by a lost attempt is in no index row. Reading takes selected index rows in order of archive and
offset, reads neighbouring ranges at once, and checks digests.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadweave.llm.common import broadcast_if_small, shared_folder, shared_table

ARCHIVE_BYTES = 1 << 30
#: Ranges with at most this many bytes between them are read together, up to READ_BYTES.
GAP_BYTES = 1 << 16
READ_BYTES = 4 << 20
#: Every printable ASCII character stays as it is in a URL header.
URL_SAFE = "!\"#$%&'()*+,-./0123456789:;<=>?@ABCDEFGHIJKLMNOPQRSTUVWXYZ[\\]^_`abcdefghijklmnopqrstuvwxyz{|}~"
INDEX = "archive string, offset bigint, length bigint, id bigint, url string, digest string, record_type string"
RECORD = "id bigint, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    for ours, theirs in (("s3a://", "s3://"), ("s3n://", "s3://")):
        uri = uri.replace(ours, theirs, 1) if uri.startswith(ours) else uri
    return pyarrow.fs.FileSystem.from_uri(uri)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(number: int | None) -> str:
    return f"<urn:page:{'' if number is None else number}>"


def _member(header: list[str], block: bytes) -> bytes:
    head = "\r\n".join(["WARC/1.1", *header, f"Content-Length: {len(block)}"]) + "\r\n\r\n"
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def _record(number: int | None, url: str | None, payload: bytes, first: int | None, date: str) -> tuple[bytes, str]:
    digest = digest_of(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    header = [
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(number)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
    ]
    if url is not None:
        header.append(f"WARC-Target-URI: {quote(url, safe=URL_SAFE)}")
    if first is not None:
        header.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        header.append(f"WARC-Refers-To: {_urn(first)}")
        payload = b""
    return _member(header, http + payload), digest


def write_archives(
    pages: DataFrame,
    folder: str,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write one record for every row; returns the index table (INDEX).

    Of rows with equal payloads of at least ``least_bytes`` the one with the largest id is the response; the others
    are revisits of it (several with that id are all responses; if all ids are null, too). A null payload is empty; a
    null URL has no header. Ids are integers. Other columns are ignored; an empty table has an empty index.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(url_col).alias("url"), payload.alias("payload")
    ).withColumn("sha", F.sha1("payload"))
    again = (
        rows.filter(F.octet_length("payload") >= least_bytes)
        .groupBy("sha")
        .agg(F.max("id").alias("first"), F.count("*").alias("copies"))
        .filter("copies > 1")
        .drop("copies")
    )
    again = broadcast_if_small(shared_table(again, "copies"))
    rows = rows.join(again, "sha", "left").select(
        "id", "url", "payload", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("first")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        name, out, offset = "", None, 0
        try:
            for batch in batches:
                index = []
                for number, url, payload, first in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                    if out is None or offset >= archive_bytes:
                        if out is not None:
                            out.close()
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out, offset = system.open_output_stream(f"{root}/{name}", compression=None), 0
                        info = _member([f"WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", "Content-Type: application/warc-fields"], b"format: WARC File Format 1.1\r\n")
                        out.write(info)
                        offset = len(info)
                    data, digest = _record(number, url, payload, first, date)
                    out.write(data)
                    index.append((name, offset, len(data), number, url, digest, "response" if first is None else "revisit"))
                    offset += len(data)
                if index:
                    columns = list(zip(*index, strict=True))
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                        ["archive", "offset", "length", "id", "url", "digest", "record_type"],
                    )
        finally:
            if out is not None:
                out.close()

    return shared_table(rows.mapInArrow(run, INDEX), "index")


def _parsed(data: bytes) -> tuple[int | None, str, int | None, int, str, bytes]:
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])

    def number(name: str) -> int | None:
        text = fields.get(name, "")[len("<urn:page:") : -1]
        return int(text) if text else None

    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (digest_of(payload) != digest or len(payload) != size):
        raise ValueError(f"record {fields['WARC-Record-ID']} differs from its digest")
    return number("WARC-Record-ID"), fields["WARC-Type"], number("WARC-Refers-To"), size, digest, payload


def read_records(index: DataFrame, folder: str, *, partitions: int | None = None) -> DataFrame:
    """The records of some index rows (RECORD); revisits have the size and digest of the payload, but no payload.

    Ranges are ordered by archive and offset over all tasks; ranges that lie together are read at once.
    """
    spark = index.sparkSession
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = index.select("archive", "offset", "length").repartitionByRange(count, "archive", "offset")
    rows = rows.sortWithinPartitions("archive", "offset")
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        opened, name = None, None

        def read(group: list[tuple[str, int, int]]) -> pa.RecordBatch:
            nonlocal opened, name
            if group[0][0] != name:
                if opened is not None:
                    opened.close()
                name = group[0][0]
                opened = system.open_input_file(f"{root}/{name}")
            start = group[0][1]
            data = opened.read_at(group[-1][1] + group[-1][2] - start, start)
            found = [_parsed(data[o - start : o - start + n]) for _, o, n in group]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names
            )

        group: list[tuple[str, int, int]] = []
        for batch in batches:
            for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if group:
                    last = group[-1]
                    apart = row[0] != last[0] or row[1] - last[1] - last[2] > GAP_BYTES
                    if apart or row[1] + row[2] - group[0][1] > READ_BYTES:
                        yield read(group)
                        group = []
                group.append(row)
        if group:
            yield read(group)
        if opened is not None:
            opened.close()

    return rows.mapInArrow(run, RECORD)


def archive_folder(pages: DataFrame) -> str:
    return shared_folder(pages.sparkSession, "warc")
