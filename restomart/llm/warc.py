"""Web archives of pages: an index first, then coalesced byte-range reads."""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from restomart.llm.common import materialize
from restomart.session import shared_path

CAPTURED = "2024-01-01T00:00:00Z"  # date of records whose capture time is not known
MAX_GAP = 64 * 1024  # bytes between two records that one read may span
MAX_READ = 8 * 1024 * 1024  # bytes of one read, unless a single record is larger
TASK_BYTES = 16 * 1024 * 1024  # of records that one task reads
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def payload_digest(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _record_id(page_id: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def _record(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One gzip member with a response (HTTP head and payload) or a revisit (head only)."""
    block = HTTP_HEAD if kind == "revisit" else HTTP_HEAD + payload
    head = [("WARC-Type", kind), ("WARC-Record-ID", _record_id(page_id, digest)), ("WARC-Date", CAPTURED)]
    if url is not None:
        head.append(("WARC-Target-URI", urllib.parse.quote(url, safe="%/:=&?~#+!$,;'@()*[]")))
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", len(payload))]
    if page_id is not None:
        head.append(("X-Page-Id", page_id))
    if kind == "revisit":
        head.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        if refers_to is not None:
            head += [("WARC-Refers-To", _record_id(refers_to, digest)), ("X-Refers-To-Page", refers_to)]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


def _writer(root: str):
    """Writes one archive per task and yields an index row per record. A repeated task writes a
    file of its own, and only the rows of the one that counted name it."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, folder = pyarrow.fs.FileSystem.from_uri(root)
        name, out, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            rows = []
            for page_id, url, payload, digest, kind, refers_to in batch.itertuples(index=False):
                if out is None:
                    system.create_dir(folder, recursive=True)
                    out = system.open_output_stream(name, compression=None)
                digest = payload_digest(bytes.fromhex(digest))
                record = _record(page_id, url, payload, digest, kind, refers_to)
                out.write(record)
                rows.append((page_id, url, name, at, len(record), digest))
                at += len(record)
            if batch is not None and rows:
                yield pd.DataFrame(rows, columns=["page_id", "url", "archive", "offset", "length", "payload_digest"])
        if out is not None:
            out.close()
    return run


def write_archives(pages: DataFrame, min_bytes: int = 0, root: str | None = None) -> DataFrame:
    """Writes a record per page into gzip WARC files and returns their index.

    The reference data of this library has no web pages, so the operator is general: ``pages`` has
    ``page_id``, ``url`` and ``html``. Files go to ``root``, by default a new folder in the shared
    one. The index holds ``page_id``, ``url``, ``archive``, ``offset``, ``length`` and ``payload_digest``.

    The payload is the html in UTF-8 (null: empty). Of pages with equal payloads of at least
    ``min_bytes`` bytes the smallest page_id is a response and the others revisit it. Repeated rows
    of that page_id are responses as well. A null page_id is a revisit where a page with an id has
    the same payload, else a response. Other columns are ignored; without pages no file is
    written and the index is empty.
    """
    root = root or shared_path(pages.sparkSession, "warc")
    id_type = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    first = rows.groupBy("digest").agg(F.min("page_id").alias("first_id"))
    revisit = (F.octet_length("payload") >= min_bytes) & F.col("first_id").isNotNull() & ~F.col(
        "page_id").eqNullSafe(F.col("first_id"))
    typed = rows.join(first, "digest").select(
        F.col("page_id").cast("string"), "url", "payload", "digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id").cast("string")).alias("refers_to"))
    index = typed.mapInPandas(_writer(root), "page_id string, url string, archive string, offset long, "
                                             "length long, payload_digest string")
    return materialize(index.withColumn("page_id", F.col("page_id").cast(id_type)), "warc-index")


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one gzip member."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    if not version.startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError("damaged record")
    return fields, rest[:size]


def coalesced(ranges: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Joins sorted (offset, length) ranges into reads: start, end and the ranges inside."""
    start = end = 0
    inside: list[tuple[int, int]] = []
    for offset, length in ranges:
        if inside and (offset - end > MAX_GAP or offset + length - start > MAX_READ):
            yield start, end, inside
            inside = []
        if not inside:
            start = end = offset
        inside.append((offset, length))
        end = max(end, offset + length)
    if inside:
        yield start, end, inside


def _reader(root: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = pyarrow.fs.FileSystem.from_uri(root)
        for batch in batches:
            for archive, group in batch.groupby("archive", sort=False):
                ranges = sorted(zip(group["offset"], group["length"]))
                with system.open_input_file(archive) as file:
                    for start, end, inside in coalesced(ranges):
                        data = file.read_at(int(end - start), int(start))
                        rows = []
                        for offset, length in inside:
                            fields, block = parse_record(data[offset - start:offset - start + length])
                            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                            payload = None
                            if fields["WARC-Type"] == "response":
                                payload = block.partition(b"\r\n\r\n")[2]
                                if payload_digest(hashlib.sha1(payload).digest()) != digest:
                                    raise ValueError(f"payload of {archive} at {offset} does not fit its digest")
                            rows.append((fields.get("X-Page-Id"), int(fields["X-Payload-Length"]), digest,
                                         fields["WARC-Type"], fields.get("X-Refers-To-Page"), payload))
                        yield pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest",
                                                          "record_type", "refers_to", "payload"])
    return run


def read_records(selected: DataFrame, root: str) -> DataFrame:
    """Reads the records of ``selected`` index rows (``page_id``, ``archive``, ``offset``, ``length``).

    Rows are sorted by archive and offset and dealt out in ranges of about ``TASK_BYTES`` of records, counted
    by their lengths; neighbouring records come in one read. Gives ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to`` and
    ``payload`` (null for a revisit; its response holds it). Payloads are checked against their digests.
    Repeated rows are read as often as they occur; no rows give an empty result.
    """
    id_type = selected.schema["page_id"].dataType.simpleString()
    # The rows say little of the work: left to their size, all reads would become one task.
    total = selected.agg(F.sum("length")).first()[0] or 0
    dealt = selected.select("archive", "offset", "length").repartitionByRange(
        max(1, -(-total // TASK_BYTES)), "archive", "offset").sortWithinPartitions("archive", "offset")
    found = dealt.mapInPandas(_reader(root), "page_id string, payload_bytes long, payload_digest string, "
                                             "record_type string, refers_to string, payload binary")
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})
