"""WARC archives with an index: write records, index them, read selected records by coalesced byte ranges.

Each record is a gzip member of its own, so it can be read alone. Tasks write whole files into the shared folder under
names of their own and return the index rows (offset, length, URL, digest per record); the index is written as a table,
and only files that it names count, so a repeated or lost task leaves at most files that nobody reads.

Of pages with equal payloads the one of least id is written as ``response``, the others as ``revisit`` records (identical
payload digest), which hold the HTTP header of the response but no payload. Finding them shuffles digests and ids only.

Reading: index rows go to tasks by (file, stretch of the file), sorted by offset; neighbours whose gap is at most ``gap``
bytes are fetched in one read of at most ``most`` bytes (a longer single record alone).

The folder is opened with ``pyarrow.fs`` from its URI, so any store that Arrow knows will do.

Defined results: null html is the empty payload; a null URL is written as ``urn:unknown``; line breaks in a URL become
``%0A``; rows of one id and equal payload are equal records; null ids come after all others; empty tables give an empty
index; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import materialise, scratch_path

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
FILE_BYTES = 64 << 20
GAP = 16 << 10
MOST = 4 << 20
INDEX = "page_id bigint, url string, digest string, file string, offset bigint, length bigint"
READ = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member; the block of a revisit ends with the HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = re.sub(r"[\r\n]", "%0A", url) if url else "urn:unknown"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {target}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n", compresslevel=3, mtime=0)


def parse(member: bytes) -> dict:
    """The fields of a record read back."""
    data = zlib.decompress(member, wbits=31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
    revisit = fields["WARC-Type"] == "revisit"
    url = fields["WARC-Target-URI"]
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and digest_of(payload) != stated:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": None if url == "urn:unknown" else url, "record_type": fields["WARC-Type"],
        "payload_bytes": int(http.decode().rpartition("Content-Length: ")[2]), "payload_digest": stated,
        "refers_to": number(fields["WARC-Refers-To"]) if revisit else None, "payload": None if revisit else payload,
    }


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) below ``folder`` and return the index."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    size = F.octet_length(payload)
    pages = pages.select("page_id", "url", payload.alias("html"))
    slim = pages.select("page_id", F.sha1("html").alias("sha"), size.alias("size"))
    firsts = materialise(slim.where(F.col("size") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "firsts")
    revisits = slim.where(F.col("size") >= min_bytes).join(firsts, "sha").where(~F.col("page_id").eqNullSafe(F.col("first")))
    revisits = materialise(revisits.select(F.col("page_id").alias("_id"), F.col("sha").alias("_sha"), F.col("first").alias("_first")).distinct(), "revisits")
    same = F.col("page_id").eqNullSafe(F.col("_id")) & (F.sha1("html") == F.col("_sha"))
    rows = pages.join(revisits, same, "left").select("page_id", "url", "html", "_first", F.col("_sha").isNotNull().alias("_revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        out, name, at = None, "", 0
        index: list[tuple] = []
        for batch in batches:
            for page_id, url, html, first, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                data = html.encode()
                digest = digest_of(data)
                member = record(page_id, url, data, digest, first, revisit)
                out.write(member)
                index.append((page_id, url, digest, name, at, len(member)))
                at += len(member)
                if at >= file_bytes:
                    out.close()
                    out = None
            if len(index) >= 10_000:
                yield _rows(index, INDEX)
                index = []
        if out is not None:
            out.close()
        if index:
            yield _rows(index, INDEX)

    return materialise(rows.mapInArrow(run, INDEX), "index")


_KINDS = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split(" ") for x in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(columns, kinds, strict=True)], list(names))


def ranges(spans: list[tuple[int, int]], gap: int, most: int) -> list[tuple[int, int, int]]:
    """Sorted (offset, length) spans joined into reads: (first span, span after the last, bytes from the first's offset)."""
    out: list[tuple[int, int, int]] = []
    for i, (offset, length) in enumerate(spans):
        if out:
            first, _, size = out[-1]
            start = spans[first][0]
            if offset - (start + size) <= gap and offset + length - start <= most:
                out[-1] = first, i + 1, max(size, offset + length - start)
                continue
        out.append((i, i + 1, length))
    return out


def read_records(selected: DataFrame, folder: str, gap: int = GAP, most: int = MOST, with_payload: bool = True) -> DataFrame:
    """The records of the selected index rows."""
    # index rows are small but the records behind them are not, so the number of tasks must not follow the rows' size
    tasks = int(selected.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = selected.select("file", "offset", "length").repartition(tasks, "file", F.floor(F.col("offset") / most)).sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            files, offsets, lengths = (c.to_pylist() for c in batch.columns)
            i = 0
            while i < len(files):
                j = i
                while j < len(files) and files[j] == files[i]:
                    j += 1
                spans = list(zip(offsets[i:j], lengths[i:j], strict=True))
                with store.open_input_file(f"{root}/{files[i]}") as source:
                    for a, b, size in ranges(spans, gap, most):
                        start = spans[a][0]
                        data = source.read_at(size, start)
                        found = [parse(data[o - start : o - start + n]) for o, n in spans[a:b]]
                        if not with_payload:
                            found = [r | {"payload": None} for r in found]
                        yield _rows([tuple(r.values()) for r in found], READ)
                i = j

    return placed.mapInArrow(run, READ)


def archive_and_read(pages: DataFrame, min_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """Write all pages to a new folder, index them and read every record back: ``(index, records)``."""
    folder = scratch_path(pages.sparkSession, "warc")
    folder = folder if re.match(r"[a-z0-9]+:", folder) else f"file://{folder}"
    folder = re.sub(r"^file:/+", "file:///", folder)
    index = write_archives(pages, folder, min_bytes)
    return index, read_records(index, folder, with_payload=False)
