"""WARC archives: write, index, and read selected records by byte ranges.

Each record is a gzip member of its own. The index, built first, has file, offset, length, URL and payload digest of every record; a read picks
records from the index, sorts them by place and joins neighbouring ranges into one request.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake.llm.common import stored
from stratalake.sources.storage import scratch_dir

#: Payloads of fewer bytes are always stored.
LEAST_REVISIT = 1000
#: Ranges of one file are read together while the gap between them and the whole stay under these bytes.
GAP, REQUEST = 1 << 16, 1 << 23
#: Compressed bytes after which a task starts its next archive.
ARCHIVE = 1 << 30
#: Fixed values of the format (WARC 1.1).
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2026-01-01T00:00:00Z"


def plan_records(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) with digest, n_bytes, record_type and refers_to.

    Of equal payloads (by SHA-1 and length) of at least ``LEAST_REVISIT`` bytes the row with the largest page_id is the response;
    the others revisit it. Null ids lose against any other, and are all responses among themselves; so are repeated rows
    of the largest id. Null html is an empty payload. The largest ids are found in a narrow aggregate that combines before the shuffle, and
    only digests that occur more than once are joined back.
    """
    narrow = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).select("*", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").cast("long").alias("n_bytes"))
    most = (
        narrow.where(F.col("n_bytes") >= LEAST_REVISIT)
        .groupBy("digest", "n_bytes")
        .agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
        .where("n > 1 and kept is not null")
        .drop("n")
    )
    revisit = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    return narrow.join(most, ["digest", "n_bytes"], "left").select(
        "page_id",
        "url",
        "digest",
        "n_bytes",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("kept")).alias("refers_to"),
        F.when(~revisit, F.col("html")).alias("html"),
    )


def _id(page_id: int | None, digest: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}').urn}>"


def _record(page_id: int | None, url: str | None, digest: str, n_bytes: int, kind: str, refers_to: int | None, html: str | None) -> bytes:
    block = HTTP_HEAD + ((html or "").encode("utf-8") if kind == "response" else b"")
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", _id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", "".join("%%%02X" % ord(c) if c in "\r\n" else c for c in url) if url is not None else None),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("Content-Type", "application/http;msgtype=response"),
        ("X-Page-Id", page_id),
    ]
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _id(refers_to, digest)), ("X-Refers-To-Page", refers_to), ("X-Payload-Length", n_bytes)]
    head.append(("Content-Length", len(block)))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head if v is not None)
    return b"WARC/1.1\r\n" + lines.encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"


INDEX = "page_id long, url string, digest string, file string, offset long, length long"


def write_archives(records: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Write planned records; returns the index, written as a table.

    Every task writes archives under names of its own attempt, and the index names those of the attempts that count. An empty table
    writes nothing and gives an empty index.
    """
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, part = pafs.FileSystem.from_uri(folder)[0], TaskContext.get().partitionId()
        stream, file, at = None, "", 0
        for batch in batches:
            places = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if stream is None or at >= ARCHIVE:
                    if stream is not None:
                        stream.close()
                    file, at = f"{root}/part-{part:06d}-{uuid.uuid4().hex}.warc.gz", 0
                    stream = fs.open_output_stream(file, compression=None)
                gzip = zlib.compressobj(level, wbits=31)
                data = gzip.compress(_record(*row)) + gzip.flush()
                stream.write(data)
                places.append((file, at, len(data)))
                at += len(data)
            if places:
                files, offsets, lengths = zip(*places, strict=True)
                columns = [*batch.columns[:3], pa.array(files), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "digest", "file", "offset", "length"])
        if stream is not None:
            stream.close()

    return stored(records.select("page_id", "url", "digest", "n_bytes", "record_type", "refers_to", "html").mapInArrow(run, INDEX), "warc-index")


def _parse(data: bytes) -> tuple:
    raw = zlib.decompress(data, wbits=31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    number = lambda k: int(fields[k]) if k in fields else None
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "revisit":
        digest, n = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex(), number("X-Payload-Length")
    else:
        digest, n = hashlib.sha1(payload).hexdigest(), len(payload)
    return number("X-Page-Id"), n, digest, fields["WARC-Type"], number("X-Refers-To-Page"), payload


def read_records(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records that ``index`` (or any selection of its rows) names, read back from the archives.

    Ranges are dealt out by (file, offset), sorted, and neighbours read in one request of at most ``REQUEST`` bytes (or one record).
    """
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, name, f = pafs.FileSystem.from_uri(folder)[0], None, None
        for batch in batches:
            places = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
            k = 0
            while k < len(places):
                file, start, length = places[k]
                end, n = start + length, k + 1
                while n < len(places) and places[n][0] == file and places[n][1] - end <= GAP and places[n][1] + places[n][2] - start <= REQUEST:
                    end, n = max(end, places[n][1] + places[n][2]), n + 1
                if file != name:
                    if f is not None:
                        f.close()
                    name, f = file, fs.open_input_file(file)
                data = f.read_at(end - start, start)
                columns = list(zip(*(_parse(data[o - start : o - start + size]) for _, o, size in places[k:n]), strict=True))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 6 if with_payload else 5]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: len(kinds)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], names=names)
                k = n
        if f is not None:
            f.close()

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if with_payload else "")
    places = index.select("file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return places.mapInArrow(run, schema)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write all ``pages`` as WARC, then read every record back: one row per page. Extra columns are ignored."""
    folder = scratch_dir(pages.sparkSession, "warc")
    return read_records(write_archives(plan_records(pages), folder), folder)
