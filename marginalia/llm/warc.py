"""WARC archives compressed record by record with a dictionary of their own.

An archive begins with a skippable Zstandard frame that holds the dictionary; each record follows as a frame
of its own, compressed with that dictionary, so any record can be read by its offset. Tasks write whole
archives of bounded size to storage that all executors share, under a temporary name until they are
complete, so that a task that runs again leaves no half archive.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved

#: Magic number of the skippable frame that holds an archive's dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes | None, size: int, digest: str, refers_to=None) -> bytes:
    """One WARC record: a response with its payload, or a revisit that names the response it repeats."""
    body = HTTP_HEAD + (payload or b"") if refers_to is None else HTTP_HEAD
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    head += [f"Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record; raises ValueError if its lengths don't agree."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode().split("\r\n")
    head = dict(line.split(": ", 1) for line in lines[1:])
    body = data[end + 4 : -4]
    if len(body) != int(head["Content-Length"]) or not data.endswith(b"\r\n\r\n"):
        raise ValueError(f"truncated record {head.get('WARC-Record-ID')}")
    return head, body[body.index(b"\r\n\r\n") + 4 :]


def _page(record_id: str) -> int | None:
    """The page_id in a record id; that of a page without one is empty."""
    return int(record_id[10:-1]) if len(record_id) > 11 else None


def train_dictionary(samples: list[bytes], size: int = 65536) -> bytes:
    """A dictionary of at most ``size`` bytes; samples too few to train on serve as raw content themselves."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class ArchiveWriter:
    """Archives in memory: a dictionary frame, then a frame for each record."""

    def __init__(self, dictionary: bytes, level: int = 3):
        self._dictionary = dictionary
        made = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self._compress = zstandard.ZstdCompressor(level=level, dict_data=made, write_checksum=True).compress
        self.start()

    def start(self) -> None:
        packed = zstandard.ZstdCompressor(level=19).compress(self._dictionary) if self._dictionary else b""
        self._parts = [struct.pack("<II", DICTIONARY_MAGIC, len(packed)), packed]
        self.size, self.records = len(packed) + 8, 0

    def add(self, data: bytes) -> None:
        frame = self._compress(data)
        self._parts.append(frame)
        self.size += len(frame)
        self.records += 1

    def take(self) -> bytes:
        out = b"".join(self._parts)
        self.start()
        return out


def read_archive(data: bytes):
    """Yields (headers, payload) of every record of an archive, with the dictionary it carries."""
    magic, length = struct.unpack_from("<II", data)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame at the start")
    packed = data[8 : 8 + length]
    dictionary = zstandard.ZstdDecompressor().decompress(packed) if packed else b""
    made = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    decompressor = zstandard.ZstdDecompressor(dict_data=made)
    view, at = memoryview(data), 8 + length
    while at < len(view):
        frame, parts, step = decompressor.decompressobj(), [], 4096
        # A frame is fed in growing pieces: what it leaves of the last one is all that is ever copied.
        while not frame.eof:
            if at >= len(view):
                raise ValueError("truncated frame")
            parts.append(frame.decompress(view[at : at + step]))
            at, step = min(at + step, len(view)), min(2 * step, 1 << 20)
        at -= len(frame.unused_data)
        yield parse_record(b"".join(parts))


def _put(uri: str, data: bytes) -> None:
    """Write under a temporary name, then rename: readers see whole archives only."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    folder = path.rpartition("/")[0]
    store.create_dir(folder, recursive=True)
    part = f"{folder}/_{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, path)


def record_types(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, sha1, refers_to): one row for every row of ``pages(page_id, url, html)``.

    Of the records with equal payloads, the one with the largest page_id is the response and the others
    refer to it. Null html is an empty payload. A row with a null id is a revisit if a row with an id has its
    payload, else a response; rows that repeat an id with its payload are responses or revisits alike. Other
    columns are ignored.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))
    # Responses are settled on digests alone. Only payloads that occur more than once have revisits, so the
    # join's other side is small, and pages stay where they are if it is small enough to be broadcast.
    per = rows.select("page_id", "sha1").groupBy("sha1").agg(F.count("*").alias("n"), F.max("page_id").alias("response"))
    repeated = saved(per.where("n > 1 and response is not null").select("sha1", "response"), "repeated-payloads")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    return rows.join(repeated, "sha1", "left").select(
        "page_id", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), "payload_bytes", "sha1", refers.alias("refers_to")
    )


def sample_records(pages: DataFrame, max_samples: int = 1000, max_bytes: int = 32768) -> list[bytes]:
    """Records to train on: the ``max_samples`` smallest hashes of page_id among payloads of 1 to ``max_bytes``."""
    usable = pages.where((F.octet_length("html") <= max_bytes) & (F.octet_length("html") > 0) & F.col("page_id").isNotNull())
    # Every task sends its own candidates for the smallest hashes, so only ids are ranked.
    ids = usable.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(max_samples)
    rows = usable.join(F.broadcast(ids), "page_id").dropDuplicates(["page_id"]).select(
        "page_id", "url", F.encode("html", "UTF-8").alias("payload")
    )
    return [record(r[0], r[1], bytes(r[2]), len(r[2]), payload_digest(bytes(r[2]))) for r in rows.collect()]


def write_archives(
    pages: DataFrame, folder: str, dictionary: bytes, archive_bytes: int = 16 << 20
) -> DataFrame:
    """Write all pages under ``folder`` (any URI that pyarrow.fs opens on every executor).

    Returns (archive, records, bytes), one row for each archive; an archive is closed once it exceeds
    ``archive_bytes``. The archives are written when the result is evaluated. Every row has a record, whatever
    is null in it (see ``record_types``); an empty table gives no archive.
    """
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    shared = pages.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches):
        writer = ArchiveWriter(shared.value)
        done = []

        def close():
            name = f"pages-{uuid.uuid4().hex}.warc.zst"
            count, size = writer.records, writer.size
            _put(f"{uri}/{name}", writer.take())
            done.append((name, count, size))

        for batch in batches:
            for page_id, url, payload, size, sha1, refers in zip(*(c.to_pylist() for c in batch.columns)):
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                writer.add(record(page_id, url, payload, size, digest, refers))
                if writer.size > archive_bytes:
                    close()
        if writer.records:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["archive", "records", "bytes"])

    return record_types(pages).mapInArrow(run, "archive string, records long, bytes long")


def read_archives(spark: SparkSession, folder: str, names: DataFrame | None = None) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of every record.

    ``names`` restricts the archives to those of a write's report, so that archives left by tasks that ran
    twice count once. The payload of a response is checked against its length and digest.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    files = files.select(F.substring_index("path", "/", -1).alias("archive"), "content")
    if names is not None:
        files = files.join(names.select("archive"), "archive", "left_semi")
    fields = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                rows, held = [], 0
                for head, payload in read_archive(data.as_py()):
                    kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(head["X-Payload-Length"])
                    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
                        raise ValueError(f"damaged payload of {head['WARC-Record-ID']}")
                    refers = head.get("WARC-Refers-To")
                    rows.append((_page(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), size, digest, kind, refers and _page(refers), payload if kind == "response" else None))
                    held += len(payload)
                    if len(rows) >= 2000 or held > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return files.select("content").mapInArrow(run, fields)
