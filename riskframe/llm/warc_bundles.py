"""WARC archives as seekable Zstandard bundles.

An archive is a sequence of independent Zstandard frames, each a group of whole
WARC records, then a skippable frame with the record map (record id -> frame,
offset in the frame, length) and the seek table of the seekable format (the
compressed and plain size of every frame, footer last).  Any Zstandard tool
decompresses the whole; with map and table one frame is enough for a record.

Tasks write archives of bounded size from the rows they scan; payloads are
shuffled only if the table of repeated payloads is too large to broadcast.
Files go through Spark's text writer, one row a file: the row is the archive
without its last four bytes, and the row end the writer adds is those bytes (the
magic number every seek table ends with).  So archives land in any store Spark
writes to, under its commit protocol, with no file opened by Python.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.common import shared_table

#: Plain bytes of a frame and of an archive before the next one starts.
FRAME_BYTES, ARCHIVE_BYTES, LEVEL = 1 << 18, 1 << 26, 3
#: Payloads from this size on are stored once.
REVISIT_BYTES = 1000

# Fixed values of the seekable format and of WARC 1.1.
SEEK_MAGIC, MAP_MAGIC, END_MAGIC = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEME, NO_ID = "urn:x-record:", "urn:x-no-record-id"

RECORD = ("record_id string, url string, record_type string, payload_digest string, payload_bytes long, "
          "refers_to string, payload binary")
PLACE = ("record_id string, record_type string, file string, frame_offset long, frame_bytes long, offset long, "
         "length long")


# ------------------------------------------------------------------ records
def uri_of(key: str | None) -> str:
    """A record id as a URI; ``key_of`` gives it back."""
    return NO_ID if key is None else SCHEME + quote(key, safe="", errors="surrogatepass")


def key_of(uri: str) -> str | None:
    return unquote_to_bytes(uri[len(SCHEME):]).decode("utf-8", "surrogatepass") if uri.startswith(SCHEME) else None


def record(kind: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One WARC record; headers without a value are left out."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers if v is not None),
             f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("ascii") + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(key, url, payload: bytes, digest: str, refers_to, revisit: bool, date: str) -> bytes:
    """A response with its payload, or a revisit with the HTTP header alone
    (whose Content-Length is that of the payload)."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    # the address as a URI: what it may not hold is percent-encoded
    target = None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~", errors="surrogatepass")
    told = [("WARC-Record-ID", f"<{uri_of(key)}>"), ("WARC-Target-URI", target), ("WARC-Date", date),
            ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
            ("WARC-Profile", PROFILE if revisit else None),
            ("WARC-Refers-To", f"<{uri_of(refers_to)}>" if revisit else None),
            ("Content-Type", "application/http; msgtype=response")]
    return record("revisit" if revisit else "response", told, http if revisit else http + payload)


def parse_record(data: bytes, at: int) -> tuple[dict, memoryview, int]:
    """``(headers, block, next place)`` of the record that starts at ``at``."""
    stop = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:stop].decode("ascii").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record at {at}")
    headers = dict(line.split(": ", 1) for line in lines)
    start = stop + 4
    end = start + int(headers["Content-Length"])
    if data[end:end + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} does not end at its length")
    return headers, memoryview(data)[start:end], end + 4


def page_of(headers: dict, block: memoryview) -> dict:
    """The page of a response or revisit; a stored payload must match its digest."""
    block = bytes(block)
    stop = block.index(b"\r\n\r\n")
    http = dict(line.split(b": ", 1) for line in block[:stop].split(b"\r\n")[1:])
    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    revisit = headers["WARC-Type"] == "revisit"
    payload, size = None if revisit else block[stop + 4:], int(http[b"Content-Length"])
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {headers['WARC-Record-ID']} does not match its digest")
    return {"record_id": key_of(headers["WARC-Record-ID"][1:-1]), "url": headers.get("WARC-Target-URI"),
            "record_type": headers["WARC-Type"], "payload_digest": digest, "payload_bytes": size,
            "refers_to": key_of(headers["WARC-Refers-To"][1:-1]) if revisit else None, "payload": payload}


# ------------------------------------------------------------------ archives
class Archive:
    """An archive in the making: frames so far, the open frame, the record map."""

    def __init__(self, name: str, date: str, frame_bytes: int):
        import zstandard
        self.zstd, self.frame_bytes = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True), frame_bytes
        self.frames, self.sizes, self.map, self.open, self.plain = [], [], [], bytearray(), 0
        info = record("warcinfo", [("WARC-Record-ID", f"<urn:x-archive:{name}>"), ("WARC-Date", date),
                                   ("Content-Type", "application/warc-fields")],
                      b"format: WARC File Format 1.1\r\n")
        self.open += info
        self.close_frame()

    def add(self, key: str | None, kind: str, data: bytes) -> None:
        """``data`` whole into one frame: the open one, or the next if it would burst."""
        if self.open and len(self.open) + len(data) > self.frame_bytes:
            self.close_frame()
        self.map.append((key, kind, len(self.frames), len(self.open), len(data)))
        self.open += data

    def close_frame(self) -> None:
        if self.open:
            self.frames.append(self.zstd.compress(bytes(self.open)))
            self.sizes.append((len(self.frames[-1]), len(self.open)))
            self.plain += len(self.open)
            self.open = bytearray()

    def finish(self) -> bytes:
        self.close_frame()
        told = self.zstd.compress(json.dumps(self.map, separators=(",", ":")).encode())
        self.frames.append(struct.pack("<II", MAP_MAGIC, len(told)) + told)
        self.sizes.append((len(self.frames[-1]), 0))
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        self.frames.append(struct.pack("<II", SEEK_MAGIC, len(entries) + 9) + entries
                           + struct.pack("<IBI", len(self.sizes), 0, END_MAGIC))
        return b"".join(self.frames)


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """``(offset, compressed, plain)`` per frame, read from the end of an archive."""
    count, flags, magic = struct.unpack("<IBI", data[-9:])
    width = 12 if flags & 0x80 else 8                # with or without a checksum per frame
    start = len(data) - 9 - count * width
    if magic != END_MAGIC or struct.unpack("<II", data[start - 8:start]) != (SEEK_MAGIC, count * width + 9):
        raise ValueError("no seek table at the end of the archive")
    out, at = [], 0
    for i in range(count):
        packed, plain = struct.unpack_from("<II", data, start + i * width)
        out.append((at, packed, plain))
        at += packed
    if at != start - 8:
        raise ValueError("the seek table does not cover the archive")
    return out


def plain_frame(data: bytes, frame: tuple[int, int, int]) -> bytes:
    import zstandard
    at, packed, plain = frame
    return zstandard.ZstdDecompressor().decompress(data[at:at + packed], max_output_size=plain)


def record_map(data: bytes) -> list[dict]:
    """The record map of an archive, in terms of file and frame offsets."""
    import zstandard
    frames = seek_table(data)
    at, packed, _ = frames[-1]
    if struct.unpack("<II", data[at:at + 8]) != (MAP_MAGIC, packed - 8):
        raise ValueError("no record map before the seek table")
    rows = json.loads(zstandard.ZstdDecompressor().decompressobj().decompress(data[at + 8:at + packed]))
    return [{"record_id": key, "record_type": kind, "frame_offset": frames[f][0], "frame_bytes": frames[f][1],
             "offset": offset, "length": length} for key, kind, f, offset, length in rows]


# ------------------------------------------------------------------ Spark
def page_rows(pages: DataFrame, id_col: str, url_col: str, payload_col: str, revisit_bytes: int) -> DataFrame:
    """``key, url, payload, digest, refers_to, revisit`` per row of ``pages``.

    Payloads are compared by SHA-256.  Of the rows with one payload of
    ``revisit_bytes`` and more, those with the largest id are responses (rows
    that repeat it are, each), the others revisit it; NULL ids come last, and
    if all are NULL, all are responses."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("same", F.when(F.octet_length("payload") >= revisit_bytes, F.sha2("payload", 256)))
    # written, so that its size is known: only repeated payloads, no row for the others
    heads = shared_table(rows.where(F.col("same").isNotNull()).groupBy("same").agg(
        F.count("*").alias("n"), F.max("id").alias("head")).where("n > 1").select("same", "head"), "repeated-payloads")
    revisit = F.col("head").isNotNull() & ~F.col("id").eqNullSafe(F.col("head"))
    return rows.join(heads, "same", "left").select(
        F.col("id").cast("string").alias("key"), "url", "payload", F.sha1("payload").alias("digest"),
        F.col("head").cast("string").alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", revisit_bytes: int = REVISIT_BYTES, frame_bytes: int = FRAME_BYTES,
                   archive_bytes: int = ARCHIVE_BYTES, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a WARC record per row of ``pages`` into archives under ``path``.

    NULL payloads are empty, a NULL address has no header, NULL ids a fixed
    URI; ids of any type are kept as text.  An empty table writes no archive.
    Every record carries ``date`` (WARC asks for one; pages have none)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task, count, archive = TaskContext.get().partitionId(), 0, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([archive.finish()[:-4]], pa.binary())], ["archive"])

        for batch in batches:
            for i in range(batch.num_rows):
                key, url, payload, digest, refers_to, revisit = (c[i].as_py() for c in batch.columns)
                if archive is None:
                    archive, count = Archive(f"{task}-{count}", date, frame_bytes), count + 1
                archive.add(key, "revisit" if revisit else "response",
                            page_record(key, url, payload, digest, refers_to, revisit, date))
                if archive.plain + len(archive.open) >= archive_bytes:
                    yield done()
                    archive = None
        if archive:
            yield done()

    rows = page_rows(pages, id_col, url_col, payload_col, revisit_bytes).mapInArrow(pack, "archive binary")
    end = struct.pack("<I", END_MAGIC).decode("latin-1")
    (rows.select(F.col("archive").cast("string")).write.option("maxRecordsPerFile", 1).option("compression", "none")
     .option("encoding", "ISO-8859-1").option("lineSep", end).text(path))


def _archives(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return files.where(F.col("length") > 0).select("path", "content")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every page of the archives under ``path``: ``record_id, url, record_type,
    payload_digest, payload_bytes, refers_to, payload`` (NULL in revisits).
    Frames are decompressed one at a time; stored payloads are checked."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    schema = to_arrow_schema(_parse_datatype_string(RECORD))

    def run(batches):
        for batch in batches:
            for content in batch.column(1):
                data = content.as_py()
                for frame in seek_table(data):
                    plain, at, rows = plain_frame(data, frame) if frame[2] else b"", 0, []
                    while at < len(plain):
                        headers, block, at = parse_record(plain, at)
                        if headers["WARC-Type"] != "warcinfo":
                            rows.append(page_of(headers, block))
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return _archives(spark, path).mapInArrow(run, RECORD)


def archive_index(spark: SparkSession, path: str) -> DataFrame:
    """Where every record lies: ``record_id, record_type, file, frame_offset,
    frame_bytes, offset, length``, from the archives' own record maps."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    schema = to_arrow_schema(_parse_datatype_string(PLACE))

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = [r | {"file": file} for r in record_map(content.as_py())]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return _archives(spark, path).mapInArrow(run, PLACE)


def fetch_record(spark: SparkSession, place) -> dict:
    """The page at one row of ``archive_index``: reads that frame alone."""
    import zstandard
    jvm = spark._jvm
    file = jvm.org.apache.hadoop.fs.Path(place["file"])
    stream = file.getFileSystem(spark._jsc.hadoopConfiguration()).open(file)
    try:
        stream.seek(place["frame_offset"])
        packed = bytes(stream.readNBytes(place["frame_bytes"]))
    finally:
        stream.close()
    plain = zstandard.ZstdDecompressor().decompress(packed)
    headers, block, _ = parse_record(plain, place["offset"])
    return page_of(headers, block)


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, h, strlen(h) AS n, CASE WHEN strlen(h) >= 1000 THEN max(page_id) OVER (PARTITION BY h) END AS head
      FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN head IS NOT NULL AND page_id IS DISTINCT FROM head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN head IS NOT NULL AND page_id IS DISTINCT FROM head THEN head END AS refers_to
FROM s
"""
