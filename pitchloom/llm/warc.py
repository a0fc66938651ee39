"""WARC archives compressed with Zstandard: one frame a record, and a dictionary in front.

An archive is a skippable frame that holds the dictionary, then one frame for each record, each with
a dictionary reference. Spark's text writer puts the frames down through its commit protocol, so a
lost executor leaves no half archive and any file system will do; its line separator is an empty
skippable frame, which readers pass over. The reader loads the dictionary, decodes frame by frame
and checks headers and lengths.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from pitchloom.runtime import checkpoint_dir, staged

# Fixed values of the format: the magic numbers of the dictionary's frame, of plain skippable frames
# (the last four bits are free) and of compressed frames.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE_MAGIC = 0x184D2A50
FRAME_MAGIC = 0xFD2FB528
# An empty skippable frame, which stands between records.
SEPARATOR = struct.pack("<II", SKIPPABLE_MAGIC, 0)
# Pages from which the dictionary is trained, at most: rows, and bytes of each.
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 16_384, 65_536
LEVEL = 3
# Payloads under this many bytes are stored every time they come.
LEAST_REVISIT_BYTES = 0
# Bytes of payload that are aimed at in one archive.
ARCHIVE_BYTES = 48 << 20
DATE = "2024-01-01T00:00:00Z"
CHUNK = 1 << 16


def train_dictionary(pages: DataFrame, digests: DataFrame | None = None) -> bytes:
    """A dictionary from a bounded sample of pages, chosen by a hash of id and payload; empty if too few.

    The hash below which the sample lies comes from the small table of digests, so only the sampled
    pages' first bytes leave a task.
    """
    digests = page_digests(pages) if digests is None else digests
    order = F.xxhash64("page_id", "_sha1")
    # Three times the rows wanted lie below this share of all hashes.
    share = min(1.0, 3.0 * SAMPLE_ROWS / max(1, digests.count()))
    below = int(-(1 << 63) + share * ((1 << 64) - 1)) if share < 1 else (1 << 63) - 1
    limit = (
        digests.select(order.alias("h")).where(F.col("h") <= below).orderBy("h").limit(SAMPLE_ROWS)
        .agg(F.max("h")).first()[0]
    )
    if limit is None:
        return b""
    sample = (
        _keyed(pages).where(order <= limit)
        .select(F.encode(F.substring("html", 1, SAMPLE_BYTES), "utf-8").alias("part"))
        .limit(SAMPLE_ROWS).collect()
    )
    parts = [bytes(row["part"]) for row in sample if row["part"]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC record. A revisit has the response's HTTP header, but not its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    revisit = refers_to is not None
    block = http.encode() + (b"" if revisit else payload)
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{url}:{digest}")
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {_header_value(url)}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _header_value(url) -> str:
    """A header is one line: line ends in an address are written as %0D and %0A."""
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def parse_record(data: bytes) -> dict:
    """Fields of one record; raises ValueError if a header, length or digest does not hold."""
    head, split, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not split or first != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(": "), "") for line in lines)
    for name in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "WARC-Payload-Digest"):
        if not headers.get(name):
            raise ValueError(f"header {name} is missing")
    length = int(headers["Content-Length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("the block's length is not its Content-Length")
    http, split, payload = rest[:length].partition(b"\r\n\r\n")
    sizes = [int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = headers["WARC-Type"]
    if not split or len(sizes) != 1 or kind not in ("response", "revisit"):
        raise ValueError("not an HTTP response or revisit")
    if kind == "response" and (len(payload) != sizes[0] or digest != payload_digest(payload)):
        raise ValueError("the payload does not match its length or digest")
    refers = headers.get("WARC-Refers-To", "").removeprefix("<urn:page:").removesuffix(">")
    if (kind == "revisit") != bool(refers) or (kind == "revisit" and payload):
        raise ValueError("a revisit names its response and has no payload")
    return {
        "page_id": int(headers["X-Page-Id"]) if headers.get("X-Page-Id") else None,
        "url": headers.get("WARC-Target-URI"), "payload_bytes": sizes[0], "payload_digest": digest,
        "record_type": kind, "refers_to": int(refers) if refers else None, "payload": payload,
    }


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def records(archive: bytes):
    """(offset, record bytes) of an archive, frame by frame; raises ValueError if it is damaged."""
    view, at, decoder = memoryview(archive), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        if len(view) - at < 8:
            raise ValueError("the archive ends within a frame")
        magic, size = struct.unpack_from("<II", view, at)
        if magic & 0xFFFFFFF0 == SKIPPABLE_MAGIC:
            if at + 8 + size > len(view):
                raise ValueError("the archive ends within a frame")
            if magic == DICTIONARY_MAGIC and at == 0 and size:
                content = bytes(view[8:8 + size])
                if content[:4] == struct.pack("<I", FRAME_MAGIC):
                    content = zstandard.ZstdDecompressor().decompress(content)
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise ValueError("not a Zstandard frame")
        frame, parts, end = decoder.decompressobj(), [], at
        while not frame.eof:
            if end >= len(view):
                raise ValueError("the archive ends within a frame")
            parts.append(frame.decompress(view[end:end + CHUNK]))
            end = min(len(view), end + CHUNK)
        yield at, b"".join(parts)
        at = end - len(frame.unused_data)


def _keyed(pages: DataFrame) -> DataFrame:
    """page_id, url and html (null: empty) with the payload's digest and a key of id and digest."""
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn(
        "_sha1", F.sha1(F.encode("html", "utf-8"))
    ).withColumn("_key", F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "_sha1"))


def page_digests(pages: DataFrame) -> DataFrame:
    """(page_id, _sha1, _key, _bytes) of every page, written out: all that is decided on."""
    return staged(_keyed(pages).select("page_id", "_sha1", "_key", F.octet_length("html").alias("_bytes")))


def plan_records(pages: DataFrame, least_revisit_bytes: int = LEAST_REVISIT_BYTES,
                 partitions: int | None = None, digests: DataFrame | None = None) -> DataFrame:
    """``pages`` (page_id, url, html) with refers_to, which is null for responses.

    Of equal payloads of at least so many bytes the one with the largest page_id is the response.
    Rows that repeat the largest page_id are all responses, as are equal payloads of null ids only.
    Revisits are found on ids and digests; the payloads then move once, to the partition of their
    id and digest, so a payload that very many pages share is spread.
    """
    digests = page_digests(pages) if digests is None else digests
    firsts = digests.groupBy("_sha1").agg(F.max("page_id").alias("_first"))
    # A null id is never the largest, so it is a revisit where any other page has the payload.
    again = (F.col("_bytes") >= least_revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("_first"))
    revisits = (
        digests.dropDuplicates(["_key"]).join(firsts, "_sha1").where(again)
        .select("_key", F.col("_first").alias("refers_to"))
    )
    rows = _keyed(pages).drop("_sha1")
    dealt = rows.repartition(partitions, "_key") if partitions else rows.repartition("_key")
    return dealt.join(revisits.hint("shuffle_hash"), "_key", "left").select("page_id", "url", "html", "refers_to")


def write_archives(pages: DataFrame, path: str, least_revisit_bytes: int = LEAST_REVISIT_BYTES,
                   archive_bytes: int = ARCHIVE_BYTES, date: str = DATE) -> None:
    """Write ``pages`` as archives below ``path``; each task writes one archive, frame by frame."""
    spark = pages.sparkSession
    digests = page_digests(pages)
    dictionary = train_dictionary(pages, digests)
    total = digests.agg(F.sum("_bytes")).first()[0] or 0
    partitions = max(spark.sparkContext.defaultParallelism, -(-total // archive_bytes))

    def frames(batches):
        extra = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, **extra)
        yield _batch([struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary])
        for batch in batches:
            held, size = [], 0
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                payload = html.encode("utf-8", "surrogatepass")
                record = _record(page_id, url, payload, payload_digest(payload), refers_to, date)
                held.append(packer.compress(record))
                size += len(held[-1])
                if size > 4 << 20:
                    yield _batch(held)
                    held, size = [], 0
            if held:
                yield _batch(held)

    def _batch(values):
        return pa.RecordBatch.from_arrays([pa.array(values, pa.binary())], names=["value"])

    planned = plan_records(pages, least_revisit_bytes, partitions, digests)
    (
        planned.mapInArrow(frames, "value binary").select(F.col("value").cast("string"))
        .write.option("lineSep", SEPARATOR.decode("latin-1")).option("compression", "none").text(path)
    )


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives below ``path``, checked; a damaged archive raises."""
    schema = (
        "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, "
        "refers_to bigint, url string, archive string, archive_offset bigint"
        + (", payload binary" if with_payload else "")
    )
    names = [part.split()[0] for part in schema.split(", ")]

    def read(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                held = []
                for at, data in records(content.as_buffer()):
                    held.append(parse_record(data) | {"archive": name, "archive_offset": at})
                    if len(held) == 1_000:
                        yield _rows(held)
                        held = []
                if held:
                    yield _rows(held)

    def _rows(held):
        texts = {"payload_digest", "record_type", "url", "archive"}
        return pa.RecordBatch.from_arrays([
            pa.array([h[n] for h in held],
                     pa.string() if n in texts else pa.binary() if n == "payload" else pa.int64())
            for n in names], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(read, schema)


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back, and return what they hold."""
    path = f"{checkpoint_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
