"""WARC archives in Zstandard: one frame per record, behind a skippable frame that holds the dictionary.

Files are written and read through pyarrow's file systems, so the shared folder may be local, S3, GCS or HDFS. A task
writes archives of bounded size under names that no other attempt has, and gives those names; so of a task that runs twice (again, or
speculatively) only the archives of the attempt whose rows Spark keeps are read, each with the records counted there.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialise, share_code, spread, table

#: Fixed values of the format: the magic of the dictionary's skippable frame, the protocol line, the revisit profile.
DICT_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
#: Uncompressed bytes of an archive at most (a longer record has one of its own), and of the sample its dictionary is fitted on.
ARCHIVE, SAMPLE, DICTIONARY = 32 << 20, 1 << 20, 32 << 10


class Malformed(ValueError):
    """An archive or a record that isn't as its headers say."""


def record(page_id, url, payload: bytes, digest: str, size: int, kind: str, refers_to, date: str) -> bytes:
    """A response or revisit record; a revisit has the HTTP headers alone in its block."""
    block = HTTP.format(size).encode() + (payload if kind == "response" else b"")
    sha1 = base64.b32encode(bytes.fromhex(digest)).decode()
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", "".join(url.split())))
    if kind == "revisit":
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    head += [("WARC-Payload-Digest", f"sha1:{sha1}"), ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """A whole archive. Too few records to fit a dictionary on have none."""
    sample, held = [], 0
    for r in records[:: max(1, len(records) // 256)]:
        if held < SAMPLE:
            sample.append(r[:16384])
            held += len(sample[-1])
    out, fitted = [], None
    if len(sample) >= 16:
        try:
            fitted = zstandard.train_dictionary(DICTIONARY, sample)
            packed = zstandard.ZstdCompressor(level=3).compress(fitted.as_bytes())
            out.append(struct.pack("<II", DICT_MAGIC, len(packed)) + packed)
        except zstandard.ZstdError:
            fitted = None
    c = zstandard.ZstdCompressor(level=3, dict_data=fitted, write_checksum=True)
    return b"".join(out + [c.compress(r) for r in records])


def frames(data: bytes):
    """The records of an archive, one per frame."""
    at, fitted = 0, None
    if len(data) >= 8:
        magic, size = struct.unpack_from("<II", data)
        if magic == DICT_MAGIC:
            if len(data) < 8 + size:
                raise Malformed("the dictionary's frame is cut off")
            held = data[8 : 8 + size]
            if held[:4] == struct.pack("<I", FRAME_MAGIC):
                held = zstandard.ZstdDecompressor().decompress(held)
            fitted, at = zstandard.ZstdCompressionDict(held), 8 + size
    d = zstandard.ZstdDecompressor(dict_data=fitted) if fitted else zstandard.ZstdDecompressor()
    while at < len(data):
        one, out, begin = d.decompressobj(), [], at
        try:
            while not one.eof and at < len(data):  # in small steps, since what is left behind a frame is copied
                out.append(one.decompress(data[at : at + 16384]))
                at = min(at + 16384, len(data)) - len(one.unused_data)
        except zstandard.ZstdError as e:
            raise Malformed(f"no frame at byte {begin}: {e}") from e
        if not one.eof:
            raise Malformed(f"the frame at byte {begin} is cut off")
        yield b"".join(out)


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """The headers of a record, those of its HTTP block, and the payload. Checks the version, both lengths and both digests."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not found or not first.startswith(b"WARC/1."):
        raise Malformed("no version line or no end of the headers")

    def fields(lines):
        out = {}
        for x in lines:
            k, colon, v = x.decode().partition(":")
            if not colon or not k.strip():
                raise Malformed(f"not a header: {x[:80]!r}")
            out[k.strip().lower()] = v.strip()
        return out

    named = fields(lines)
    for k in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if k not in named:
            raise Malformed(f"no {k}")
    if not named["content-length"].isdigit() or len(rest) != (n := int(named["content-length"])) + 4 or rest[n:] != b"\r\n\r\n":
        raise Malformed(f"a record of {len(rest)} bytes with content-length {named['content-length']}")
    block = rest[:n]
    told = lambda k, data: k not in named or named[k] == "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()
    if not told("warc-block-digest", block):
        raise Malformed("the block isn't what its digest says")
    http, found, payload = block.partition(b"\r\n\r\n")
    inside = fields(http.split(b"\r\n")[1:])
    if not found or not inside.get("content-length", "").isdigit():
        raise Malformed("no HTTP headers with a length")
    if named["warc-type"] == "revisit":
        if payload or "warc-refers-to" not in named:
            raise Malformed("a revisit with a payload, or of nothing")
    elif len(payload) != int(inside["content-length"]) or not told("warc-payload-digest", payload):
        raise Malformed("the payload isn't what its length or digest says")
    return named, inside, payload


def revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Adds payload, digest, size, kind and refers_to: of equal payloads of `least` bytes or more, that with the largest page_id is the response.

    Copies are counted before they meet: one row per payload and task reaches the aggregation, and the join back can split a payload that very many pages share.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    full = pages.select("page_id", "url", payload.alias("payload")).withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    keys = pages.select("page_id", payload.alias("payload")).select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    last = keys.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = F.col("last").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("last"))) & (F.col("size") >= least)
    return full.join(last, "digest", "left").select("page_id", "url", "payload", "digest", "size", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("last")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write what revisits() gives; path, records and bytes of each archive. Runs when the result is read."""
    share_code(records.sparkSession)

    def run(batches):
        from pyarrow.fs import FileSystem

        fs, base = FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        part, attempt, serial, held, size, done = TaskContext.get().partitionId(), uuid.uuid4().hex, 0, [], 0, []

        def flush():
            nonlocal serial, held, size
            if not held:
                return
            data, name = archive(held), f"{base}/part-{part:05d}-{serial:04d}-{attempt}.warc.zst"
            with fs.open_output_stream(f"{name}.tmp") as f:
                f.write(data)
            fs.move(f"{name}.tmp", name)  # whole or not at all
            done.append((name, len(held), len(data)))
            serial, held, size = serial + 1, [], 0

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                page_id, url, payload, digest, n, kind, refers_to = row
                if held and size + len(payload) > ARCHIVE:
                    flush()
                held.append(record(page_id, url, payload, digest, n, kind, refers_to, date))
                size += len(held[-1])
        flush()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    return records.mapInArrow(run, "path string, records long, bytes long")


def read_archives(archives: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives at column path, an archive a task: page_id, payload_bytes, payload_digest, record_type, refers_to (and url, payload)."""
    share_code(archives.sparkSession)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *["url", "payload"] * with_payload]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.string(), pa.binary()] * with_payload]

    def number(uri):
        text = uri.removeprefix("<urn:page:").removesuffix(">")
        return None if text == "None" else int(text)

    def run(batches):
        from pyarrow.fs import FileSystem

        fs, _ = FileSystem.from_uri(folder)
        for b in batches:
            for path, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with fs.open_input_file(path) as f:
                    data = f.read()
                rows, total = [], 0
                for raw in frames(data):
                    named, inside, payload = parse(raw)
                    digest = base64.b32decode(named["warc-payload-digest"].removeprefix("sha1:")).hex()
                    row = (number(named["warc-record-id"]), int(inside["content-length"]), digest, named["warc-type"], number(named["warc-refers-to"]) if "warc-refers-to" in named else None)
                    rows.append((*row, named.get("warc-target-uri"), payload) if with_payload else row)
                    total += 1
                if total != wanted:
                    raise Malformed(f"{path} has {total} records, not {wanted}")
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * with_payload
    paths = archives.select("path", "records")
    return paths.repartition(max(1, min(paths.count(), 10_000))).mapInArrow(run, schema)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null html is an empty payload. Rows that tie on payload and page_id are all responses. A null page_id is never the last of its group unless all are."""
    folder = fresh(spark, "warc")
    pages = spread(table(spark, sf_dir, "pages", "page_id", "url", "html"), "page_id")
    return read_archives(materialise(write_archives(revisits(pages), folder), "warc-index"), folder)
