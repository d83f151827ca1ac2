"""Zstandard web archives: writer and reader (operator 9).

An archive is a leading skippable frame with the dictionary (where one could be
trained) and then one Zstandard frame for each WARC/1.1 record.  The reader loads
the dictionary, decodes frame by frame and checks the version line, the header
fields, the block length, the closing blank lines and both digests.

Of records with equal payloads of at least ``least_bytes`` the one with the
smallest page id is the response, the others revisit it and carry only the HTTP
head.  Which it is comes from one combined minimum by digest.

The dictionary is trained on at most ``SAMPLE_ROWS`` whole pages of at most
``SAMPLE_BYTES`` each; it changes sizes only, never contents.

Defined results: a null payload is empty; a null url is left out; rows that repeat
the smallest id of their payload are responses too; a null id revisits a known one; a very
long page is one frame; an empty table gives no archive and no records.  Extra columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.llm.storage import materialize, open_store, scratch

#: Fixed values of the formats.
DICTIONARY_MAGIC, SKIPPABLE_LOW, ZSTD_MAGIC = 0x184D2A5D, 0x184D2A50, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 300, 32 << 10, 32 << 10
CHUNK = 1 << 15
MANIFEST = "path string, records long"
RECORD = T.StructType(
    [T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("payload", T.BinaryType())]
)


def digest(data: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _id_of(urn: str | None) -> int | None:
    if urn is None or not (urn.startswith("<urn:page:") and urn.endswith(">")):
        return None
    return int(urn[10:-1]) if urn[10:-1] else None


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool) -> bytes:
    """One whole WARC record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(first)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """The fields of ``RECORD`` from one decoded frame; raises ValueError if it is not valid."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC version line")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"not a header field: {line!r}")
        fields[name.strip().lower()] = value.strip()
    kind = fields.get("warc-type")
    if kind is None or "warc-record-id" not in fields or "warc-date" not in fields:
        raise ValueError("a mandatory header field is missing")
    length = fields.get("content-length", "")
    if not length.isdigit() or len(rest) != int(length) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("the block is not as long as its header says")
    block = rest[:-4]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != "sha1:" + digest(block):
        raise ValueError("block digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    sizes = [v for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:]) if k.strip().lower() == b"content-length"]
    size = int(sizes[0]) if sizes else len(payload)
    said = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or (said and said != digest(payload))):
        raise ValueError("payload length or digest")
    return _id_of(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, size, said or digest(payload), _id_of(fields.get("warc-refers-to")), payload if kind == "response" else None


def _skippable(content: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content


def frames(stream) -> Iterator[bytes]:
    """The decoded frames of an archive, one for each record; holds one record at a time."""
    dictionary, buffer, first = None, b"", True
    while True:
        while len(buffer) < 8 and (more := stream.read(CHUNK)):
            buffer += more
        if not buffer:
            return
        if len(buffer) < 8:
            raise ValueError("the archive ends inside a frame")
        magic, size = struct.unpack_from("<II", buffer)
        if magic & 0xFFFFFFF0 == SKIPPABLE_LOW:
            while len(buffer) < 8 + size:
                if not (more := stream.read(CHUNK)):
                    raise ValueError("the archive ends inside a frame")
                buffer += more
            content, buffer = buffer[8 : 8 + size], buffer[8 + size :]
            if first and magic == DICTIONARY_MAGIC:
                if content[:4] == struct.pack("<I", ZSTD_MAGIC):
                    content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
                dictionary = zstandard.ZstdCompressionDict(content)
            first = False
            continue
        first = False
        unzip = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        out = []
        while not unzip.eof:
            if not buffer and not (buffer := stream.read(CHUNK)):
                raise ValueError("the archive ends inside a frame")
            out.append(unzip.decompress(buffer))
            buffer = unzip.unused_data if unzip.eof else b""
        yield b"".join(out)


def train(pages: DataFrame, payload: str = "html") -> bytes | None:
    """A dictionary from a bounded sample of whole pages; None if there is too little."""
    rows = pages.where(F.octet_length(payload).between(64, SAMPLE_BYTES)).select(payload).limit(SAMPLE_ROWS).collect()
    samples = [r[0].encode() for r in rows]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), samples).as_bytes() if len(samples) >= 16 else None
    except zstandard.ZstdError:
        return None


def write_archives(pages: DataFrame, least_bytes: int = 0, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write all pages as archives in the shared folder; returns the manifest (path, records).

    A task streams its rows into one file of its own name; only the manifest, which
    Spark's committer writes, says which files belong to the result.
    """
    folder = scratch(pages.sparkSession, "warc")
    dictionary = train(pages, payload)
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    copies = rows.where(F.octet_length("payload") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("sha").alias("copy"), "first")
    copies = materialize(copies, "warc-copies")
    rows = rows.join(copies, F.col("sha") == F.col("copy"), "left").select("page_id", "url", "payload", "first", F.expr("first is not null and not (page_id <=> first)").alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, count = None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if stream is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
                    store, name = open_store(path)
                    store.create_dir(name.rpartition("/")[0], recursive=True)
                    stream = store.open_output_stream(name)
                    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
                    pack = zstandard.ZstdCompressor(level=3, dict_data=shared, write_content_size=True)
                    if dictionary:
                        stream.write(_skippable(dictionary))
                stream.write(pack.compress(record(row["page_id"], row["url"], row["payload"].encode(), row["first"], row["revisit"])))
                count += 1
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64())], names=["path", "records"])

    return materialize(rows.mapInArrow(run, MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """The records of all archives, one task an archive; ``payload`` drops or keeps the bodies."""
    schema = RECORD if payload else T.StructType(RECORD.fields[:-1])
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()][: len(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, records in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
                store, name = open_store(path)
                held, weight, seen = [], 0, 0
                with store.open_input_stream(name) as stream:
                    for data in frames(stream):
                        held.append(parse(data)[: len(schema)])
                        weight, seen = weight + (len(data) if payload else 200), seen + 1
                        if weight > 1 << 22:
                            yield _batch(held, kinds, schema.names)
                            held, weight = [], 0
                if seen != records:
                    raise ValueError(f"{path} holds {seen} of {records} records")
                if held:
                    yield _batch(held, kinds, schema.names)

    return manifest.repartition(max(1, manifest.count())).mapInArrow(run, schema)


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
