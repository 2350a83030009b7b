"""WARC: archives whose records are compressed one by one with a shared Zstandard dictionary.

Layout of an archive: a skippable frame (magic 0x184D2A5D) that holds the dictionary, then one Zstandard
frame per WARC record.  Any record can be read alone, given the dictionary at the front.  The dictionary
is trained on a bounded sample of the records as they are archived, headers included: the ``sample`` records
whose page id has the smallest md5, of those with payloads of 64 to 65,536 bytes; others are archived but not sampled.

Records with equal payloads of at least ``min_bytes`` bytes: the one with the largest page id is the
response, the others are revisits that refer to it and carry no payload.  Smaller payloads are all
responses.  A null page id is smaller than any; among rows of one page id and payload all are alike, and
where only null ids share a payload all are responses.  A null payload is empty; a null URL leaves the
target header out.

Archives are rows of a Parquet table in the shared folder (name, content), so any store Spark writes to
holds them and lost tasks are written again; ``content`` is the file, byte by byte.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import md5_sample, written

#: The skippable frame's magic number for dictionaries and the record date and profile.
SKIPPABLE = 0x184D2A5D
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Compressed bytes a reader takes at a time; what it took beyond a record's end is taken again for the next.
CHUNK = 2048


def digest32(payload: bytes) -> str:
    """SHA-1 in bare upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def train(samples: list[bytes], size: int = 32_768) -> bytes:
    """A dictionary of at most ``size`` bytes; too few samples to train on are joined and taken as they are."""
    try:
        return zstandard.train_dictionary(size, samples, threads=0).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if len(raw) >= 8 else None


def front(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary


def _one_line(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if c in "\r\n%" else c for c in value)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """A WARC record; with ``refers_to`` a revisit without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_one_line(url)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of one record; payload_bytes is the full payload's length, also of a revisit.

    Raises ValueError where lengths or a response's digest do not agree.
    """
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if not version.startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("WARC: malformed record")
    http, _, payload = block.partition(b"\r\n\r\n")
    full = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != full or digest32(payload) != digest):
        raise ValueError("WARC: payload does not match its digest")
    number = lambda name: int(v) if (v := fields[name][len("<urn:page:") : -1]) else None
    return {
        "page_id": number("WARC-Record-ID"),
        "url": fields.get("WARC-Target-URI"),
        "payload": payload,
        "payload_bytes": full,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": number("WARC-Refers-To") if "WARC-Refers-To" in fields else None,
    }


def read_archive(content: bytes) -> Iterator[dict]:
    """All records of an archive, in order, in time that grows with its size.  Raises ValueError where it is cut short."""
    magic, size = struct.unpack_from("<II", content)
    if magic != SKIPPABLE:
        raise ValueError("WARC: no dictionary frame")
    shared = _dictionary(content[8 : 8 + size])
    decompressor = zstandard.ZstdDecompressor(**({"dict_data": shared} if shared else {}))
    view, at = memoryview(content), 8 + size
    while at < len(view):
        one, parts = decompressor.decompressobj(), []
        while not one.eof:
            taken = view[at : at + CHUNK]
            if not len(taken):
                raise ValueError("WARC: archive ends inside a record")
            parts.append(one.decompress(taken))
            at += len(taken)
        at -= len(one.unused_data)
        yield parse(b"".join(parts))


def write_archives(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0,
    archive_bytes: int = 4_000_000, sample: int = 200, level: int = 3,
) -> DataFrame:
    """The archives of all pages: a written table (name, content) of files of about ``archive_bytes``."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    base = base.withColumn("sha", F.sha1("payload"))
    owners = (
        base.where(F.octet_length("payload") >= min_bytes)
        .groupBy("sha")
        .agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .select(F.col("sha").alias("_sha"), "owner")
    )
    owners = written(owners, "op7-owners")
    revisit = F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    records = base.join(owners, F.col("sha") == F.col("_sha"), "left").select("page_id", "url", "payload", F.when(revisit, F.col("owner")).alias("refers_to"))
    fitting = records.where(F.octet_length("payload").between(64, 65_536))
    taken = md5_sample(fitting, "page_id", sample, fitting.count()).collect()  # at most ``sample`` rows of 64 KiB
    dictionary = train([record(r.page_id, r.url, bytes(r.payload), digest32(bytes(r.payload)), r.refers_to) for r in taken])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = _dictionary(dictionary)
        compressor = zstandard.ZstdCompressor(level=level, **({"dict_data": shared} if shared else {}))
        part, number, frames, size = TaskContext.get().partitionId(), 0, [], 0

        def archive() -> pa.RecordBatch:
            name = f"part-{part:06d}-{number:05d}.warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join([front(dictionary), *frames])], pa.binary())], names=["name", "content"])

        for b in batches:
            for r in range(b.num_rows):
                page_id, url, raw, refers_to = (b.column(i)[r].as_py() for i in range(4))
                frames.append(compressor.compress(record(page_id, url, raw, digest32(raw), refers_to)))
                size += len(frames[-1])
                if size >= archive_bytes:
                    yield archive()
                    number, frames, size = number + 1, [], 0
        if frames:
            yield archive()

    return written(records.mapInArrow(write, "name string, content binary"), "op7-archives")


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """One row per record of the archives; ``payloads`` adds the payload (empty for revisits)."""
    columns = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
    columns |= {"payload": pa.binary()} if payloads else {}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                rows = []
                for fields in read_archive(content.as_py()):
                    rows.append(fields if payloads else {k: fields[k] for k in columns})
                    if len(rows) == 512:
                        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in columns.items()], names=list(columns))
                        rows = []
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in columns.items()], names=list(columns))

    names = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return archives.mapInArrow(read, ", ".join(f"{k} {names[t]}" for k, t in columns.items()))


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write the archives, read them back and describe every record."""
    rows = read_archives(write_archives(pages, id_col, url_col, html_col, min_bytes))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
