"""WARC archives: a writer, and a sequential reader that verifies what it reads.

Each record is a gzip member of its own.  The reader takes an archive as a stream: zlib inflates a
block at a time, the header ends at an empty line, Content-Length says how much follows, and digests
are checked against the bytes.  Memory is bounded by one record's payload.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir

READ_BYTES = 1 << 16
#: Payloads below this many bytes are never revisits.
LEAST_BYTES = 1000
FIELDS = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, payload binary"


def _b32(sha1_hex: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _hex(labelled: str) -> str:
    return base64.b32decode(labelled.removeprefix("sha1:")).hex()


def _clean(value: str) -> str:
    """Header values hold no line breaks."""
    return " ".join(value.split()) if value.isprintable() else "".join(c if c.isprintable() else "%{:02X}".format(ord(c)) for c in value)


def _urn(page_id: str) -> str:
    """An id as part of a header value, whatever characters it has."""
    return f"<urn:page:{quote(page_id, safe='')}>"


def record(page_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One gzip member; a revisit names the record it repeats and has no payload of its own."""
    body = payload if refers_to is None else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_clean(url or '')}",
        f"WARC-Payload-Digest: {_b32(digest)}",
        f"WARC-Block-Digest: {_b32(hashlib.sha1(body).hexdigest())}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n") + packer.compress(body) + packer.compress(b"\r\n\r\n") + packer.flush()


class BadArchive(ValueError):
    """The archive's bytes don't hold what its headers say."""


def members(chunks: Iterable[bytes]) -> Iterator[Iterator[bytes]]:
    """The inflated pieces of each gzip member in turn; each must be used up before the next."""
    source = iter(chunks)
    left = b""
    while True:
        while not left:
            left = next(source, None)
            if left is None:
                return
        z = zlib.decompressobj(31)

        def pieces(z=z):
            nonlocal left
            while not z.eof:
                given = left or next(source, b"")
                piece = z.decompress(given, READ_BYTES)
                left = z.unused_data if z.eof else z.unconsumed_tail
                if piece:
                    yield piece
                elif not given and not z.eof:
                    raise BadArchive("the archive ends inside a record")

        yield pieces()


def read_records(chunks: Iterable[bytes]) -> Iterator[dict]:
    """The records of an archive, framed by Content-Length, their digests verified."""
    for pieces in members(chunks):
        buffer = bytearray()
        try:
            while (end := buffer.find(b"\r\n\r\n")) < 0:
                buffer += next(pieces)
        except StopIteration:
            raise BadArchive("a record has no end of header") from None
        lines = bytes(buffer[:end]).decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise BadArchive(f"not a record: {lines[0][:40]}")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        size = int(head["Content-Length"])
        block = bytearray(buffer[end + 4 :])
        for piece in pieces:
            block += piece
            if len(block) > size + 4:
                raise BadArchive("a record is longer than its Content-Length")
        if len(block) != size + 4 or block[size:] != b"\r\n\r\n":
            raise BadArchive("a record is not as long as its Content-Length")
        body = bytes(block[:size])
        digest = hashlib.sha1(body).hexdigest()
        kind = head["WARC-Type"]
        if digest != _hex(head["WARC-Block-Digest"]) or kind == "response" and digest != _hex(head["WARC-Payload-Digest"]):
            raise BadArchive(f"{head['WARC-Record-ID']}: the digest differs")
        page = lambda x: unquote(x.removeprefix("<urn:page:").removesuffix(">"))
        yield {
            "page_id": page(head["WARC-Record-ID"]),
            "payload_bytes": int(head["X-Payload-Length"]),
            "payload_digest": _hex(head["WARC-Payload-Digest"]),
            "record_type": kind,
            "refers_to": page(head["WARC-Refers-To"]) if kind == "revisit" else None,
            "url": head["WARC-Target-URI"],
            "payload": body if kind == "response" else None,
        }


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def with_revisits(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, payload_digest and refers_to (null for responses)."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    link = F.col(url).cast("string") if url in pages.columns else F.lit(None).cast("string")
    p = pages.select(F.col(page_id).alias("page_id"), link.alias("url"), payload.alias("payload")).withColumn("payload_digest", F.sha1("payload"))
    # small payloads are never revisits, so they stay out of the join, where all empty ones would meet in one task
    small = p.filter(F.octet_length("payload") < least_bytes).withColumn("refers_to", F.lit(None).cast(pages.schema[page_id].dataType))
    p = p.filter(F.octet_length("payload") >= least_bytes)
    first = p.groupBy(F.col("payload_digest").alias("d")).agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
    first = first.filter("n > 1").drop("n").hint("shuffle_hash")
    p = p.join(first, F.col("payload_digest") == F.col("d"), "left")
    # of rows that repeat the largest page_id, all are responses
    other = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return p.select("page_id", "url", "payload", "payload_digest", F.when(other, F.col("keeper")).alias("refers_to")).unionByName(small)


def write_archives(pages: DataFrame, folder: str, *, archive_bytes: int = 64 << 20, **columns) -> DataFrame:
    """Write a record per row to archives below folder; returns path, records and bytes of each.

    An archive is written under a name of its own attempt, so a task that runs twice leaves an extra
    file that the returned list doesn't name.  A null html is an empty payload; a null page_id is
    written as an empty id.
    """

    def work(batches):
        import uuid

        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        out, path, n, size = None, "", 0, 0
        listed = []

        def close():
            nonlocal out, n, size
            if out is not None:
                out.close()
                listed.append((path, n, size))
            out, n, size = None, 0, 0

        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    path = f"{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(f"{base}/{path}", compression=None)
                ident = "" if r["page_id"] is None else str(r["page_id"])
                got = record(ident, r["url"], r["payload"], r["payload_digest"], None if r["refers_to"] is None else str(r["refers_to"]))
                out.write(got)
                n += 1
                size += len(got)
                if size >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_pydict({"path": [x for x, _, _ in listed], "records": [n for _, n, _ in listed], "bytes": [s for _, _, s in listed]}, schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return cut(with_revisits(pages, **columns).mapInArrow(work, "path string, records long, bytes long"))


def read_archives(spark: SparkSession, folder: str, archives: DataFrame, *, payload: bool = True) -> DataFrame:
    """All records of the listed archives, read in sequence and verified; a bad one fails the job."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"] + ["payload"] * payload
    schema = ", ".join(x for x in FIELDS.split(", ") if x.split()[0] in names)
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}

    def work(batches):
        fs, base = _open(folder)
        for b in batches:
            for path, expected in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held, size, n = [], 0, 0
                with fs.open_input_stream(f"{base}/{path}", compression=None) as f:
                    for r in read_records(iter(lambda f=f: f.read(READ_BYTES), b"")):
                        n += 1
                        held.append(r)
                        size += len(r["payload"] or b"") if payload else 100
                        if size > 4 << 20:
                            yield batch(held)
                            held, size = [], 0
                if n != expected:
                    raise BadArchive(f"{path}: {n} records, not {expected}")
                yield batch(held)

    def batch(held):
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in held], kinds.get(c, pa.string())) for c in names], names=names)

    spread = archives.select("path", "records").repartition(max(1, spark.sparkContext.defaultParallelism))
    return spread.mapInArrow(work, schema)


def round_trip(pages: DataFrame, *, folder: str | None = None, page_id: str = "page_id", **options) -> DataFrame:
    """Write pages to archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    One row per row of pages, whatever repeats; ids have their own type again (an id that was null
    comes back null unless ids are strings).  An empty table writes no archive and gives no rows.
    """
    import uuid

    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    archives = write_archives(pages, folder, page_id=page_id, **options)
    kind = pages.schema[page_id].dataType
    back = read_archives(spark, folder, archives, payload=False)
    typed = lambda c: F.when(F.col(c) != "", F.col(c)).cast(kind)
    return back.select(typed("page_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", typed("refers_to").alias("refers_to"))
