"""Legacy archive converter: ARC records to WARC records, with payload deduplication, files and a reader.

An ARC file starts with a version block that names the fields of its header lines; each record is one
such line, with a declared length, and so many bytes. A converted record gets the identifier, time,
type and digests that WARC wants. A WARC file holds a warcinfo record and then records up to a number of
bytes, each a gzip member of its own. Files are written by Spark's text sink, one row a file, so any file
system that Spark writes to will do; the sink's line separator is a gzip member of nothing.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.scratch import Scratch, small_or_shuffled
from foliant.llm.textbytes import trimmed

#: The header fields of the two versions of the format, as its specification lists them (fixed values).
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
#: Compressed bytes of a file; a larger record is alone in one.
FILE_BYTES = 32 << 20
LEVEL = 4
NOTHING = gzip.compress(b"", mtime=0)
BROADCAST_ROWS = 500_000


def arc_file(url: Column, html: Column, version: Column, date: Column) -> Column:
    """One ARC file of one record as binary; white space in the address is percent-encoded, a null one is `-`."""
    names = F.when(version == 1, F.lit(" ".join(FIELDS[1]))).otherwise(F.lit(" ".join(FIELDS[2])))
    info = F.concat(version.cast("string"), F.lit(" 0 Origin\n"), names, F.lit("\n"))
    body = F.coalesce(html.cast("binary"), F.lit(b""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.length(body).cast("string"), F.lit(END))
    size = (F.length(http) + F.length(body)).cast("string")
    address = F.regexp_replace(F.coalesce(F.when(F.length(url) > 0, url), F.lit("-")), r"[\x00-\x20\x7f]+", "%20")
    more = F.when(version == 1, F.lit("")).otherwise(F.lit("200 - - 0 page.arc "))
    head = F.concat(
        F.lit("filedesc://page.arc 0.0.0.0 "), date, F.lit(" text/plain "), F.when(version == 1, F.lit("")).otherwise(F.lit("200 - - 0 page.arc ")), F.length(info).cast("string"), F.lit("\n"), info, F.lit("\n"),
        address, F.lit(" 0.0.0.0 "), date, F.lit(" text/html "), more, size, F.lit("\n"), http,
    )
    return F.concat(head.cast("binary"), body, F.lit(b"\n"))


def inflate(content: bytes) -> bytes:
    """The content of one or more gzip members, or content itself if it isn't compressed."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        out.append(z.decompress(content) + z.flush())
        content = z.unused_data
    return b"".join(out)


def read_arc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and body of each record after the version block.

    Raises ValueError at a header that doesn't fit the fields or a length that the content lacks.
    """
    content, at, fields = inflate(content), 0, None
    while at < len(content):
        if content[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        stop = content.find(b"\n", at)
        line = content[at : stop if stop >= 0 else len(content)].decode("utf-8", "replace").rstrip("\r").split(" ")
        if fields is None:
            if not line[0].startswith("filedesc://"):
                raise ValueError("no version block")
        elif len(line) < len(fields):
            raise ValueError(f"{len(line)} header fields where {len(fields)} are declared")
        if not line[-1].isdigit() or stop < 0 or stop + 1 + int(line[-1]) > len(content):
            raise ValueError("bad record length")
        body = content[stop + 1 : stop + 1 + int(line[-1])]
        if fields is None:
            first, names = body.split(b"\n")[:2]
            fields = names.decode().split()
            if fields != FIELDS.get(int(first.split()[0])):
                raise ValueError("fields of an unknown version")
        else:
            extra = len(line) - len(fields)  # a media type may hold spaces
            values = [*line[:3], " ".join(line[3 : 4 + extra]), *line[4 + extra :]]
            yield dict(zip(fields, values, strict=True)), body
        at = stop + 1 + int(line[-1])


def payload_of(block: bytes) -> tuple[bytes, bytes]:
    """The HTTP head with its blank line, and what follows; a block without a head is all payload."""
    if block.startswith(b"HTTP/"):
        cut = block.find(b"\r\n\r\n")
        if cut >= 0:
            return block[: cut + 4], block[cut + 4 :]
    return b"", block


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(source: str, digest: str) -> str:
    """What a record's page and payload give; a revisit names its response by it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source}|{digest}')}>"


def warc_date(date: str) -> str:
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def synthesise(source: str, fields: dict[str, str], block: bytes, refers_to: dict | None) -> bytes:
    """The WARC record of an ARC record; a revisit of refers_to (source, url, date) keeps the HTTP head only."""
    head, payload = payload_of(block)
    kept, digest = block if refers_to is None else head, sha1(payload)
    name = record_id(source, digest) if refers_to is None else record_id(f"{source}|revisit", digest)
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name}",
        f"WARC-Date: {warc_date(fields['Archive-date'])}", f"WARC-Target-URI: {fields['URL']}", f"WARC-IP-Address: {fields['IP-address']}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1(kept)}", f"X-Source: {source or '-'}", f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines += [
            f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(str(refers_to['source']), digest)}", f"WARC-Refers-To-Target-URI: {refers_to['url']}",
            f"WARC-Refers-To-Date: {warc_date(refers_to['date'])}", f"X-Refers-To-Source: {refers_to['source']}",
        ]
    lines += [f"Content-Type: {'application/http; msgtype=response' if head else fields['Content-type']}", f"Content-Length: {len(kept)}"]
    return ("\r\n".join(lines) + END).encode() + kept + END.encode()


def warcinfo(first: bytes) -> bytes:
    """The record that begins a file, of a name made of its first record."""
    body = b"software: foliant\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {record_id('warcinfo', sha1(first))}", "WARC-Date: 2020-01-01T00:00:00Z", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return ("\r\n".join(lines) + END).encode() + body + END.encode()


def read_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record; raises ValueError where one is not well formed."""
    content, at = inflate(content), 0
    while at < len(content):
        stop = content.find(b"\r\n\r\n", at)
        lines = content[at:stop].decode("utf-8", "replace").split("\r\n")
        if stop < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        n = int(headers["Content-Length"])
        yield headers, content[stop + 4 : stop + 4 + n]
        at = stop + 4 + n + 4


def _digests(batches):
    """(source, content) of ARC files to (source, digest, n, url, date)."""
    kinds = {"source": pa.int64(), "digest": pa.string(), "n": pa.int64(), "url": pa.string(), "date": pa.string()}
    for batch in batches:
        rows = [(s.as_py(), sha1(p), len(p), f["URL"], f["Archive-date"]) for s, c in zip(batch.column(0), batch.column(1), strict=True) for f, b in read_arc(c.as_py()) for p in [payload_of(b)[1]]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], names=list(kinds))


def _convert(batches):
    """(source, content, refers_to) to whole WARC files."""
    held, n = [], 0
    sent = lambda held: pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["file"])
    for batch in batches:
        for source, content, refers in zip(*(batch.column(i) for i in range(3)), strict=True):
            for fields, block in read_arc(content.as_py()):
                record = synthesise("" if source.as_py() is None else str(source.as_py()), fields, block, refers.as_py())
                member = gzip.compress(record, LEVEL, mtime=0)
                if held and n + len(member) > FILE_BYTES:
                    yield sent(held)
                    held, n = [], 0
                if not held:
                    held.append(gzip.compress(warcinfo(record), LEVEL, mtime=0))
                held.append(member)
                n += len(member)
    if held:
        yield sent(held)


def _back(batches):
    """Contents of WARC files to one row a record; digests and lengths of responses are taken from their payload anew."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for h, block in read_warc(content.as_py()):
                if h["WARC-Type"] == "warcinfo":
                    continue
                source = None if h["X-Source"] == "-" else int(h["X-Source"])
                if h["WARC-Type"] == "response":
                    payload = payload_of(block)[1]
                    rows.append((source, len(payload), sha1(payload), "response", None))
                else:
                    rows.append((source, int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:"), "revisit", int(h["X-Refers-To-Source"])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def convert(arcs: DataFrame, least_bytes: int, scratch: Scratch) -> str:
    """Writes the WARC files of arcs (source long, content binary) and returns their folder.

    Of records with equal payloads of at least least_bytes, the one with the largest source is the response and the
    others revisit it. The digests travel, the payloads don't; what each revisit refers to is broadcast only while it is small.
    """
    digests = scratch.save(arcs.mapInArrow(trimmed(_digests), "source long, digest string, n long, url string, date string"), "digests")
    last = digests.where(F.col("n") >= least_bytes).groupBy("digest", "n").agg(F.max(F.struct("source", "url", "date")).alias("refers_to"), F.count("*").alias("c")).where("c > 1").drop("c")
    # tables of their own, so that a digest of very many pages is joined by broadcast or can be split
    last = small_or_shuffled(scratch.save(last, "last"), BROADCAST_ROWS)
    refers = digests.select("source", "digest", "n").join(last, ["digest", "n"]).where("source <> refers_to.source").groupBy("source").agg(F.first("refers_to").alias("refers_to"))
    refers = small_or_shuffled(scratch.save(refers, "refers"), BROADCAST_ROWS)
    files = arcs.join(refers, "source", "left").select("source", "content", "refers_to").mapInArrow(trimmed(_convert), "file binary")
    path = scratch.path("warc")
    with scratch.clean():
        files.select(F.col("file").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", NOTHING.decode("latin-1")).option("maxRecordsPerFile", 1).text(path)
    return path


def read_back(spark, path: str) -> DataFrame:
    """One row a record of the WARC files under path: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("content")
    return files.mapInArrow(trimmed(_back), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def pages_to_warc(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id") -> DataFrame:
    """Each page as an ARC file, in version 1 or 2 by turns, converted to WARC, written, and read back.

    Null html counts as empty; a null address becomes `-`. Ids have either sign. A page without an id is always a response
    and comes back without one. Ids are unique: rows that repeat one are judged together. Other columns are ignored. A very
    large page is a file of its own. No pages: no files and an empty result.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    arcs = pages.select(F.col(id_col).cast("long").alias("source"), arc_file(F.col("url"), F.col("html"), F.coalesce(F.pmod(F.col(id_col), F.lit(2)) + 1, F.lit(1)), F.lit("20200101000000")).alias("content"))
    return read_back(spark, convert(arcs, least_bytes, scratch))
