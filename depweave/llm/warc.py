"""WARC archives of web pages: written by tasks, read back one record after the other.

An archive is a file of gzip members, one for each record (WARC/1.1). Of pages with equal payloads that of the smallest
page_id is a ``response``; others are ``revisit`` records (identical payload digest), which hold its HTTP header only.
The reader never has a whole archive in memory: it inflates it piece by piece, ends a record where its Content-Length
says and a member where the gzip stream ends, and checks block and payload digests.

Archives go to the folder that driver and executors share, by the file systems that Arrow knows. A task that is run again
writes new files; only files of tasks that ended are listed and read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.llm.bloom import blocks_for, bloom, marked
from depweave.llm.memory import let_go
from depweave.llm.store import new_path, save
from depweave.operators.spread import spread_join

#: Fixed values of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_WINDOW = 31  # zlib's code for a gzip member


@dataclass(frozen=True)
class Archives:
    """``file_bytes``: an archive is closed once it has so many. ``date``: the records' date, for it isn't read from the
    clock. ``least``: payloads of fewer bytes never become revisits. ``step``: bytes that are read and inflated at
    once. ``most_header``: a longer record header is a fault."""

    file_bytes: int = 64 << 20
    date: str = "2000-01-01T00:00:00Z"
    least: int = 0
    level: int = 6
    step: int = 1 << 16
    most_header: int = 1 << 20


def _digest(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def _uri(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes | None, how: Archives, length: int = 0, digest: str = "", refers_to: int | None = None) -> bytes:
    """One gzip member: a response with its payload or, with ``payload`` None, a revisit of the page ``refers_to``."""
    revisit = payload is None
    length, digest = (length, digest) if revisit else (len(payload), _digest(payload))
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode() + (payload or b"")
    # Header lines end at a line end, so a url's own are coded as in URLs.
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uri(page_id)}", f"WARC-Date: {how.date}", *([f"WARC-Target-URI: {target}"] if target else [])]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{_digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_uri(refers_to)}"]
    packer = zlib.compressobj(how.level, zlib.DEFLATED, _WINDOW)
    return packer.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


class Fault(ValueError):
    """An archive isn't what it should be; says where."""


@dataclass
class Record:
    """A record as read: its header fields (names in lower case), where its member begins, sizes and digests."""

    header: dict[str, str]
    offset: int
    block_bytes: int = 0
    block_digest: str = ""
    payload_bytes: int = 0
    payload_digest: str = ""
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes | None = None


class _Inflated:
    """Bytes of one archive, a gzip member after the other, without the whole of it in memory."""

    def __init__(self, source, step: int):
        self.source, self.step, self.raw, self.at, self.held = source, step, b"", 0, b""
        self.member, self.ended = None, True

    def begin(self) -> bool:
        """The next member; False at the end of the file."""
        self.raw = self.raw or self.source.read(self.step)
        if not self.raw:
            return False
        self.member, self.ended = zlib.decompressobj(_WINDOW), False
        return True

    def more(self) -> bytes:
        """Some bytes, empty at the member's end."""
        while not self.ended:
            piece = self.raw or self.source.read(self.step)
            if not piece:
                raise Fault(f"the file ends inside the member at {self.at}")
            try:
                out = self.member.decompress(piece, self.step)
            except zlib.error as e:
                raise Fault(f"no gzip member at {self.at}: {e}") from None
            self.raw = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
            self.at += len(piece) - len(self.raw)
            self.ended = self.member.eof
            if out:
                return out
        return b""

    def until(self, mark: bytes, most: int, offset: int) -> bytes:
        """Bytes up to and with the mark."""
        while (end := self.held.find(mark)) < 0:
            if len(self.held) > most:
                raise Fault(f"a header of over {most} bytes at {offset}")
            got = self.more()
            if not got:
                raise Fault(f"no header's end in the record at {offset}")
            self.held += got
        if end > most:
            raise Fault(f"a header of over {most} bytes at {offset}")
        out, self.held = self.held[: end + len(mark)], self.held[end + len(mark) :]
        return out

    def exactly(self, n: int, offset: int) -> Iterator[bytes]:
        """So many bytes, in pieces."""
        while n:
            got = self.held or self.more()
            if not got:
                raise Fault(f"{n} bytes lack in the record at {offset}")
            part, self.held = got[:n], got[n:]
            n -= len(part)
            yield part


def _fields(lines: list[bytes]) -> dict[str, str]:
    pairs = (x.split(b":", 1) for x in lines if b":" in x)
    return {name.strip().decode("utf-8", "replace").lower(): value.strip().decode("utf-8", "replace") for name, value in pairs}


def read_records(source, how: Archives | None = None, payloads: bool = False) -> Iterator[Record]:
    """The records of an open archive, in order. Digests are checked where they are given; what isn't as it should be is a
    ``Fault``. ``payloads``: records carry their payloads, else only one piece of them is held at a time."""
    how = how or Archives()
    stream = _Inflated(source, how.step)
    while stream.begin():
        offset = stream.at
        head = stream.until(b"\r\n\r\n", how.most_header, offset).split(b"\r\n")
        if not head[0].startswith(b"WARC/"):
            raise Fault(f"no WARC record at {offset}")
        own = Record(_fields(head[1:]), offset)
        try:
            own.block_bytes = int(own.header["content-length"])
        except (KeyError, ValueError):
            raise Fault(f"no Content-Length in the record at {offset}") from None
        block, payload, http, kept = hashlib.sha1(), hashlib.sha1(), b"", []
        inside = not own.header.get("content-type", "").startswith("application/http")  # else after the HTTP header
        for part in stream.exactly(own.block_bytes, offset):
            block.update(part)
            if not inside:
                http += part
                if (end := http.find(b"\r\n\r\n")) < 0:
                    if len(http) > how.most_header:
                        raise Fault(f"an HTTP header of over {how.most_header} bytes at {offset}")
                    continue
                own.http, part, inside = _fields(http[:end].split(b"\r\n")[1:]), http[end + 4 :], True
            payload.update(part)
            own.payload_bytes += len(part)
            if payloads:
                kept.append(part)
        rest = b"".join(stream.exactly(4, offset))
        if rest != b"\r\n\r\n" or stream.held or stream.more():
            raise Fault(f"the record at {offset} doesn't end with its Content-Length")
        own.block_digest, own.payload_digest = (base64.b32encode(x.digest()).decode() for x in (block, payload))
        revisit = own.header.get("warc-type") == "revisit"
        for name, found in (("warc-block-digest", own.block_digest), *((("warc-payload-digest", own.payload_digest),) if not revisit else ())):
            given = own.header.get(name, "")
            if given.startswith("sha1:") and given[5:] != found:
                raise Fault(f"{name} of the record at {offset} is {given[5:]}, its bytes give {found}")
        own.payload = b"".join(kept) if payloads else None
        yield own


def _open(path: str):
    return pafs.FileSystem.from_uri(path)


def write_archives(rows: DataFrame, folder: str, how: Archives) -> DataFrame:
    """path, records, bytes of the archives that tasks write of ``rows``: page_id, url, payload (binary; null: a revisit),
    length, digest, refers_to. ``folder`` is a URI that all executors reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        out, path, n, size, done = None, "", 0, 0, []
        try:
            for batch in batches:
                for values in zip(*batch.columns, strict=True):
                    page_id, url, payload, length, digest, refers_to = (x.as_py() for x in values)
                    if out is None:
                        path = f"pages-{uuid.uuid4().hex}.warc.gz"
                        out, n, size = system.open_output_stream(f"{root}/{path}", compression=None), 0, 0
                    size += out.write(record(page_id, url, payload, how, length, digest, refers_to))
                    n += 1
                    if size >= how.file_bytes:
                        out.close()
                        out = done.append((f"{folder}/{path}", n, size))
        finally:
            if out is not None:
                out.close()
        if out is not None:
            done.append((f"{folder}/{path}", n, size))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])
        let_go()

    return save(rows.mapInArrow(run, "path string, records long, bytes long"), "warc-files")


_READ = "path string, offset long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def read_archives(files: DataFrame, how: Archives | None = None, payloads: bool = False) -> DataFrame:
    """A row for each response and revisit of the archives ``path``: path, offset, page_id, url, record_type,
    payload_bytes, payload_digest (bare base32 SHA-1), refers_to and, on request, payload (null for revisits). For a
    revisit, bytes and digest are those of the payload that it stands for. A broken archive fails with its place."""
    how = how or Archives()
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [*(x.split()[0] for x in _READ.split(", ")), "payload"]

    def page(uri: str) -> int | None:
        found = re.fullmatch(r"<urn:x-page:(-?\d+)>", uri)
        return int(found[1]) if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def batch_of() -> pa.RecordBatch:
            width = len(names) if payloads else len(names) - 1
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(width)], names=names[:width])

        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, at = _open(path)
                with system.open_input_stream(at, compression=None) as source:
                    for own in read_records(source, how, payloads):
                        kind = own.header.get("warc-type")
                        if kind not in ("response", "revisit"):
                            continue
                        again = kind == "revisit"
                        size = int(own.http.get("content-length", 0)) if again else own.payload_bytes
                        digest = own.header.get("warc-payload-digest", "").removeprefix("sha1:") if again else own.payload_digest
                        rows.append((path, own.offset, page(own.header.get("warc-record-id", "")), own.header.get("warc-target-uri"), kind, size, digest, page(own.header.get("warc-refers-to", "")), None if again else own.payload))
                        held += len(own.payload or b"") + 256
                        if held > 1 << 22:
                            yield batch_of()
                            rows, held = [], 0
        yield batch_of()
        let_go()

    # A task an archive; at most so many that the planner's rows stay few.
    n = max(1, min(files.count(), 1 << 14))
    return files.select("path").repartition(n, "path").mapInArrow(run, _READ + ", payload binary" * payloads)


def _base32(digest: Column) -> Column:
    """Base32 of 40 hexadecimal digits: each ten of them are eight signs of five bits."""
    sign = lambda group, i: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), 1, 32).substr((F.shiftright(group, 35 - 5 * i).bitwiseAND(31) + 1).cast("int"), F.lit(1))
    groups = [F.conv(F.substring(digest, 10 * g + 1, 10), 16, 10).cast("long") for g in range(4)]
    return F.concat(*(sign(group, i) for group in groups for i in range(8)))


def archive_pages(pages: DataFrame, how: Archives | None = None) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html) to the shared folder; path, records, bytes of the
    archives. Which payloads are equal comes from their digests; only payloads that occur more than once are shuffled.
    """
    how = how or Archives()
    payload = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    # Two hashes and the length: SHA-1 alone has known collisions.
    key = F.concat_ws(":", F.sha1("payload"), F.hex(F.xxhash64("payload")), F.octet_length("payload"))
    rows = rows.withColumn("key", F.when(F.octet_length("payload") >= how.least, key))
    seen = rows.where("key is not null").select("key", "page_id").groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    again = save(seen.where("n > 1").select("key", "first"), "warc-again")
    blocks = blocks_for(again.count())
    own, may = marked(rows, "key", bloom(again, "key", blocks), blocks)
    single = own.where(~F.col(may)).select(*rows.columns, F.lit(None).cast("long").alias("first"))
    several = own.where(F.col(may)).select(rows.columns)
    several = spread_join(several, again, "key", "left", counted=several.select("key")).select(single.columns)
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    # A revisit needs no payload.
    out = single.unionByName(several).select(
        "page_id",
        "url",
        F.when(~revisit, F.col("payload")).alias("payload"),
        F.octet_length("payload").cast("long").alias("length"),
        F.when(revisit, _base32(F.sha1("payload"))).otherwise("").alias("digest"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )
    return write_archives(out, new_path(pages.sparkSession, "warc"), how)


def page_archives(pages: DataFrame, how: Archives | None = None) -> DataFrame:
    """Write ``pages`` as WARC archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload, and empty ones are equal too; of equal payloads of at least ``least`` bytes the
    smallest page_id is the response. Rows that repeat it are responses as well; a null page_id is never the smallest
    unless all are null, and then all are responses. A null or odd url is written without, or coded. Payloads of any
    length are read in pieces; other columns, whatever their names, aren't read; an empty table gives an empty result.
    """
    files = archive_pages(pages, how)
    return read_archives(files, how).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def archived(spark: SparkSession, paths: list[str], how: Archives | None = None) -> DataFrame:
    """The records, with payloads, of archives anywhere that executors reach (URIs)."""
    return read_archives(spark.createDataFrame([(p,) for p in paths], "path string"), how, payloads=True)
