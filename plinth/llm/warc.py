"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

Each record is a gzip member of its own. Of records with equal payloads one is a
response and the others are revisits that refer to it. The reader takes archives of
gzip members with any number of records, and plain ones, as streams: a member may be
larger than memory, a record is held only as far as its payload is wanted. It checks
headers, lengths, digests and each member's CRC. After a failed check it searches on,
byte by byte, for the next version line (inside a member, too) or gzip magic from which
a whole record reads well; what lies between is quarantined and logged as a gap with
its place and reason. Records before a damage stay, also those in the same member, if
their own digest or the member's CRC vouches for them.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import column, map_arrow, shared_dir, stored, utf8

MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:page:"
#: An archive is closed at this size; a header (a long address, say) has this many bytes at most; payloads beyond this are checked but not returned.
ARCHIVE_BYTES, HEADER_BYTES, PAYLOAD_BYTES = 64 << 20, 256 << 20, 1 << 30
#: Bytes that are read, or unpacked, at once; bytes behind the reader that it needn't read again to go back.
_PIECE, _BACK = 1 << 16, 8 << 20


class Record(NamedTuple):
    """One record: payload is None for revisits, which have its size and digest only.

    ``offset`` and ``length``: its member, or the plain record, in the archive; of a member's
    records the last one carries the length, the others have 0, as do those of a damaged
    member. ``inner`` and ``inner_length``: its bytes in what the member unpacks to.
    """

    offset: int
    length: int
    inner: int | None
    inner_length: int | None
    kind: str
    record_id: str
    refers_to: str | None
    uri: str | None
    payload: bytes | None
    payload_bytes: int | None
    payload_digest: str | None


class Gap(NamedTuple):
    """Bytes that are quarantined: of the archive, or with ``inner`` of what the member at ``offset`` unpacks to."""

    offset: int
    length: int
    inner: int | None
    inner_length: int | None
    reason: str


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def compose(kind: str, record_id: str, date: str, payload: bytes, uri: str | None = None, refers_to: str | None = None) -> bytes:
    """A response or revisit record of an HTML payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date)]
    if uri is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f<>]", lambda m: quote(m[0]), uri)))
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    head += [
        ("WARC-Payload-Digest", f"sha1:{digest32(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest32(block)}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress(record) + pack.flush()


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines) if k}


def _sha1(value: str | None) -> str | None:
    return value[5:].upper() if value and value[:5].lower() == "sha1:" else None


class _Stream:
    """Bytes by their places, read on from a source that can start anew at any place."""

    def __init__(self, source):
        self.source = source  # place -> a function that reads some bytes from there on, b"" at the end
        self.data, self.base, self.read, self.ended = bytearray(), 0, source(0), False

    def at(self, place: int, n: int) -> bytes:
        """n bytes from a place on; fewer at the end."""
        if place < self.base:
            self.data, self.base, self.read, self.ended = bytearray(), place, self.source(place), False
        while self.base + len(self.data) < place + n and not self.ended:
            more = self.read()
            self.ended = not more
            self.data += more
            behind = min(place, self.base + len(self.data)) - self.base - _BACK
            if behind > _BACK:
                del self.data[:behind]
                self.base += behind
        start = place - self.base
        return bytes(self.data[start : start + n])

    def find(self, marks: tuple[bytes, ...], place: int) -> int | None:
        """The first place from ``place`` on where one of the marks stands."""
        most = max(map(len, marks)) - 1
        while True:
            piece = self.at(place, _PIECE + most)
            hits = [i for i in map(piece.find, marks) if i >= 0]
            if hits:
                return place + min(hits)
            if len(piece) < _PIECE + most:
                return None
            place += _PIECE


class _Member:
    """A gzip member of an archive as a source of unpacked bytes; ``fault`` and ``end`` are known once it is read to its end."""

    def __init__(self, packed: _Stream, start: int):
        self.packed, self.start, self.end, self.fault = packed, start, None, None

    def source(self, place: int):
        pieces = self._pieces()
        left = place

        def read() -> bytes:
            nonlocal left
            for piece in pieces:
                skipped = min(left, len(piece))
                left -= skipped
                if len(piece) > skipped:
                    return piece[skipped:]
            return b""

        return read

    def _pieces(self) -> Iterator[bytes]:
        unpack, at = zlib.decompressobj(31), self.start
        while not unpack.eof:
            piece = self.packed.at(at, _PIECE)
            if not piece:
                self.fault = "the member is cut short"
                return
            before = unpack.copy()
            try:
                out = unpack.decompress(piece)
            except zlib.error:
                self.fault = "the member doesn't unpack or fails its CRC"
                yield from self._until_fault(before, piece)
                return
            at += len(piece) - len(unpack.unused_data)
            if unpack.eof:
                self.end = at
            yield out

    @staticmethod
    def _until_fault(unpack, piece: bytes) -> Iterator[bytes]:
        """What unpacks before the damage."""
        for k in range(len(piece)):
            try:
                out = unpack.decompress(piece[k : k + 1])
            except zlib.error:
                return
            if out:
                yield out

    def sound(self) -> bool:
        """Whether all of the member unpacks and its CRC holds: read through once more for a record without a digest."""
        if self.fault is None and self.end is None:
            for _ in self._pieces():
                pass
        return self.fault is None


def _header(stream: _Stream, at: int) -> tuple[bytes, int]:
    """A record's header from its version line on, and the place of its block."""
    size = 1 << 12
    while True:
        head = stream.at(at, size)
        if head[: len(VERSION)] != VERSION:
            raise ValueError("no version line")
        end = head.find(b"\r\n\r\n")
        known = head[: end if end >= 0 else max(0, head.rfind(b"\r\n"))]
        if re.search(rb"WARC/1\.\d\r\n", known[len(VERSION) :]):
            raise ValueError("another record begins inside the header")
        if any(b":" not in line for line in known.split(b"\r\n")[1:]):
            raise ValueError("a header line is no field")
        if end >= 0:
            return head[:end], at + end + 4
        if len(head) < size or size > HEADER_BYTES:
            raise ValueError("no end of the header")
        size *= 2


def read_record(stream: _Stream, at: int, payloads: bool = True, vouched=lambda: True, most: int | None = None) -> tuple[Record, int]:
    """The plain record at a place and the place after it; ValueError if it doesn't hold.

    ``vouched`` is asked about a record without a digest of its own; ``most`` is how many bytes there are, if known.
    """
    head, place = _header(stream, at)
    field = _fields(head)
    told = field.get("content-length", "")
    if not (told.isascii() and told.isdigit()) or "warc-type" not in field:
        raise ValueError("a header field is missing")
    size, kind = int(told), field["warc-type"].lower()
    if most is not None and place + size + 4 > most:
        raise ValueError("the block is cut short or overrun")
    is_http = "application/http" in field.get("content-type", "")
    whole, body, n = hashlib.sha1(), hashlib.sha1(), 0
    http, kept = b"" if is_http else None, [] if payloads and size <= PAYLOAD_BYTES else None
    mark, done = not is_http, 0
    while done < size:
        piece = stream.at(place + done, min(_PIECE, size - done))
        if not piece:
            raise ValueError("the block is cut short or overrun")
        whole.update(piece)
        done += len(piece)
        if not is_http:
            continue
        if not mark:
            http += piece
            end = http.find(b"\r\n\r\n", max(0, len(http) - len(piece) - 3))
            if end < 0:
                if len(http) > HEADER_BYTES:
                    break
                continue
            http, piece, mark = http[:end], http[end + 4 :], True
        if kind == "response":
            body.update(piece)
            n += len(piece)
            if kept is not None:
                kept.append(piece)
    if done == size and stream.at(place + size, 4) != b"\r\n\r\n":
        raise ValueError("the block is cut short or overrun")
    said = _sha1(field.get("warc-block-digest"))
    digests = [base64.b32encode(h.digest()).decode() for h in (whole, body)]
    if said and said != digests[0]:
        raise ValueError("the block digest differs")
    if not mark:
        raise ValueError("no end of the HTTP header")
    payload, length, digest = None, None, _sha1(field.get("warc-payload-digest"))
    if is_http and kind == "response":
        if digest and digest != digests[1]:
            raise ValueError("the payload digest differs")
        said = said or digest
        payload, length, digest = b"".join(kept) if kept is not None else None, n, digests[1]
    elif is_http:
        told = _fields(http).get("content-length", "")
        length = int(told) if told.isascii() and told.isdigit() else None
    if not said and not vouched():
        raise ValueError("a record without a digest in a damaged member")
    refers = field.get("warc-refers-to")
    stop = place + size + 4
    return Record(at, stop - at, None, None, kind, field.get("warc-record-id", "").strip("<>"), refers.strip("<>") if refers else None, field.get("warc-target-uri"), payload, length, digest), stop


class Salvage:
    """Records and gaps of an archive, in order. ``file`` can be read and sought; what is held doesn't grow with its size."""

    def __init__(self, file, payloads: bool = True):
        self.file, self.payloads = file, payloads
        self.size = file.seek(0, 2)
        self.stream = _Stream(self._source)

    def _source(self, place: int):
        at = place

        def read() -> bytes:
            nonlocal at
            self.file.seek(at)
            piece = self.file.read(4 * _PIECE)
            at += len(piece)
            return piece

        return read

    def _inside(self, member: _Member) -> Iterator[Record | Gap]:
        """Records and gaps of what a member unpacks to."""
        stream, at, gap = _Stream(member.source), 0, None
        while stream.at(at, 1):
            try:
                record, after = read_record(stream, at, self.payloads, member.sound)
            except ValueError as e:
                gap = gap or (at, str(e))
                after = stream.find((VERSION,), at + 1)
                if after is None:
                    after = stream.base + len(stream.data)
            else:
                if gap:
                    yield Gap(member.start, 0, gap[0], at - gap[0], gap[1])
                    gap = None
                yield record._replace(offset=member.start, length=0, inner=at, inner_length=after - at)
            at = after
        if gap:
            yield Gap(member.start, 0, gap[0], at - gap[0], gap[1])

    def __iter__(self) -> Iterator[Record | Gap]:
        stream, at, gap = self.stream, 0, None
        while head := stream.at(at, len(VERSION)):
            after, reason, last, held, member = None, "neither a member nor a version line", None, [], None
            if head[:3] == MAGIC:
                member = _Member(stream, at)
                found = self._inside(member)
            else:
                found = iter(())
                try:
                    if head == VERSION:
                        last, after = read_record(stream, at, self.payloads, most=self.size)
                except ValueError as e:
                    reason = str(e)
            for x in found:
                if last is None and isinstance(x, Gap):
                    held.append(x)  # before the first record; if there is none, the whole member is a gap
                    continue
                if last is None and gap:
                    yield Gap(gap[0], at - gap[0], None, None, gap[1])
                    gap = None
                if last is not None:
                    yield last
                yield from held
                held, last = [], x
            if member:
                after = member.end if member.fault is None else None
                reason = member.fault or (held[0].reason if held else "")
                if after is not None and last is not None:
                    last = last._replace(length=after - at)
            if last is not None:
                if gap:
                    yield Gap(gap[0], at - gap[0], None, None, gap[1])
                    gap = None
                yield last
            if after is None or (last is None and reason):
                gap = gap or (at, reason)
            if after is None:  # the member's end is not known, nor is a plain record's
                after = stream.find((MAGIC, VERSION), at + 1)
            at = self.size if after is None else after
        if gap:
            yield Gap(gap[0], at - gap[0], None, None, gap[1])


def _writer(folder: str, date: str):
    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        made, out, name, n, size = [], None, "", 0, 0
        for batch in batches:
            for page, url, payload, other in zip(*(column(batch, c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                if out is None:  # a name of its own for each attempt: only those that a finished task returns are read
                    name, n, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    store.create_dir(root)
                    out = store.open_output_stream(f"{root}/{name.rpartition('/')[2]}", compression=None)
                kind = "response" if other is None else "revisit"
                data = member(compose(kind, ID + quote(page, safe=""), date, payload, url, None if other is None else ID + quote(other, safe="")))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    made.append((name, n, size))
                    out = None
        if out is not None:
            out.close()
            made.append((name, n, size))
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())], names=["path", "n_records", "n_bytes"])

    return run


def write_archives(pages: DataFrame, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", folder: str | None = None) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html); returns path, n_records, n_bytes of each archive.

    The payload is the html in UTF-8; null is empty. Of records with equal payloads of at
    least ``min_bytes`` bytes, that with the largest page_id is the response (of rows that
    share it, the one read last; null ids rank lowest) and the others revisit it; smaller
    payloads are all responses. A null url leaves the target out; a null page_id is
    written as "null". Other columns are not read. Archives go to ``folder``, by default a
    new one in shared storage; a failed task leaves files that nothing lists. An empty
    table writes none. ``pages`` must be a stored table: its rows are numbered in two reads.
    """
    spark = pages.sparkSession
    folder = folder or shared_dir(spark, "archives")
    rows = pages.select("page_id", "url", utf8("html").alias("payload"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("same", F.unhex(F.sha2("payload", 256)))
    first = rows.where(F.octet_length("payload") >= min_bytes).groupBy("same").agg(F.max(F.struct(F.col("page_id").isNotNull().alias("is"), "page_id", "row")).alias("kept"))
    told = rows.join(first, "same", "left").select(
        F.coalesce(F.col("page_id").cast("string"), F.lit("null")).alias("page_id"),
        "url",
        "payload",
        F.when(F.col("kept.row") != F.col("row"), F.coalesce(F.col("kept.page_id").cast("string"), F.lit("null"))).alias("refers_to"),
    )
    return stored(map_arrow(told, _writer(folder, date), "path string, n_records long, n_bytes long"), "manifest")


_READ = pa.schema(
    [("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("inner", pa.int64()), ("inner_length", pa.int64()), ("gap", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("uri", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
)


def _reader(payloads: bool):
    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for path in column(batch, "path").to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as source:
                    out, size = [], 0
                    for x in Salvage(source, payloads):
                        if isinstance(x, Gap):
                            out.append((path, *x, *[None] * 7))
                        else:
                            out.append((path, *x[:4], None, *x[4:]))
                            size += len(x.payload or b"")
                        if len(out) >= 4096 or size > 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _READ, strict=True)], schema=_READ)
                            out, size = [], 0
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _READ, strict=True)], schema=_READ)

    return run


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """What the archives in column ``path`` hold: a row for each record and for each gap.

    path, offset and length (of the gzip member, or plain record, in the archive; of a
    member's rows the last carries its length, the others 0), inner and inner_length (the
    place in what the member unpacks to; null for plain records and gaps of the archive),
    gap (the reason why these bytes are quarantined; null for records), record_type,
    record_id, refers_to, uri, payload (null for revisits, beyond PAYLOAD_BYTES, or without
    ``payloads``), payload_bytes and payload_digest (of the full payload, also for
    revisits). Members and records of any size are read. A member that is damaged keeps
    the records before the damage that a digest vouches for; its gap reaches from the
    member's first byte to the next place that reads well. Archives are one task's work
    each; the same path twice is read twice, a null path or a file that can't be opened
    fails, and no paths give no rows.
    """
    spark = archives.sparkSession
    n = min(max(archives.count(), 1), 100 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = "path string, offset long, length long, inner long, inner_length long, gap string, record_type string, record_id string, refers_to string, uri string, payload binary, payload_bytes long, payload_digest string"
    return map_arrow(archives.select("path").repartition(n), _reader(payloads), kind)


def page_of(record_id):
    """The page id (a string column) in a column of record ids."""
    return F.url_decode(F.substring_index(record_id, ID, -1))
