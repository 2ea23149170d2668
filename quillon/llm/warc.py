"""WARC archives: one gzip member for each record, revisits for equal payloads, and a salvaging reader.

Writing goes through Spark's own text writer, so any file system will do: a record is a gzip
member, whose last byte is the high byte of its length, 0 below 16 MiB (larger ones are followed
by an empty member, which ends in 0 as well). That byte is the writer's line separator.

Reading: a record counts once its checks hold: version line, lengths, block digest and, of a
response, payload digest and length as computed from the payload read. Where one fails, the reader
searches for the next place at which a member, or within a member's bytes a version line, begins a
valid record, and goes on from there. A member that breaks off gives the records before the break
whose digests hold. The bytes between are logged as quarantined gaps, by their place in the file
or, within a member, by their place in its decoded bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

#: Payload bytes that one archive file is meant to hold. Its reader holds a file at a time.
FILE_BYTES = 24 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
#: Headers that every record has, and their form. Headers have no check of their own but a member's.
_MUST = {"warc-type": "[a-z]+", "warc-record-id": "<[^<>\\s]+>", "warc-date": r"\d{4}-\d\d-\d\dT[\d:.]+Z?"}
_GZIP = b"\x1f\x8b\x08"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(key: object) -> str:
    return f"<urn:quillon:page:{'null' if key is None else key}>"


def key_of(name: str | None) -> int | None:
    tail = (name or "").strip("<>").rpartition(":")[2]
    return int(tail) if re.fullmatch(r"-?\d+", tail) else None


def _clean(url: str | None) -> str:
    """A header holds no control characters: they are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def record(key: int | None, url: str | None, sha1: str, length: int, payload: bytes | None, first: int | None = None) -> bytes:
    """A response record, or a revisit of `first`, which carries the response's headers but no payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode() + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: {record_id(key)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_clean(url)}"]
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first)}"]
    head += [f"WARC-Payload-Digest: sha1:{sha1}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member without its last byte, which is 0."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = z.compress(data) + z.flush()
    if out[-1]:
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        out += z.flush()
    return out[:-1]


@dataclass
class Record:
    type: str
    headers: dict[str, str]
    block: bytes
    offset: int

    @property
    def checked(self) -> bool:
        """Whether it states a block digest that can be computed; where it is read, such a digest holds."""
        return self.headers.get("warc-block-digest", "").startswith("sha1:")

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]

    @property
    def payload_bytes(self) -> int | None:
        m = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", self.block.partition(b"\r\n\r\n")[0])
        return int(m[1]) if m else None


@dataclass
class Gap:
    """Bytes passed over. inner: where they begin among the decoded bytes of the member at `offset`; without it they are the file's."""

    offset: int
    length: int
    reason: str
    inner: int | None = None


@dataclass
class Salvage:
    """Reads the records of an archive held as bytes (or mapped memory); gaps lists what was passed over.

    A member is decoded whole, so memory follows the largest one.
    """

    data: bytes
    gaps: list[Gap] = field(default_factory=list)

    def _parse(self, raw: bytes, at: int) -> tuple[Record, int] | tuple[str, int | None]:
        """The record at a place of raw bytes and where it ends; or why there is none, and where the next begins if that is known."""
        if not _VERSION.match(raw, at):
            return "no version line", None
        end = raw.find(b"\r\n\r\n", at)  # headers may be as long as an address is
        if end < 0:
            return "headers don't end", None
        headers = {}
        for line in bytes(raw[at:end]).decode("utf-8", "replace").split("\r\n")[1:]:
            k, colon, v = line.partition(":")
            if not colon:
                return "malformed header", None
            headers[k.strip().lower()] = v.strip()
        if any(not re.fullmatch(form, headers.get(k, "")) for k, form in _MUST.items()):
            return "a header is missing", None
        size = headers.get("content-length", "")
        if not (size.isascii() and size.isdigit() and len(size) < 16):
            return "no length", None
        stop = end + 4 + int(size)
        if len(raw) < stop + 4:
            return "cut short", None
        if bytes(raw[stop : stop + 4]) != b"\r\n\r\n":
            return "length doesn't fit", None
        stop += 4
        framed = stop if stop == len(raw) or _VERSION.match(raw, stop) else None
        found = Record(headers.get("warc-type", ""), headers, bytes(raw[end + 4 : stop - 4]), at)
        if found.checked and headers["warc-block-digest"][5:] != digest(found.block):
            return "block digest differs", framed
        if found.type == "response":
            if (sum_ := headers.get("warc-payload-digest", "")).startswith("sha1:") and sum_[5:] != digest(found.payload):
                return "payload digest differs", framed
            if found.payload_bytes not in (None, len(found.payload)):
                return "payload length differs", framed
        return found, stop

    def _decoded(self, at: int) -> tuple[bytes, int, str]:
        """What the member at a place decodes to, where it ends or breaks off, and why it broke off."""
        z, parts, fed = zlib.decompressobj(31), [], at
        while not z.eof and fed < len(self.data):
            before, chunk = z.copy(), self.data[fed : fed + 32768]
            try:
                parts.append(z.decompress(chunk))
            except zlib.error as e:
                for k in range(len(chunk)):  # once more, byte by byte, for all that comes before the error
                    try:
                        parts.append(before.decompress(chunk[k : k + 1]))
                    except zlib.error:
                        return b"".join(parts), fed + k, str(e)
            fed += len(chunk)
        return b"".join(parts), fed - len(z.unused_data), "" if z.eof else "member cut short"

    def _at(self, at: int, seen: set[str], strict: bool) -> tuple[list[Record], list[Gap], int, str]:
        """The records of the member, or the record, at a place of the file, the gaps within, where it ends, and why it isn't whole.

        seen: blocks of a broken member's records, which may turn up again among its bytes. strict:
        only records with a block digest count, as they do in members that break off.
        """
        if self.data[at : at + 3] != _GZIP:
            got, stop = self._parse(self.data, at)
            if isinstance(got, str):
                return [], [], at + 1, got
            bad = "a record read already" if digest(got.block) in seen else "unchecked" if strict and not got.checked else ""
            return ([], [], at + 1, bad) if bad else ([got], [], stop, "")
        raw, end, why = self._decoded(at)
        out, gaps, k, lost, reason = [], [], 0, None, ""
        while k < len(raw):
            got, stop = self._parse(raw, k)
            if not isinstance(got, str) and why and not got.checked:
                got = "unchecked"
            if isinstance(got, str):
                if lost is None:
                    lost, reason = k, got
                line = None if stop else _VERSION.search(raw, k + 1)
                k = stop or (line.start() if line else len(raw))
                continue
            if lost is not None:
                gaps.append(Gap(at, k - lost, reason, lost))
                lost = None
            out.append(Record(got.type, got.headers, got.block, at))
            k = stop
        if lost is not None:
            gaps.append(Gap(at, len(raw) - lost, reason, lost))
        return out, gaps, end, why

    def __iter__(self) -> Iterator[Record]:
        at, lost, reason, seen, until = 0, None, "", set(), 0
        while at < len(self.data):
            if at >= until:
                seen = set()
            records, gaps, end, why = self._at(at, seen, at < until)
            if not why and not records and gaps and lost is not None:
                why = gaps[0].reason  # bytes that happen to decode aren't a member
            if records or not why:
                if lost is not None:
                    self.gaps.append(Gap(lost, at - lost, reason))
                    lost = None
                self.gaps += gaps
                yield from records
            if not why:
                at = end
                continue
            if records:
                seen |= {digest(r.block) for r in records}
                lost, reason, until = end, why, max(until, end)
            elif lost is None:
                lost, reason = at, why
            line = _VERSION.search(self.data, at + 1)
            found = [x for x in (self.data.find(_GZIP, at + 1), line.start() if line else -1) if x > 0]
            at = min(found, default=len(self.data))
        if lost is not None and lost < len(self.data):
            self.gaps.append(Gap(lost, len(self.data) - lost, reason))


def put_members(members: DataFrame, path: str, each: int) -> None:
    """Writes the column r, gzip members without their last byte (0), to files of `each` members.

    They go through Spark's text writer, which takes bytes as they come: the cast to text checks
    and changes nothing, and the line separator is the byte left out.
    """
    members.select(F.col("r").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", each).text(path)


def write_archives(pages: DataFrame, path: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", file_bytes: int = FILE_BYTES) -> None:
    """A record for each row of pages in archives below path.

    Of rows with equal payloads (null: empty) of at least `least` bytes, those of the smallest id
    are responses and the others revisit it. Null ids never come first, and a payload that only
    they have is a response each time.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("p")).withColumn("d", F.sha1("p"))
    first = rows.where(F.octet_length("p") >= least).groupBy("d").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("d", "n", "first")
    mean, total = rows.agg(F.avg(F.octet_length("p")), F.count("*")).first()

    def make(batches):
        for batch in batches:
            got = []
            for k, u, p, d in zip(*(batch[x].to_pylist() for x in ("id", "url", "p", "d")), strict=True):
                sha1 = base64.b32encode(bytes.fromhex(d)).decode()
                got.append((len(p), sha1, member(record(k, u, sha1, len(p), p))))
            yield pa.record_batch([batch["id"], batch["url"], batch["d"], pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.string()), pa.array([x[2] for x in got], pa.binary())], names=["id", "url", "d", "size", "sha1", "r"])

    # responses are made, and compressed, before the join: what it moves is smaller than the pages
    made = rows.mapInArrow(make, "id long, url string, d string, size long, sha1 string, r binary")
    again = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") != F.col("first")))
    full = c.spread_join(made, first, "d", "n", total, ["id", "url"], "left")
    joined = full.select("id", "url", "size", "sha1", F.when(again, F.col("first")).alias("first"), F.when(~again, F.col("r")).alias("r"))

    def go(batches):
        for batch in batches:
            out = [r if f is None else member(record(k, u, s, n, None, f)) for k, u, n, s, f, r in zip(*(c_.to_pylist() for c_ in batch.columns), strict=True)]
            yield pa.record_batch([pa.array(out, pa.binary())], names=["r"])

    each = max(1, int(file_bytes / max(mean or 1, 1)))
    with c.small_batches(pages.sparkSession):
        put_members(joined.mapInArrow(go, "r binary"), path, each)


#: payload_bytes and payload_digest are computed from the payload of a response; a revisit's are those it states.
READ = "file string, offset long, type string, id long, refers_to long, url string, payload_bytes long, payload_digest string, payload binary"


def read_archives(spark: SparkSession, path: str, gaps: bool = False, payloads: bool = False) -> DataFrame:
    """The records of the archives below path, or (gaps) what had to be passed over: file, offset, length, reason, inner."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")

    def records(batches):
        for batch in batches:
            for name, data in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                held, size = [], 0
                for r in Salvage(data.as_py()):
                    h = r.headers
                    size_, sum_ = (len(r.payload), digest(r.payload)) if r.type == "response" else (r.payload_bytes, h.get("warc-payload-digest", "").removeprefix("sha1:"))
                    held.append((name, r.offset, r.type, key_of(h.get("warc-record-id")), key_of(h.get("warc-refers-to")), h.get("warc-target-uri"), size_, sum_, r.payload if payloads else None))
                    size += len(r.block)
                    if size > 8 << 20:
                        yield batch_of(held)
                        held, size = [], 0
                yield batch_of(held)

    def batch_of(held):
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary())
        return pa.record_batch([pa.array([x[k] for x in held], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in READ.split(", ")])

    def passed(batches):
        for batch in batches:
            for name, data in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                s = Salvage(data.as_py())
                for _ in s:
                    pass
                yield pa.record_batch([pa.array([name] * len(s.gaps), pa.string()), pa.array([g.offset for g in s.gaps], pa.int64()), pa.array([g.length for g in s.gaps], pa.int64()), pa.array([g.reason for g in s.gaps], pa.string()), pa.array([g.inner for g in s.gaps], pa.int64())], names=["file", "offset", "length", "reason", "inner"])

    return files.mapInArrow(passed, "file string, offset long, length long, reason string, inner long") if gaps else files.mapInArrow(records, READ)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of the records read back."""
    path = c.shared_dir(pages.sparkSession)
    write_archives(pages, path, least)
    return c.stored(read_archives(pages.sparkSession, path).selectExpr("id as page_id", "payload_bytes", "payload_digest", "type as record_type", "refers_to", "url"))
