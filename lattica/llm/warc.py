"""Operator 4: web archive files written per partition, and a reader that salvages what damage leaves.

Each record is a gzip member of its own. The reader checks a record's version line, header, length, end and payload
digest. After a failed check it looks for the next member that begins a record (in plain files: the next version line),
goes on there and reports the bytes between as a gap, with the reason.
"""

from __future__ import annotations

import base64
import hashlib
import tempfile
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, arrow_batch, columns_as, dealt_join, new_folder, open_input, sliced, stored, write_bytes

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Uncompressed bytes after which a file ends.
FILE_BYTES = 64 << 20
#: Bytes of a member's content up to which it is held in memory; beyond, in a file of the task's own.
HELD_BYTES = 32 << 20
_STEP = 1 << 18
_ANY = b"WARC/1."


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{payload_digest}')}>"


def record(page, url: str | None, payload: bytes, refers_to=None, first: bool = True) -> bytes:
    """A record as it stands in a plain file: a response, or a revisit of the page refers_to with an equal payload."""
    own = digest(payload)
    target = "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "about:blank")
    head = {
        "WARC-Type": "response" if first else "revisit",
        "WARC-Record-ID": record_id(page, own),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": target,
        "WARC-Payload-Digest": f"sha1:{own}",
        "Content-Type": "application/http;msgtype=response",
        "X-Page-ID": "" if page is None else page,
    }
    if not first:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(refers_to, own), "X-Refers-To-Page-ID": refers_to, "X-Payload-Length": len(payload)}
    block = HTTP + payload if first else HTTP
    head["Content-Length"] = len(block)
    return b"".join([b"WARC/1.1\r\n", *(f"{k}: {v}\r\n".encode() for k, v in head.items()), b"\r\n", block, b"\r\n\r\n"])


def member(plain: bytes) -> bytes:
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(plain) + press.flush()


_FILES = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


def write_archives(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 0, file_bytes: int = FILE_BYTES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Writes a record per row and returns the files: path, records, bytes.

    pages: page_id (long), url, html; other columns are ignored. Null html: an empty payload. Of rows whose payloads are
    equal and at least min_revisit_bytes long, those with the smallest page_id are responses, the others revisit it; rows
    that repeat the smallest page_id are responses too. Null page_id: a revisit if an equal payload has a page_id, else
    a response. An empty table writes no file. Null url: about:blank. Urls may have any length. Copies of a payload that many
    rows have are dealt over tasks.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    rows = columns_as(pages, page="page_id", url="url", html="html").select(F.col("page").cast("long").alias("page"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    least = rows.where(F.octet_length("payload") >= min_revisit_bytes).groupBy("sha").agg(F.min("page").alias("least"), F.count("*").alias("n")).where("n > 1 and least is not null")
    rows = dealt_join(rows, stored(least, "warc-least"), "sha", "n", "left", hot_rows).select("page", "payload", "url", "least")

    def write(batches):
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal seq, held, size
            path = f"{folder}/part-{part:06d}-{seq:06d}.warc.gz"
            n = write_bytes(path, held)
            out = arrow_batch(_FILES, [[path], [len(held)], [n]])
            seq, held, size = seq + 1, [], 0
            return out

        for batch in sliced(batches):
            for page, payload, url, least in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                plain = record(page, url, payload, least, first=least is None or page == least)
                held.append(member(plain))
                size += len(plain)
                if size >= file_bytes:
                    yield flush()
        if held:
            yield flush()

    return stored(rows.mapInArrow(write, "path string, records long, bytes long"), "warc-files")


class Damaged(Exception):
    pass


class _Bytes:
    """A member's content, read like a file."""

    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def read(self, at: int, n: int) -> bytes:
        return self.data[at : at + n]

    def find(self, what: bytes, at: int) -> int:
        return self.data.find(what, at)


class _File:
    """A file, read in steps."""

    def __init__(self, file, size: int | None = None):
        self.file, self.size = file, file.size() if size is None else size

    def read(self, at: int, n: int) -> bytes:
        if at >= self.size:
            return b""
        self.file.seek(at)
        return self.file.read(max(0, min(n, self.size - at)))

    def find(self, what: bytes, at: int) -> int:
        while at < self.size:
            got = self.read(at, _STEP + len(what) - 1)
            if (k := got.find(what)) >= 0:
                return at + k
            at += _STEP
        return -1


@dataclass
class Payload:
    length: int
    digest: str
    data: bytes | None  # unless payloads are left out


def _payload(source, begin: int, n: int, http: bool, keep: bool) -> Payload:
    """A block's payload, what follows its HTTP header; read in steps unless it is to be kept."""
    end = begin + n
    if http:
        cut = source.find(b"\r\n\r\n", begin)
        begin = cut + 4 if begin <= cut and cut + 4 <= end else end
    own, parts = hashlib.sha1(), []
    for at in range(begin, end, _STEP):
        part = source.read(at, min(_STEP, end - at))
        own.update(part)
        if keep:
            parts.append(part)
    return Payload(end - begin, base64.b32encode(own.digest()).decode(), b"".join(parts) if keep else None)


def _record_at(source, at: int, keep: bool = True) -> tuple[dict, Payload, int]:
    """Header, payload and end of the record at a place, or Damaged. A header may have any length."""
    if source.read(at, len(_ANY)) != _ANY:
        raise Damaged("no version line")
    if (cut := source.find(b"\r\n\r\n", at)) < 0:
        raise Damaged("header does not end")
    fields = {}
    for line in source.read(at, cut - at).split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without colon")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not (fields.get("warc-type") and fields.get("warc-record-id")):
        raise Damaged("no type or record id")
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Damaged("no content length")
    begin, n = cut + 4, int(length)
    if begin + n + 4 > source.size:
        raise Damaged("record is cut off")
    if source.read(begin + n, 4) != b"\r\n\r\n":
        raise Damaged("record does not end at its length")
    payload = _payload(source, begin, n, fields.get("content-type", "").startswith("application/http"), keep)
    said = fields.get("warc-payload-digest", "")
    if fields.get("warc-type") == "response" and said.startswith("sha1:") and said[5:] != payload.digest:
        raise Damaged("payload digest differs")
    return fields, payload, begin + n + 4


def _next_line(source, at: int) -> int:
    """The next version line at the start of a line, or elsewhere if a whole record begins there, or the end."""
    while (at := source.find(_ANY, at)) >= 0:
        if at == 0 or source.read(at - 1, 1) == b"\n":
            return at
        try:
            _record_at(source, at, False)
            return at
        except Damaged:
            at += 1
    return source.size


def _inflated(source, at: int):
    """A member's content in steps; each with the place up to which the source was read for it, the last with the member's end."""
    press, got = zlib.decompressobj(31), at
    try:
        while not press.eof:
            chunk = source.read(got, _STEP)
            if not chunk:
                raise Damaged("member is cut off")
            got += len(chunk)
            while chunk and not press.eof:
                part = press.decompress(chunk, 4 * _STEP)
                chunk = press.unconsumed_tail
                yield part, got - len(press.unused_data)
    except zlib.error as e:
        raise Damaged(f"member: {e}") from None


def _begins_record(source, at: int) -> bool:
    """Whether a member begins here whose content begins a record."""
    press, head = zlib.decompressobj(31), b""
    try:
        for k in range(4):
            head += press.decompress(source.read(at + 4096 * k, 4096), 16)
            if len(head) >= len(_ANY) or press.eof:
                break
    except zlib.error:
        return False
    return head.startswith(_ANY)


def _next_member(source, at: int) -> int:
    """The next place where a member begins whose content begins a record, or the end."""
    while (at := source.find(b"\x1f\x8b\x08", at)) >= 0:
        if _begins_record(source, at):
            return at
        at += 1
    return source.size


def salvage(source, compressed: bool, payloads: bool = True):
    """Yields (begin, end, header, payload, "") for each record and (begin, end, None, None, reason) for each gap.

    Places are bytes of the file; for what lies inside a member, the member's. Large members are inflated into a file.
    """
    at = 0
    while at < source.size:
        try:
            if not compressed:
                fields, payload, end = _record_at(source, at, payloads)
                yield at, end, fields, payload, ""
            else:
                with tempfile.SpooledTemporaryFile(HELD_BYTES) as content:
                    for part, end in _inflated(source, at):
                        content.write(part)
                    size = content.tell()
                    for _, _, fields, payload, why in salvage(_File(content, size), False, payloads) if size else [(0, 0, None, None, "empty member")]:
                        yield at, end, fields, payload, why
        except Damaged as e:
            end = (_next_member if compressed else _next_line)(source, at + 1)
            yield at, end, None, None, str(e)
        at = end


_RECORDS = pa.schema([("path", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("gap", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read_archives(files: DataFrame, payloads: bool = True) -> DataFrame:
    """A row per record and per gap of the files in column path: where it lies, and either what is wrong (gap) or the record.

    A revisit's payload_bytes and payload_digest are those of the payload it refers to; its payload is null. Files that
    end in .gz are read member by member, others as plain records. Empty files give no rows.
    """
    schema = _RECORDS if payloads else pa.schema(list(_RECORDS)[:-1])
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def number(text):
        return int(text) if text and text.lstrip("-").isdigit() else None

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_input(path) as file:
                    rows, held = [], 0
                    for begin, end, fields, payload, why in salvage(_File(file), path.endswith(".gz"), payloads):
                        if fields is None:
                            row = [path, begin, end, why, *[None] * 6]
                        elif fields.get("warc-type") == "revisit":
                            row = [path, begin, end, None, number(fields.get("x-page-id")), "revisit", number(fields.get("x-payload-length")), fields.get("warc-payload-digest", "").removeprefix("sha1:"), number(fields.get("x-refers-to-page-id")), None]
                        else:
                            row = [path, begin, end, None, number(fields.get("x-page-id")), fields.get("warc-type"), payload.length, payload.digest, None, payload.data]
                        rows.append(row[: len(schema)])
                        held += len(payload.data or b"") if payload else 0
                        if held > 8 << 20 or len(rows) >= 4096:
                            yield arrow_batch(schema, list(zip(*rows, strict=True)))
                            rows, held = [], 0
                    if rows:
                        yield arrow_batch(schema, list(zip(*rows, strict=True)))

    kinds = "path string, begin long, end long, gap string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long"
    return files.select("path").repartition(n).mapInArrow(read, kinds + ", payload binary" * payloads)


def records(found: DataFrame) -> DataFrame:
    return found.where("gap is null").drop("gap")


def quarantine(found: DataFrame) -> DataFrame:
    """The log of byte gaps: path, begin, end, reason."""
    return found.where("gap is not null").select("path", "begin", "end", F.col("gap").alias("reason"))
