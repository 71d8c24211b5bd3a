"""WARC archives of pages: written a record a gzip member, read back in byte ranges that know nothing of each other."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm import kernels as K
from panelforge.llm.skew import lookup
from panelforge.llm.storage import ROW, numbered, shared_dir, small_batches, stored, with_rows

#: Payloads of fewer bytes are always written out.
LEAST_BYTES = 100
#: Compressed bytes of an archive, about, and of the range that a reading task takes.
FILE_BYTES, RANGE_BYTES = 256 << 20, 8 << 20
MAGIC = b"\x1f\x8b\x08"
#: How far a candidate is decoded to see whether a record begins there, and what is read at once.
PROBE, CHUNK = 512, 1 << 20
#: Fixed values of the format.
VERSION, PROFILE = b"WARC/1.1\r\n", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = re.compile(r"<urn:x-page:(-?\d*):(-?\d+)>")


def record_id(page: int | None, row: int) -> str:
    return f"<urn:x-page:{'' if page is None else page}:{row}>"


def page_of(identifier: str) -> int | None:
    found = ID.fullmatch(identifier)
    return int(found[1]) if found and found[1] else None


def member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    head = VERSION + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))]).encode() + b"\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def page_record(page: int | None, row: int, url: str | None, payload: bytes, digest: str, refers: tuple[int | None, int] | None, date: str) -> bytes:
    """A response with its payload, or a revisit that names the response and has the HTTP head alone."""
    fields = [("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", record_id(page, row)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="%/:?#[]@!$&'()*+,;=~-._")))
    fields.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if refers:
        fields += [("WARC-Refers-To", record_id(*refers)), ("WARC-Profile", PROFILE)]
    fields.append(("Content-Type", "application/http;msgtype=response"))
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return member(fields, head if refers else head + payload)


FILES = "path string, n_bytes long, n_records long"


def _writer(folder: str, date: str, file_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(row, page_id, url, payload, digest, refers, refers_row) -> archives in folder, listed once they are closed.

    Names hold the attempt, so that a task that is run again leaves the lists of others alone.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        context, nth, out, size, records = TaskContext.get(), 0, None, 0, 0
        name = ""

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size]), pa.array([records])], ["path", "n_bytes", "n_records"])

        for batch in batches:
            for row, page, url, payload, digest, refers, refers_row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"pages-{context.partitionId():05d}-{context.taskAttemptId()}-{nth}.warc.gz"
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                    info = b"format: WARC File Format 1.1\r\n"
                    size = out.write(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], info))
                    records, nth = 0, nth + 1
                size += out.write(page_record(page, row, url, payload, digest, None if refers_row is None else (refers, refers_row), date))
                records += 1
                if size >= file_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return write


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2000-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write every row as a WARC record and return the archives: path, n_bytes, n_records.

    The payload is the page in UTF-8, null counts as empty. Of equal payloads (SHA-256 and length) of LEAST_BYTES or more
    the one of the smallest page_id (null last, then by place in the table) is the response and the others revisit it.
    folder: anywhere that all machines and Arrow's file systems reach; a new one in the shared folder if not given.
    Rows stay where they are read; only digests move. An empty table writes nothing. Other columns are not read.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = (folder or f"{shared_dir(spark).rstrip('/')}/archives-{uuid.uuid4().hex}").rstrip("/")
    rows = numbered(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8").alias("payload")))
    long = stored(rows.filter(F.octet_length("payload") >= LEAST_BYTES).select(ROW, "page_id", F.unhex(F.sha2("payload", 256)).alias("digest"), F.octet_length("payload").alias("n_bytes")), "payloads")
    place = F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", ROW)
    equal = stored(long.groupBy("digest", "n_bytes").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "equal-payloads")
    again = lookup(long, equal, ["digest", "n_bytes"], "n").filter(F.col(ROW) != F.col(f"first.{ROW}"))
    again = stored(again.select(ROW, F.col("first.page_id").alias("refers"), F.col(f"first.{ROW}").alias("refers_row")), "revisits")
    whole = with_rows(rows, again, "left").select(ROW, "page_id", "url", "payload", F.sha2("payload", 256).alias("digest"), "refers", "refers_row")
    return stored(whole.mapInArrow(K.tidy(_writer(folder, date, file_bytes)), FILES), "archives")


class Window:
    """A view of a file that reads on as far as it is asked to."""

    def __init__(self, file: pa.NativeFile, at: int) -> None:
        self.file, self.base, self.data, self.size = file, at, b"", file.size()
        file.seek(at)

    def upto(self, end: int) -> None:
        """Have the bytes before `end`, or all there are."""
        while self.base + len(self.data) < min(end, self.size):
            self.data += self.file.read(max(CHUNK, end - self.base - len(self.data)))

    def forget(self, before: int) -> None:
        """What lies before may go; it goes once there is much of it."""
        if before - self.base >= CHUNK:
            self.data, self.base = self.data[before - self.base :], before

    def find(self, at: int, end: int) -> int:
        """The first place from `at` on and before `end` where a gzip member that holds a record begins, or -1."""
        while at < end:
            self.upto(at + len(MAGIC))
            found = self.data.find(MAGIC, at - self.base)
            if found < 0:
                last = self.base + len(self.data)
                if last >= self.size:
                    return -1
                at = max(at, last - len(MAGIC) + 1)
                self.forget(at)
                continue
            at = self.base + found
            if at >= end:
                return -1
            if self.begins(at):
                return at
            at += 1
        return -1

    def begins(self, at: int) -> bool:
        """Whether what is here decodes to the head of a record."""
        self.upto(at + PROBE)
        try:
            said = zlib.decompressobj(31).decompress(self.data[at - self.base : at - self.base + PROBE], 8)
        except zlib.error:
            return False
        return said.startswith(b"WARC/1.")

    def member(self, at: int) -> tuple[bytes, int]:
        """What the member here holds, and where it ends."""
        z, parts, place, step = zlib.decompressobj(31), [], at, PROBE
        while not z.eof:
            step = min(2 * step, CHUNK)  # most are short, and what is left over is copied
            self.upto(place + step)
            piece = self.data[place - self.base : place - self.base + step]
            if not piece:
                raise ValueError(f"a record at {at} is cut off")
            parts.append(z.decompress(piece))
            place += len(piece) - len(z.unused_data)
            self.forget(place)
        return b"".join(parts), place


def members(file: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, content) of the members that begin in [start, end), wherever they end."""
    view = Window(file, start)
    at = view.find(start, end)
    while 0 <= at < end:
        content, after = view.member(at)
        yield at, content
        at = view.find(after, end) if after < end else -1


def parsed(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of a member."""
    at = 0
    while content.startswith(b"WARC/", at):
        head = content.index(b"\r\n\r\n", at)
        lines = content[at:head].decode().split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        stop = head + 4 + int(fields["content-length"])
        yield fields, content[head + 4 : stop]
        at = stop + 4


RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, record_id string, path string, place long, payload binary"


def _reader(with_payload: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.string() if x.endswith("string") else pa.int64() if x.endswith("long") else pa.binary() for x in RECORDS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as file:
                    for place, content in members(file, start, end):
                        for fields, block in parsed(content):
                            kind = fields.get("warc-type")
                            if kind not in ("response", "revisit"):
                                continue
                            head = block.index(b"\r\n\r\n")
                            said = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
                            payload, n = None, None
                            if kind == "response":
                                payload = block[head + 4 :]
                                n, digest = len(payload), hashlib.sha256(payload).hexdigest()
                                if said not in (None, digest):
                                    raise ValueError(f"the payload at {place} of {path} is not that of its digest")
                                said = digest
                            else:
                                length = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", block)
                                n = int(length[1]) if length else None
                            refers = fields.get("warc-refers-to") if kind == "revisit" else None
                            ident = fields.get("warc-record-id", "")
                            rows.append((page_of(ident), fields.get("warc-target-uri"), kind, n, said, page_of(refers) if refers else None, ident, path, place, payload if with_payload else None))
                            held += len(block) if with_payload else 256
                            if held >= 4 << 20:
                                yield batch_of()
                                rows, held = [], 0
        if rows:
            yield batch_of()

    return read


def read_archives(files: DataFrame, range_bytes: int = RANGE_BYTES, with_payload: bool = True) -> DataFrame:
    """One row for each response or revisit in the archives (path, n_bytes): page_id, url, record_type, payload_bytes and
    payload_digest of the full payload, refers_to (page_id of the response, for revisits), record_id, path, place, payload.

    Each file is read in ranges, by tasks of their own. A task looks for gzip members from its range's start on, takes a
    candidate for one only if it decodes to the head of a record, and owns the records that begin in its range; the last
    of them may end in the next. Payloads are held against their digests. url is as written, percent-encoded. page_id is
    null for records that write_archives did not name or that had none. Other kinds of record are passed over.
    """
    small_batches(files.sparkSession)
    total = files.agg(F.sum(F.ceil(F.col("n_bytes") / range_bytes))).first()[0] or 0
    starts = files.filter("n_bytes > 0").select("path", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = starts.select("path", "start", F.least(F.col("start") + range_bytes, "n_bytes").alias("end"))
    return ranges.repartition(min(max(int(total), 1), 100_000), "path", "start").mapInArrow(K.tidy(_reader(with_payload)), RECORDS)
