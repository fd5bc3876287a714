"""WARC records in ZIP packages: a writer, and a reader that parses central and ZIP64 directories and range-reads records without extraction.

A package holds a stored member archive/data.warc.gz (each record its own gzip member) and a stored index/index.cdx with one line per record:
page id, offset and length within the archive member. The reader reads the end of the package, its directories and the index, and then only the byte
ranges of the records. A stored archive member without an index is walked from its start.

Of pages with equal payloads (SHA-1 and length) of at least min_revisit_bytes, the one with the smallest id is a response and the others revisit it.

Nulls: a null html is an empty payload. A page with a null id is written as a response under an empty id and comes back with a null id; nothing refers
to it. Rows that share an id and payload are all responses. Other columns are ignored. An empty table writes no package and reads no record.

Packages are written through pyarrow's file systems (local and shared paths, S3, GCS, HDFS), under a new name for each task attempt; the table of
finished packages names only those of attempts that ended well, so a lost executor leaves no half-written package behind in the result.
"""

import base64
import gzip
import hashlib
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import shared_folder
from .runtime import kept

ARCHIVE, INDEX = "archive/data.warc.gz", "index/index.cdx"
RANGE_BYTES = 4_000_000
# Fixed values of the ZIP format: signatures, and the marker for "see the ZIP64 field".
END, END64, LOCATOR64, ENTRY, LOCAL = 0x06054B50, 0x06064B50, 0x07064B50, 0x02014B50, 0x04034B50
SEE_64 = 0xFFFFFFFF
STORED = 0


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None) -> bytes:
    """One WARC record, gzipped. A revisit has no payload, but says how long it is."""
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z"),
              ("WARC-Target-URI", " ".join((url or "").split())), ("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("X-Payload-Length", str(len(payload))), ("Content-Length", str(len(body)))]
    if refers_to is not None:
        fields[3:3] = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(head.encode() + body + b"\r\n\r\n", 1, mtime=0)


def parsed(data: bytes) -> dict:
    """Fields of one gzipped WARC record."""
    plain = zlib.decompress(data, 31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    page = lambda name: int(x) if (x := fields.get(name, "<urn:page:>")[10:-1]) else None
    body = rest[:int(fields["Content-Length"])]
    known = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    whole = fields["WARC-Type"] == "revisit" or (digest(body) == known and len(body) == int(fields["X-Payload-Length"]))
    return {"page_id": page("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": known, "record_type": fields["WARC-Type"],
            "refers_to": page("WARC-Refers-To"), "intact": whole, "payload": body if fields["WARC-Type"] == "response" else None}


RECORD = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean, payload binary")


def _roles(pages: DataFrame, min_revisit_bytes: int) -> DataFrame:
    """(page_id, payload_digest, payload_bytes, first): first is the smallest id with the payload, null where pages do not revisit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = [(x or "").encode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(p) for p in payloads], pa.string()), pa.array([len(p) for p in payloads], pa.int64())],
                                             ["page_id", "payload_digest", "payload_bytes"])
    payload = ["payload_digest", "payload_bytes"]
    known = kept(pages.select("page_id", "html").mapInArrow(run, "page_id long, payload_digest string, payload_bytes long").where("page_id IS NOT NULL").distinct(), "payloads")
    firsts = known.where(F.col("payload_bytes") >= min_revisit_bytes).groupBy(*payload).agg(F.min("page_id").alias("first"))
    return known.join(firsts, payload).where("page_id <> first").select("page_id", F.col("payload_digest").alias("same"), "first")


def _packaged(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = name = out = None
        lines, offset, records = [], 0, 0
        package = member = None
        for batch in batches:
            for page_id, url, html, firsts in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"{folder}/{uuid.uuid4().hex}.wacz"
                    store, path = fs.FileSystem.from_uri(name)
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(path)
                    package = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                    member = package.open(ARCHIVE, "w", force_zip64=True)
                payload = (html or "").encode()
                known = digest(payload)
                data = record(page_id, url, payload, known, {f["same"]: f["first"] for f in firsts or ()}.get(known))
                member.write(data)
                lines.append(f"{'' if page_id is None else page_id} {offset} {len(data)}\n")
                offset, records = offset + len(data), records + 1
        if out is not None:
            member.close()
            package.writestr(INDEX, "".join(lines))
            package.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64())], ["package", "records"])
    return run


def write(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 0) -> DataFrame:
    """Write a record per row of pages (page_id, url, html) into packages below `folder`; returns the table of packages (package, records)."""
    folder = folder or shared_folder(pages.sparkSession, "warc")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    # rows that share an id may have different payloads: each takes the entry of its own digest
    roles = _roles(pages, min_revisit_bytes).groupBy("page_id").agg(F.collect_list(F.struct("same", "first")).alias("firsts"))
    return kept(pages.join(roles.hint("merge"), "page_id", "left").mapInArrow(_packaged(folder), "package string, records long"), "packages")


class Package:
    """A ZIP package read by ranges."""

    def __init__(self, name: str):
        store, path = fs.FileSystem.from_uri(name)
        self.file = store.open_input_file(path)
        self.size = self.file.size()

    def read(self, start: int, n: int) -> bytes:
        self.file.seek(start)
        return self.file.read(n)

    def directory(self) -> tuple[int, int]:
        """Where the central directory starts and how long it is; from the ZIP64 end record where the plain one refers to that."""
        tail_at = max(0, self.size - 65_557)
        tail = self.read(tail_at, self.size - tail_at)
        at = tail.rfind(struct.pack("<I", END))
        if at < 0:
            raise ValueError("no end of central directory")
        entries, length, start = struct.unpack_from("<10xHII", tail, at)
        if at >= 20 and struct.unpack_from("<I", tail, at - 20)[0] == LOCATOR64 and (start == SEE_64 or length == SEE_64 or entries == 0xFFFF):
            end = self.read(struct.unpack_from("<Q", tail, at - 12)[0], 56)
            if struct.unpack_from("<I", end)[0] != END64:
                raise ValueError("no ZIP64 end of central directory")
            length, start = struct.unpack_from("<40xQQ", end)
        return start, length

    def members(self) -> list[tuple[str, int, int]]:
        """(name, where its bytes start, how many) of the stored members."""
        start, length = self.directory()
        data, at, out = self.read(start, length), 0, []
        while at + 46 <= len(data) and struct.unpack_from("<I", data, at)[0] == ENTRY:
            method, packed, plain, n_name, n_extra, n_comment, offset = struct.unpack_from("<10xH8xIIHHH8xI", data, at)
            name = data[at + 46:at + 46 + n_name].decode()
            extra, e = data[at + 46 + n_name:at + 46 + n_name + n_extra], 0
            while e + 4 <= len(extra):
                tag, n = struct.unpack_from("<HH", extra, e)
                if tag == 1:                       # 8-byte values, in this order, for those fields that are marked
                    values = iter(struct.unpack_from(f"<{n // 8}Q", extra, e + 4))
                    plain = next(values) if plain == SEE_64 else plain
                    packed = next(values) if packed == SEE_64 else packed
                    offset = next(values) if offset == SEE_64 else offset
                e += 4 + n
            if method == STORED:
                signature, a, b = struct.unpack("<I22xHH", self.read(offset, 30))
                if signature != LOCAL:
                    raise ValueError("no local header")
                out.append((name, offset + 30 + a + b, packed))
            at += 46 + n_name + n_extra + n_comment
        return out

    def records(self) -> list[tuple[int, int]]:
        """(start, length) in the package of each record, from the index or, without one, by walking the archive."""
        members = {name: (start, n) for name, start, n in self.members()}
        archives = [x for name, x in members.items() if name.startswith("archive/")]
        if INDEX in members and len(archives) == 1:
            return [(archives[0][0] + int(x[-2]), int(x[-1])) for x in map(str.split, self.read(*members[INDEX]).decode().splitlines())]
        return [x for start, n in archives for x in self.walked(start, n)]

    def walked(self, start: int, n: int) -> Iterator[tuple[int, int]]:
        """Bounds of the gzip members that follow each other in a stretch of the package."""
        at, first, stop, left = start, start, start + n, b""
        unpacked = zlib.decompressobj(31)
        while at < stop or left:
            if not left:
                left = self.read(at, min(1 << 20, stop - at))
                at += len(left)
            unpacked.decompress(left)
            left = unpacked.unused_data
            if unpacked.eof:
                yield first, at - len(left) - first
                first, unpacked = at - len(left), zlib.decompressobj(31)


def read(packages: DataFrame) -> DataFrame:
    """All records of the packages named in the column `package`, each range read by whichever task gets it."""
    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                group: list[tuple[int, int]] = []
                for start, n in [*Package(name).records(), (None, 0)]:
                    if group and (start is None or start != sum(group[-1]) or start + n - group[0][0] > RANGE_BYTES):
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([group[0][0]], pa.int64()), pa.array([[x[1] for x in group]], pa.list_(pa.int64()))], ["package", "start", "lengths"])
                        group = []
                    group += [(start, n)] if start is not None else []

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start, lengths in zip(*(c.to_pylist() for c in batch.columns)):
                data, at, rows = Package(name).read(start, sum(lengths)), 0, []
                for n in lengths:
                    rows.append(parsed(data[at:at + n]))
                    at += n
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                        ("intact", pa.bool_()), ("payload", pa.binary())])
    found = packages.select("package").mapInArrow(ranges, "package string, start long, lengths array<long>")
    parts = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(parts, "package", "start").mapInArrow(fetched, RECORD)
