"""WARC archives as a PySpark Python data source.

Writing: each task appends records to files of its own in the target folder, one gzip member a record, with the
member's compressed length in the gzip extra field `sl`; a file is closed when it is about `roll_mb` large. Files
are hidden until the driver commits the job, so retried or lost tasks leave nothing that a reader sees.

Reading: the driver lists files and plans them into partitions of about `split_mb`. Predicates on the record type and
other header columns are pushed down; each record's headers are parsed first, and where a predicate fails, or the
schema asks for no payload, the rest of the record is skipped by its length without being decompressed. Plain `.warc`
files and gzip members without the extra field are read as well.

Columns (any subset may be asked for by `.schema(...)`): record_type, record_id, target_uri, date, page_id, refers_to_id,
refers_to, payload_digest, payload_bytes, http_status, payload, headers. Digests are bare lower-case hex; those of
responses are taken from the payload when that is read.

Defined cases: null payloads count as empty; a null url gives a record without target; null page ids stay null;
repeated rows give a record each; an empty table gives an empty archive; line breaks in header values become spaces. A record that is cut short,
or has no header block, length or number where one belongs, ends the read with a ValueError that names the file; with the option `malformed` set to
`drop` the record is left out, and what follows a cut is not read. A record of 4 GB or more is written without the lengths of its member, which is
then found by decompressing it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

REVISIT_BYTES = 1000
SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, page_id bigint, refers_to_id string, refers_to bigint, "
    "payload_digest string, payload_bytes bigint, http_status int, payload binary, headers map<string,string>"
)
#: Header field of each column that is a plain header value.
_FIELDS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "page_id": "x-page-id",
    "refers_to_id": "warc-refers-to",
    "refers_to": "x-refers-to-page-id",
    "payload_digest": "warc-payload-digest",
    "payload_bytes": "x-payload-length",
}
_NUMBERS = {"page_id", "refers_to", "payload_bytes"}
_FROM_BODY = {"payload", "http_status"}
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = 1 << 20
#: Members below this length tell it.
_SIZED = 1 << 32
_BATCH_ROWS, _BATCH_BYTES = 2000, 8 << 20


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


# Records


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id, url, payload: bytes, record_type: str, refers_to, digest: str, date: str) -> bytes:
    """The bytes of one record; a revisit carries the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if record_type == "revisit" else http + payload
    told = [
        ("WARC-Type", record_type),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", url),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("WARC-Profile", _PROFILE if record_type == "revisit" else None),
        ("WARC-Refers-To", record_id(refers_to, digest) if record_type == "revisit" else None),
        ("X-Page-Id", page_id),
        ("X-Refers-To-Page-Id", refers_to),
        ("X-Payload-Length", len(payload)),
        ("Content-Length", len(block)),
    ]
    head = "".join(f"{k}: {' '.join(str(v).split())}\r\n" for k, v in told if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """A gzip member whose extra field tells its compressed and its plain length."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 12 + 12 + len(body) + 8
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    if max(size, len(data)) >= _SIZED:
        return struct.pack("<4BI2B", 31, 139, 8, 0, 0, 0, 255) + body + tail
    return struct.pack("<4BI2BH2sHII", 31, 139, 8, 4, 0, 0, 255, 12, b"sl", 8, size, len(data)) + body + tail


class _Input:
    """A file read forward through a buffer; skipping beyond it seeks."""

    def __init__(self, file):
        self.file, self.buf, self.at, self.base = file, b"", 0, 0

    def peek(self, n: int) -> bytes:
        while len(self.buf) - self.at < n:
            more = self.file.read(max(_CHUNK, n))
            if not more:
                break
            self.base += self.at
            self.buf, self.at = self.buf[self.at :] + more, 0
        return self.buf[self.at : self.at + n]

    def take(self, n: int) -> bytes:
        out = self.peek(n)
        self.at += len(out)
        return out

    def skip(self, n: int) -> None:
        if n <= len(self.buf) - self.at:
            self.at += n
        else:
            self.base += self.at + n
            self.file.seek(self.base)
            self.buf, self.at = b"", 0


def parse_headers(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


class Malformed(ValueError):
    """Bytes that are no record."""


def content_length(headers: dict[str, str]) -> int:
    told = headers.get("content-length", "")
    if not told.isdigit():
        raise Malformed("a record without a content length")
    return int(told)


def _block(headers: dict[str, str], data: bytes, end: int) -> bytes:
    size = content_length(headers)
    if len(data) < end + 4 + size:
        raise Malformed("a record that is cut short")
    return data[end + 4 : end + 4 + size]


def _plain_records(f: _Input, wanted, body: bool) -> Iterator[tuple[dict, bytes | None]]:
    while f.peek(1):
        n = 1 << 12
        while (end := (seen := f.peek(n)).find(b"\r\n\r\n")) < 0 and len(seen) == n:
            n *= 2
        if end < 0:
            if seen.strip():
                raise Malformed("a record without the end of its headers")
            return
        headers = parse_headers(f.take(end + 4)[:-4].lstrip(b"\r\n"))
        size = content_length(headers)
        if body and wanted(headers):
            block = f.take(size)
            if len(block) < size:
                raise Malformed("a record that is cut short")
            yield headers, block
        else:
            f.skip(size)
            if wanted(headers):
                yield headers, None
        f.skip(4)


def _gzip_records(f: _Input, wanted, body: bool) -> Iterator[tuple[dict, bytes | None]]:
    while len(head := f.peek(12)) == 12:
        flags = head[3]
        size = None
        start = 10
        if flags & 4:
            n = struct.unpack("<H", head[10:12])[0]
            extra, at = f.peek(12 + n)[12:], 0
            while at + 4 <= n:
                key, length = extra[at : at + 2], struct.unpack("<H", extra[at + 2 : at + 4])[0]
                if key == b"sl" and length == 8:
                    size = struct.unpack("<I", extra[at + 4 : at + 8])[0]
                at += 4 + length
            start = 12 + n
        for bit in (8, 16):  # a file name and a comment, each ended by a zero
            if flags & bit:
                n = start + 256
                while (end := (seen := f.peek(n)).find(b"\0", start)) < 0:
                    if len(seen) < n:
                        raise Malformed("a member without the end of its header")
                    n *= 2
                start = end + 1
        start += 2 * bool(flags & 2)
        if size is None:
            yield from _unsized(f, start, wanted, body)
            continue
        data = f.peek(min(size, start + _CHUNK))
        unpack = zlib.decompressobj(-15)
        seen = unpack.decompress(data[start:], 2048)
        while (end := seen.find(b"\r\n\r\n")) < 0 and not unpack.eof and unpack.unconsumed_tail:
            seen += unpack.decompress(unpack.unconsumed_tail, 2048)
        if end < 0:
            raise Malformed("a member without the end of its headers")
        headers = parse_headers(seen[:end])
        if not wanted(headers):
            f.skip(size)
        elif not body:
            f.skip(size)
            yield headers, None
        else:
            whole = f.take(size)
            rest = unpack.unconsumed_tail + whole[len(data) : size]
            seen += unpack.decompress(rest)
            yield headers, _block(headers, seen, end)


def _unsized(f: _Input, start: int, wanted, body: bool) -> Iterator[tuple[dict, bytes | None]]:
    f.skip(start)
    unpack, parts = zlib.decompressobj(-15), []
    while not unpack.eof and (chunk := f.take(1 << 16)):
        parts.append(unpack.decompress(chunk))
    if not unpack.eof:
        raise Malformed("a member that is cut short")
    f.at -= len(unpack.unused_data)
    f.skip(8)
    whole = b"".join(parts)
    end = whole.find(b"\r\n\r\n")
    if end < 0:
        raise Malformed("a member without the end of its headers")
    headers = parse_headers(whole[:end])
    if wanted(headers):
        yield headers, _block(headers, whole, end) if body else None


def records(file, wanted=lambda h: True, body: bool = True) -> Iterator[tuple[dict, bytes | None]]:
    """(headers, block) of each record whose headers are wanted; no block is decoded unless `body`."""
    f = _Input(file)
    yield from (_gzip_records if f.peek(2) == b"\x1f\x8b" else _plain_records)(f, wanted, body)


# The data source


def _hex(digest: str | None) -> str | None:
    if digest is None:
        return None
    kind, _, value = digest.rpartition(":")
    return base64.b32decode(value).hex() if kind == "sha1" and len(value) == 32 else value.lower()


def header_value(headers: dict[str, str], name: str):
    value = headers.get(_FIELDS[name])
    if name == "payload_digest":
        return _hex(value)
    if name in _NUMBERS and value is not None:
        if not value.lstrip("-").isdigit():
            raise Malformed(f"a record whose {_FIELDS[name]} is no number")
        return int(value)
    return value


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]

    def __init__(self, paths):
        super().__init__(0)
        self.paths = tuple(paths)


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = [f.name for f in schema.fields]
        self.schema, self.path = schema, options["path"]
        self.split = float(options.get("split_mb", 64)) * (1 << 20)
        self.drop = options.get("malformed", "fail") == "drop"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            # sizes and digests may come from the payload, so they aren't judged by headers
            if name in _FIELDS and name not in ("payload_digest", "payload_bytes") and isinstance(f, (EqualTo, EqualNullSafe, In, StringStartsWith, IsNotNull)):
                self.tests.append((type(f).__name__, name, getattr(f, "value", None)))
            else:
                yield f

    def wanted(self, headers: dict[str, str]) -> bool:
        for kind, name, value in self.tests:
            have = header_value(headers, name)
            if kind == "EqualNullSafe":
                ok = have == value
            elif have is None:
                ok = False
            elif kind == "In":
                ok = have in value
            elif kind == "StringStartsWith":
                ok = have.startswith(value)
            else:
                ok = kind == "IsNotNull" or have == value
            if not ok:
                return False
        return True

    def partitions(self):
        fs, root = filesystem(self.path)
        infos = fs.get_file_info(pafs.FileSelector(root, recursive=True)) if fs.get_file_info(root).type == pafs.FileType.Directory else [fs.get_file_info(root)]
        files = sorted((x.path, x.size) for x in infos if x.type == pafs.FileType.File and x.base_name[0] not in "._" and (x.base_name.endswith((".warc", ".warc.gz"))))
        groups, size = [], 0
        for path, n in files:
            if not groups or size + n > self.split:
                groups.append([])
                size = 0
            groups[-1].append(path)
            size += n
        return [Files(g) for g in groups] or [Files([])]

    def read(self, partition):
        fs, _ = filesystem(self.path)
        body = bool(_FROM_BODY & set(self.names)) or "payload" in self.names
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(self.schema)
        rows: list[list] = [[] for _ in self.names]
        held = 0
        for path in partition.paths:
            with fs.open_input_file(path) as file:
                for headers, block in self.sound(path, records(file, self.wanted, body)):
                    try:
                        values = self.row(headers, block)
                    except Malformed as e:
                        if self.drop:
                            continue
                        raise ValueError(f"{path}: {e}") from e
                    for out, value in zip(rows, values, strict=True):
                        out.append(value)
                    held += len(block or b"")
                    if len(rows[0]) >= _BATCH_ROWS or held >= _BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(rows, arrow, strict=True)], schema=arrow)
                        rows, held = [[] for _ in self.names], 0
        if rows and rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(rows, arrow, strict=True)], schema=arrow)

    def sound(self, path: str, found):
        """The records up to the first whose bytes can't be read."""
        try:
            yield from found
        except (Malformed, zlib.error, struct.error) as e:
            if not self.drop:
                raise ValueError(f"{path}: {e}") from e

    def row(self, headers: dict[str, str], block: bytes | None) -> list:
        head, payload, status = b"", None, None
        if block is not None and headers.get("content-type", "").startswith("application/http"):
            head, _, payload = block.partition(b"\r\n\r\n")
            first = head.split(b"\r\n", 1)[0].split()
            status = int(first[1]) if len(first) > 1 and first[1].isdigit() else None
        elif block is not None:
            payload = block
        full = payload is not None and headers.get("warc-type") != "revisit"
        out = []
        for name in self.names:
            if name == "payload":
                out.append(payload if full else None)
            elif name == "http_status":
                out.append(status)
            elif name == "headers":
                out.append(list(headers.items()))
            elif name == "payload_bytes" and full:
                out.append(len(payload))
            elif name == "payload_digest" and full:
                out.append(hashlib.sha1(payload).hexdigest())
            else:
                out.append(header_value(headers, name))
        return out


@dataclass
class Written(WriterCommitMessage):
    paths: list


class WarcWriter(DataSourceArrowWriter):
    """Takes rows (page_id, url, payload, record_type, refers_to, payload_digest)."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.roll = float(options.get("roll_mb", 64)) * (1 << 20)
        self.level = int(options.get("level", 3))
        self.date = options.get("date", "2000-01-01T00:00:00Z")

    def write(self, iterator):
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        name, paths, out, size = uuid.uuid4().hex, [], None, 0
        try:
            for batch in iterator:
                columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
                for i in range(batch.num_rows):
                    page_id, url, payload, kind, refers, digest = (columns[c][i].as_py() for c in ("page_id", "url", "payload", "record_type", "refers_to", "payload_digest"))
                    data = member(record(page_id, url, payload or b"", kind, refers, digest, self.date), self.level)
                    if out is None or size + len(data) > self.roll:
                        if out is not None:
                            out.close()
                        paths.append(f"{root}/.part-{name}-{len(paths):05d}.warc.gz")
                        out, size = fs.open_output_stream(paths[-1], compression=None, buffer_size=1 << 20), 0
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return Written(paths)

    def commit(self, messages):
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        for m in messages:
            for p in m.paths if m else []:
                folder, _, name = p.rpartition("/")
                fs.move(p, f"{folder}/{name[1:]}")

    def abort(self, messages):
        fs, _ = filesystem(self.path)
        for m in messages:
            for p in m.paths if m else []:
                fs.delete_file(p)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        if overwrite:
            fs, root = filesystem(self.options["path"])
            if fs.get_file_info(root).type == pafs.FileType.Directory:
                fs.delete_dir_contents(root)
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


_BROADCAST_ROWS = 200_000


def planned(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """Rows for the writer: which pages are responses and which revisit one with the same payload.

    Groups of equal payloads are found from digests alone, combined before they are shuffled. Only groups with
    several pages are joined back: broadcast if they are few (counted first), else by a join that Spark can split.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("payload_digest"))
    long = F.octet_length("payload") >= least
    # a second hash keeps payloads apart that were made to share a digest
    same = F.when(long, F.xxhash64("payload")).alias("__check")
    groups = rows.where(long).groupBy(F.col("payload_digest"), same).agg(F.max("page_id").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    from assayer.llm.shared import checkpointed

    groups = checkpointed(groups)
    side = F.broadcast(groups) if groups.count() <= _BROADCAST_ROWS else groups
    joined = rows.withColumn("__check", same).join(side, ["payload_digest", "__check"], "left")
    again = F.col("__first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__first"))
    return joined.select("page_id", "url", "payload", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("__first")).alias("refers_to"), "payload_digest")


def write(pages: DataFrame, path: str, **options: str) -> None:
    register(pages.sparkSession)
    planned(pages).write.format("warc").mode("append").options(**options).save(path)


def read(spark: SparkSession, path: str, schema: str = SCHEMA, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("warc").schema(schema).options(**options).load(path)
