"""A WARC data source: writes archives from rows, and reads archives back.

Writing: each task writes one file of gzip members, a record each, under a temporary name; the
driver's commit gives the files of successful tasks their names, so lost or repeated tasks leave no
records behind. A member's extra field "sl" holds its compressed and plain lengths.

Reading: one partition a file. Filters on record_type and on header columns (equality, IN) are
taken over by the reader. It inflates a record's headers first; a record that the filters
exclude, or whose payload isn't asked for (option payload=false), is skipped by its length without
inflating the rest. Files by other writers, without the "sl" field or not compressed, are read too.

Paths may be local or any URI that pyarrow.fs opens. Needs spark.sql.python.filterPushdown.enabled
for the filters to reach the reader (write_read sets it).

Repeated rows are written as often as they occur. An empty table makes no response or revisit records. Payloads of any
length are held one at a time by the reader and the writer.

Nulls: a null payload is the empty one, a null target URI or page id leaves its header out. A
payload's digest is always that of the full payload, also for revisits, which carry none.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import materialise, work_dir

SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
READ_SCHEMA = "file string, record_type string, record_id string, target_uri string, payload_digest string, page_id string, refers_to string, payload_bytes long, payload binary"
#: Columns that come from one header each, so that filters on them are decided before the payload.
HEADER_OF = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "page_id": "page-id", "refers_to": "refers-to-page-id"}


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path:
        return pafs.LocalFileSystem(), path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, salt: str) -> str:
    return f"<{uuid.uuid5(SPACE, f'page/{page_id}' if page_id is not None else salt).urn}>"


def member(record: bytes, level: int) -> bytes:
    """One gzip member whose extra field tells its whole compressed and plain length."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(record))
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def clean_uri(uri: str) -> str:
    """The URI without characters that would end or fold its header line."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in uri)


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str


class WarcWriter(DataSourceArrowWriter):
    """Columns: page_id long, url string, payload binary, refers_to long (null: a response)."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.date = options["path"], options.get("date", "2024-01-01T00:00:00Z")
        self.level = int(options.get("level", "5"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        name = uuid.uuid4().hex
        temporary, final = f"_temporary-{name}.warc.gz", f"records-{name}.warc.gz"
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{temporary}", compression=None) as out:
            info = [("WARC-Record-ID", record_id(None, name)), ("WARC-Date", self.date), ("Content-Type", "application/warc-fields")]
            out.write(member(record("warcinfo", info, b"format: WARC File Format 1.1\r\n"), self.level))
            n = 0
            for batch in iterator:
                at = {k: i for i, k in enumerate(batch.schema.names)}
                ids, urls, refs = (batch.column(at[k]).to_pylist() for k in ("page_id", "url", "refers_to"))
                payloads = batch.column(at["payload"])
                for i, (page, url, ref) in enumerate(zip(ids, urls, refs, strict=True)):
                    n += 1
                    out.write(self.row(page, url, ref, payloads[i].as_py() or b"", f"{name}/{n}"))
        return Written(temporary, final)

    def row(self, page: int | None, url: str | None, ref: int | None, payload: bytes, salt: str) -> bytes:
        # A page that revisits itself (repeated rows) has a record of its own.
        headers = [("WARC-Record-ID", record_id(None if page == ref else page, salt)), ("WARC-Date", self.date), ("Content-Type", "application/http;msgtype=response")]
        headers += [("WARC-Target-URI", clean_uri(url))] if url is not None else []
        headers += [("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}")]
        headers += [("Page-ID", str(page))] if page is not None else []
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        if ref is None:
            return member(record("response", headers, http + payload), self.level)
        headers += [("WARC-Refers-To", record_id(ref, "")), ("Refers-To-Page-ID", str(ref))]
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Truncated", "length")]
        return member(record("revisit", headers, http), self.level)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = filesystem(self.path)
        for m in messages:
            if m is not None:
                fs.move(f"{root}/{m.temporary}", f"{root}/{m.final}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = filesystem(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{root}/{m.temporary}")


@dataclass
class WarcFile(InputPartition):
    path: str
    size: int


class Plain:
    """Bytes of a record that isn't compressed."""

    def __init__(self, source: io.IOBase) -> None:
        self.source, self.start = source, source.tell()

    def take(self, n: int) -> bytes:
        return self.source.read(n)

    def skip(self, n: int) -> None:
        self.source.seek(n, io.SEEK_CUR)

    def close(self, rest: int) -> None:
        self.skip(rest)


class Member:
    """Bytes of a gzip member, inflated only as far as they are taken."""

    CHUNK = 1 << 14

    def __init__(self, source: io.IOBase) -> None:
        self.source, self.start, self.size = source, source.tell(), None
        head = source.read(10)
        flags = head[3]
        if flags & 4:
            extra = source.read(struct.unpack("<H", source.read(2))[0])
            while len(extra) >= 4:
                kind, n = struct.unpack("<2sH", extra[:4])
                if kind == b"sl" and n == 8:
                    self.size = struct.unpack("<I", extra[4:8])[0]
                extra = extra[4 + n :]
        for bit in (8, 16):  # file name, comment
            while flags & bit and source.read(1) not in (b"\0", b""):
                pass
        if flags & 2:
            source.read(2)
        self.inflate, self.waiting = zlib.decompressobj(-15), b""

    def take(self, n: int) -> bytes:
        parts, got = [], 0
        while got < n and not self.inflate.eof:
            data = self.waiting or self.source.read(self.CHUNK)
            if not data:
                raise EOFError("a gzip member ends early")
            parts.append(self.inflate.decompress(data, n - got))
            got += len(parts[-1])
            self.waiting = self.inflate.unconsumed_tail
        return b"".join(parts)

    def close(self, rest: int) -> None:
        """Go to the next member; the bytes left are not inflated if the member's size is known."""
        if self.size is not None:
            self.source.seek(self.start + self.size)
            return
        while not self.inflate.eof:
            self.take(1 << 16)
        self.source.seek(self.source.tell() - len(self.inflate.unused_data) + 8)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.payload = options.get("payload", "true") == "true"
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column not in HEADER_OF:
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.wanted[column] = self.wanted.get(column, values) & values

    def partitions(self) -> list[InputPartition]:
        fs, root = filesystem(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=False, allow_not_found=True))
        files = [x for x in found if x.is_file and x.base_name[0] not in "._" and x.base_name.endswith((".warc", ".warc.gz"))]
        return [WarcFile(x.path, x.size) for x in sorted(files, key=lambda x: (-x.size, x.path))] or [WarcFile("", 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        rows: list[tuple] = []
        held = 0
        fs, _ = filesystem(self.path)
        with fs.open_input_file(partition.path) as source:
            while source.tell() < partition.size:
                row = self.next_record(source, partition.path)
                if row is not None:
                    rows.append(row)
                    held += len(row[8] or b"")
                if rows and (len(rows) >= 1000 or held > 8 << 20):
                    yield self.batch(rows)
                    rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def next_record(self, source: io.IOBase, path: str) -> tuple | None:
        magic = source.read(2)
        source.seek(source.tell() - 2)
        body = Member(source) if magic == b"\x1f\x8b" else Plain(source)
        head = b""
        while b"\r\n\r\n" not in head:
            more = body.take(512)
            if not more:
                raise ValueError(f"{path}: a record without an end of its headers")
            head += more
        top, _, ahead = head.partition(b"\r\n\r\n")
        headers = {}
        for line in top.decode("utf-8", "replace").split("\r\n")[1:]:
            k, _, v = line.partition(":")
            headers[k.strip().lower()] = v.strip()
        length = int(headers["content-length"])
        rest = length + 4 - len(ahead)
        value = {c: headers.get(h) for c, h in HEADER_OF.items()}
        if value["payload_digest"]:
            value["payload_digest"] = value["payload_digest"].removeprefix("sha1:")
        if any(value[c] not in allowed for c, allowed in self.wanted.items()):
            body.close(rest)
            return None
        if isinstance(body, Plain) and rest < 0:
            source.seek(rest, io.SEEK_CUR)
            ahead, rest = ahead[:rest], 0
        http = headers.get("content-type", "").startswith("application/http")
        while http and b"\r\n\r\n" not in ahead[:length] and len(ahead) < length:
            more = body.take(min(512, length - len(ahead)))
            ahead, rest = ahead + more, rest - len(more)
        payload, size = None, None
        start = ahead.find(b"\r\n\r\n") + 4 if http else 0
        if http:
            stated = [x.split(b":")[1] for x in ahead[:start].split(b"\r\n") if x.lower().startswith(b"content-length:")]
            size = int(stated[0]) if stated else None
        if value["record_type"] != "revisit":
            size = length - start
            if self.payload:
                whole = ahead + (body.take(length - len(ahead)) if len(ahead) < length else b"")
                rest = length + 4 - len(whole)
                payload = whole[start:length]
                if value["payload_digest"] and payload_digest(payload) != value["payload_digest"]:
                    raise ValueError(f"{path}: the payload of {value['record_id']} does not have its digest")
        body.close(rest)
        return (path, value["record_type"], value["record_id"], value["target_uri"], value["payload_digest"], value["page_id"], value["refers_to"], size, payload)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
        types = [pa.string()] * 7 + [pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def with_revisits(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, payload, refers_to: the smallest page_id of an equal payload, null for that page itself.

    Of several rows with that page_id the one with the least url is the response, of equal rows any one; all others
    revisit it. A payload that only rows without an id have is a response each time. The smallest ids are gathered
    per SHA-1 with partial aggregation, for payloads that occur more than once; both sides of the join come from
    plain exchanges, so a payload that a third of the pages share is split by adaptive execution. Equal rows
    that could all be the response (a page repeated whole) are counted, and made again from one of them."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload")
    )
    keyed = rows.withColumn("digest", F.sha1("payload"))
    counted = keyed.where(F.octet_length("payload") >= least_bytes).groupBy("digest", "page_id", "url").agg(F.count("*").alias("times"))
    order = F.struct(F.isnull("page_id"), F.col("page_id"), F.isnotnull("url"), F.col("url"))
    first = counted.groupBy("digest").agg(F.sum("times").alias("n"), F.min_by(F.struct("page_id", "url", "times"), order).alias("f"))
    first = first.where("n > 1 AND f.page_id IS NOT NULL").select("digest", F.col("f.page_id").alias("first_id"), F.col("f.url").alias("first_url"), F.col("f.times").alias("times"))
    first = materialise(first)
    joined = keyed.join(first, "digest", "left")
    head = F.col("first_id").isNull() | (F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url")))
    repeated = head & (F.coalesce("times", F.lit(1)) > 1)
    out = joined.where(~repeated).select("page_id", "url", "payload", F.when(~head, F.col("first_id")).alias("refers_to"))
    ties = first.where("times > 1")
    if ties.isEmpty():
        return out
    again = joined.where(repeated).groupBy("digest").agg(*[F.first(c).alias(c) for c in ("page_id", "url", "payload", "times")])
    again = again.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return out.unionByName(again.select("page_id", "url", "payload", F.when(F.col("i") > 1, F.col("page_id")).alias("refers_to")))


def write_warc(pages: DataFrame, path: str) -> None:
    register(pages.sparkSession)
    pages.select("page_id", "url", "payload", "refers_to").write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def write_read(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archives of pages in the shared work folder, read back with their payloads (which checks the digests)."""
    spark = pages.sparkSession
    path = work_dir(spark)
    write_warc(with_revisits(pages, least_bytes), path)
    return read_warc(spark, path).where(F.col("record_type").isin("response", "revisit"))
