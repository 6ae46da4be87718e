"""Web archives (WARC 1.1) as a Spark data source, written in Python.

``spark.dataSource.register(WarcSource)``, then ``spark.read.format("warc").schema(..).load(folder)``.

Reading.  Partitions are planned by files: small files share one, up to ``SPLIT`` bytes, a larger
one stands alone; a task reads its files as streams.  Conditions on ``warc_type``, ``record_id``,
``target_uri``, ``date``, ``refers_to``, ``content_type`` and ``payload_digest`` are pushed down: those that :func:`read` is
given, and with the option ``pushdown`` those that Spark pushes, in sessions whose
``spark.sql.python.filterPushdown.enabled`` is on.  (Spark 4.1 then mixes up the conditions of two scans of one loaded
frame in one query, so it is off unless asked for.)  Headers are parsed first; a
record that fails a condition, or of which only headers are asked for, is skipped without
unpacking its payload: plain files by ``Content-Length``, gzip members that carry their packed
length (the ``sl`` extra field, as :class:`WarcSource` writes them) by that.  Members without it are
unpacked to find their end, but not kept.  Columns are pruned by the schema that is given.

Writing.  Each task streams its rows to a file of its own attempt, named ``.part``; the commit renames
the files of successful attempts, and an abort deletes them, so lost executors leave nothing behind.
Files are gzip members, a record each.  Folders may be in any store that ``pyarrow.fs`` opens by URI.

:func:`write_pages` stores pages as ``response`` records and equal payloads as ``revisit`` records
that refer to the response with the greatest page_id.

Defined results.  Null html: an empty payload.  Null page_id: counts as least; a response if no equal
payload has an id.  Repeated rows: rows that share page_id and payload are all responses or all
revisits.  Null url: no target.  Control characters in urls are percent-encoded.  Empty tables:
an archive without records.  Very long payloads: whole.  Extra columns are not read.  Damaged
files raise an error that names file and offset.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from oscilla.llm import common
from oscilla.sources.stores import opened, qualified

SCHEMA = "warc_type string, record_id string, target_uri string, date string, refers_to string, content_type string, payload_digest string, content_length long, payload_length long, headers map<string,string>, payload binary"
#: Bytes of small files that share a partition.
SPLIT = 128 << 20
#: Bytes that are read from a store at once, and unpacked at once.
READ, UNPACK = 1 << 18, 1 << 16
#: Bytes of payloads in a batch that is handed to Spark.
HANDED = 4 << 20
#: Header fields of the WARC format behind the columns.
FIELDS = {"warc_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to", "content_type": "content-type", "payload_digest": "warc-payload-digest"}
PAGE = "urn:x-page:"
SALTS = 16


class Damaged(ValueError):
    """A file that is not a WARC file; says where."""


# ---- records ---------------------------------------------------------------------------------


def member(data: Iterable[bytes], level: int = 6) -> bytes:
    """One gzip member with its own packed and plain lengths in the extra field ``sl``."""
    packer, crc, n, out = zlib.compressobj(level, zlib.DEFLATED, -15), 0, 0, []
    for part in data:
        crc, n = zlib.crc32(part, crc), n + len(part)
        out.append(packer.compress(part))
    out.append(packer.flush())
    size = sum(map(len, out)) + 24 + 8
    known = size < 1 << 32 and n < 1 << 32  # else none is stated, and readers unpack
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, *((size, n) if known else (0, 0)))
    return b"".join([head, *out, struct.pack("<II", crc, n & 0xFFFFFFFF)])


def record(fields: list[tuple[str, str]], block: list[bytes]) -> list[bytes]:
    """The bytes of a record: version, headers, block, two line ends."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return [f"WARC/1.1\r\n{head}Content-Length: {sum(map(len, block))}\r\n\r\n".encode(), *block, b"\r\n\r\n"]


class _Source:
    """A file as a stream of plain bytes, one gzip member at a time if packed; can pass over what is not wanted."""

    def __init__(self, f: BinaryIO, size: int, name: str):
        self.f, self.size, self.name = f, size, name
        self.raw, self.base = b"", 0  # bytes read and not used yet, and where they begin
        self.packed = self._fill(2) and self.raw[:2] == b"\x1f\x8b"
        self.skipped = 0  # bytes passed over without unpacking or reading
        self.plain = b""

    def _fill(self, n: int) -> bool:
        while len(self.raw) < n:
            more = self.f.read(max(READ, n - len(self.raw)))
            if not more:
                return False
            self.raw += more
        return True

    def _drop(self, n: int) -> None:
        self.raw, self.base = self.raw[n:], self.base + n

    def fail(self, what: str) -> Damaged:
        return Damaged(f"{what} in {self.name} near byte {self.base}")

    def open_record(self) -> bool:
        """To the start of the next record; false at the end of the file."""
        if not self.packed:
            while self._fill(1) and self.raw[:1] in b"\r\n":  # line ends between records
                self._drop(1)
            return bool(self.raw)
        if not self._fill(1):
            return False
        if not self._fill(18) or self.raw[:3] != b"\x1f\x8b\x08":
            raise self.fail("no gzip member")
        self.member_at, self.member_size = self.base, None
        if self.raw[3] == 4 and self.raw[10:12] == b"\x0c\0" and self.raw[12:14] == b"sl" and self._fill(24):
            self.member_size = struct.unpack("<I", self.raw[16:20])[0]
        self.unpacker, self.plain = zlib.decompressobj(31), b""
        return True

    def _unpack(self) -> bool:
        if self.unpacker.eof:
            return False
        if not self._fill(1):
            raise self.fail("file ends within a gzip member")
        before = len(self.raw)
        try:
            self.plain += self.unpacker.decompress(self.raw, UNPACK)
        except zlib.error as err:
            raise self.fail(f"damaged gzip member ({err})") from err
        rest = self.unpacker.unused_data or self.unpacker.unconsumed_tail
        self.raw, self.base = rest, self.base + before - len(rest)
        return True

    def read_head(self) -> bytes:
        """Up to the empty line that ends the headers."""
        seen = 0
        while True:
            have = self.plain if self.packed else self.raw
            end = have.find(b"\r\n\r\n", max(0, seen - 3))
            if end >= 0:
                self.take(end + 4)
                return have[:end]
            seen = len(have)
            if seen > 1 << 20 or not (self._unpack() if self.packed else self._fill(seen + 1)):
                raise self.fail("headers without an end")

    def take(self, n: int) -> bytes:
        if not self.packed:
            if not self._fill(n):
                raise self.fail("file ends within a record")
            out, _ = self.raw[:n], self._drop(n)
            return out
        parts, have = [self.plain], len(self.plain)
        while have < n:
            self.plain = b""
            if not self._unpack():
                raise self.fail("member ends within a record")
            parts.append(self.plain)
            have += len(self.plain)
        whole = b"".join(parts)
        self.plain = whole[n:]
        return whole[:n]

    def close_record(self, left: int) -> None:
        """Past the rest of the record, ``left`` bytes of block of which are not read."""
        if not self.packed:
            if self.base + left > self.size:
                raise self.fail("file ends within a record")
            if left > len(self.raw):
                self.skipped += left - len(self.raw)
                self.base += left
                self.f.seek(self.base)
                self.raw = b""
            else:
                self._drop(left)
            return
        if self.member_size and not self.unpacker.eof and self.member_at + self.member_size >= self.base:
            to = self.member_at + self.member_size
            if to > self.size:
                raise self.fail("file ends within a gzip member")
            ahead = to - self.base
            self.skipped += ahead
            if ahead > len(self.raw):
                self.f.seek(to)
                self.raw, self.base = b"", to
            else:
                self._drop(ahead)
            return
        while not self.unpacker.eof:
            self.plain = b""
            self._unpack()


def _headers(head: bytes, source: _Source) -> dict[str, str]:
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).split(b"\r\n")
    if not re.fullmatch(rb"WARC/1\.\d+", lines[0]):
        raise source.fail("no WARC version line")
    out: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            out.setdefault(name.strip().lower().decode("utf-8", "replace"), value.strip().decode("utf-8", "replace"))
    return out


def _bare(uri: str | None) -> str | None:
    return uri[1:-1] if uri and uri[0] == "<" and uri[-1] == ">" else uri


def records(f: BinaryIO, size: int, name: str, wanted=lambda row: True, payload: bool = True, lengths: bool = True, verify: bool = False) -> Iterator[dict]:
    """Records of one open file whose header columns satisfy ``wanted``; the block is opened only for what is asked of it.

    ``verify`` holds each payload that is read against its stated SHA-1 (archives of chunked transfers state another one).
    """
    source = _Source(f, size, name)
    while source.open_record():
        headers = _headers(source.read_head(), source)
        try:
            left = int(headers.get("content-length", "x"))
        except ValueError:
            raise source.fail("record without Content-Length") from None
        row = {k: headers.get(v) for k, v in FIELDS.items()}
        row |= {k: _bare(row[k]) for k in ("record_id", "target_uri", "refers_to")}
        row |= {"content_length": left, "headers": headers, "payload_length": None, "payload": None}
        if not wanted(row):
            source.close_record(left)
            continue
        if payload or lengths:
            http, head = (row["content_type"] or "").startswith("application/http"), b""
            if http and left:
                head = source.read_head() + b"\r\n\r\n"
                left -= len(head)
                if left < 0:
                    raise source.fail("HTTP headers longer than their record")
            row["payload_length"] = left
            if row["warc_type"] == "revisit" and http:  # the payload is elsewhere; its length is in the HTTP headers
                said = re.search(rb"(?im)^content-length:[ \t]*(\d+)", head)
                row["payload_length"] = int(said[1]) if said else None
            elif payload:
                row["payload"], left = source.take(left), 0
                if verify and (row["payload_digest"] or "").startswith("sha1:") and row["payload_digest"][5:] != base32_sha1(row["payload"]):
                    raise source.fail(f"payload of {row['record_id']} differs from its digest")
        source.close_record(left)
        yield row


# ---- reading ---------------------------------------------------------------------------------


@dataclass
class Files(InputPartition):
    paths: list[tuple[str, int]]


def _test(f: Filter):
    """A pushed condition as a function of a row of header columns, or None."""
    if len(f.attribute) != 1 or f.attribute[0] not in FIELDS:
        return None
    name, value = f.attribute[0], getattr(f, "value", None)
    has = lambda row: row[name] is not None
    match f:
        case EqualTo():
            return lambda row: has(row) and row[name] == value
        case EqualNullSafe():
            return lambda row: row[name] == value
        case In():
            some = set(value)
            return lambda row: has(row) and row[name] in some
        case IsNull():
            return lambda row: not has(row)
        case IsNotNull():
            return has
        case StringStartsWith():
            return lambda row: has(row) and row[name].startswith(value)
        case GreaterThan():
            return lambda row: has(row) and row[name].encode() > value.encode()
        case GreaterThanOrEqual():
            return lambda row: has(row) and row[name].encode() >= value.encode()
        case LessThan():
            return lambda row: has(row) and row[name].encode() < value.encode()
        case LessThanOrEqual():
            return lambda row: has(row) and row[name].encode() <= value.encode()
    return None


#: Conditions that a reader may be given.
CONDITIONS = {"=": EqualTo, "in": In, "startswith": StringStartsWith, "<": LessThan, "<=": LessThanOrEqual, ">": GreaterThan, ">=": GreaterThanOrEqual}


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.schema, self.filters = schema, []
        for name, how, value in json.loads(options.get("where", "[]")):
            made = CONDITIONS[how]((name,), tuple(value) if how == "in" else value)
            if _test(made) is None:
                raise ValueError(f"no condition on {name} can be pushed down; there are {sorted(FIELDS)}")
            self.filters.append(made)
        self.verify = str(options.get("verify", "false")).lower() == "true"

    def partitions(self) -> list[InputPartition]:
        store, root = opened(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True)) if store.get_file_info(root).type == fs.FileType.Directory else [store.get_file_info(root)]
        if found and found[0].type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = sorted((i.path, i.size) for i in found if i.type == fs.FileType.File and i.path.endswith((".warc", ".warc.gz")))
        out: list[list[tuple[str, int]]] = []
        room = 0
        for path, size in files:
            if not out or size > room:
                out.append([])
                room = self.split
            out[-1].append((path, size))
            room -= size
        return [Files(p) for p in out] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        tests = [_test(f) for f in self.filters]
        schema = to_arrow_schema(self.schema)
        names = set(schema.names)
        rows: list[dict] = []
        held = 0
        for path, size in partition.paths:
            with store.open_input_file(path) as f:
                for row in records(f, size, path, lambda r: all(t(r) for t in tests), "payload" in names, "payload_length" in names, self.verify):
                    rows.append(row)
                    held += len(row["payload"] or b"") + 500
                    if held >= HANDED:
                        yield pa.RecordBatch.from_arrays([_column(rows, s) for s in schema], schema=schema)
                        rows, held = [], 0
        yield pa.RecordBatch.from_arrays([_column(rows, s) for s in schema], schema=schema)


class PushedWarcReader(WarcReader):
    """A reader that Spark hands conditions to, for sessions whose ``spark.sql.python.filterPushdown.enabled`` is on."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if _test(f) is None:
                yield f
            else:
                self.filters.append(f)


def _column(rows: list[dict], wanted: pa.Field) -> pa.Array:
    values = [r.get(wanted.name) for r in rows]
    if wanted.name == "headers":
        values = [list(v.items()) for v in values]
    return pa.array(values, wanted.type)


# ---- writing ---------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    path: str | None
    n: int = 0


@dataclass
class WarcWriter(DataSourceArrowWriter):
    """Rows (warc_type, record_id, target_uri, refers_to, payload_length, payload_digest, payload) to one file a task."""

    path: str
    date: str
    level: int = 6
    done: list[str] = field(default_factory=list)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = opened(self.path)
        batches = (b for b in iterator if b.num_rows)
        batch = next(batches, None)
        if batch is None:
            return Written(None)
        store.create_dir(root, recursive=True)
        path, n = f"{root}/part-{uuid.uuid4().hex}.warc.gz", 0
        with store.open_output_stream(f"{path}.part") as out:
            while batch is not None:
                for row in batch.to_pylist():
                    out.write(member(self._record(row), self.level))
                    n += 1
                batch = next(batches, None)
        return Written(path, n)

    def _record(self, row: dict) -> list[bytes]:
        body = row["payload"] or b""
        fields = [("WARC-Type", row["warc_type"]), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Date", self.date)]
        if row["target_uri"]:
            fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["target_uri"])))
        fields.append(("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"))
        if row["refers_to"]:
            fields += [("WARC-Refers-To", f"<{row['refers_to']}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        fields.append(("Content-Type", "application/http; msgtype=response"))
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_length']}\r\n\r\n".encode()
        return record(fields, [http, body])

    def commit(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        store.create_dir(root, recursive=True)
        for m in messages:
            if m and m.path:
                store.move(f"{m.path}.part", m.path)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = opened(self.path)
        for m in messages:
            if m and m.path:
                store.delete_file(f"{m.path}.part")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        kind = PushedWarcReader if str(self.options.get("pushdown", "false")).lower() == "true" else WarcReader
        return kind(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only appended to")
        return WarcWriter(self.options["path"], self.options.get("date", "1970-01-01T00:00:00Z"), int(self.options.get("level", 6)))


def read(spark: SparkSession, path: str, columns: str = SCHEMA, where: list[tuple[str, str, object]] | None = None, verify: bool = False) -> DataFrame:
    """Records of a file or folder; ``columns`` is a schema, and what it leaves out is not parsed or unpacked.

    ``where``: conditions on header columns that all hold, such as ("warc_type", "=", "response") or ("target_uri", "startswith",
    "https://"); the others are "in", "<", "<=", ">", ">=".  They decide before a payload is touched.
    """
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").schema(columns).option("verify", verify).option("where", json.dumps(where or [])).load(qualified(spark, path))


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _with_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From hexadecimal digests to records' columns."""
    for b in common.record_batches(batches):
        digest = [base64.b32encode(bytes.fromhex(h)).decode() for h in b.column("hex").to_pylist()]
        yield b.append_column("payload_digest", pa.array(digest)).drop_columns(["hex"])


def write_pages(pages: DataFrame, path: str, key: str = "page_id", html: str = "html", url: str = "url", least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> str:
    """Each page as a response record, or as a revisit of the equal payload with the greatest id (payloads of ``least_bytes`` and more)."""
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    common.bound_batches(spark)
    body = F.encode(F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")), "utf-8")
    rows = common.spread(pages).select(F.col(f"`{key}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("target_uri"), body.alias("payload"))
    rows = rows.withColumn("hex", F.sha1("payload")).withColumn("payload_length", F.octet_length("payload").cast("long"))
    # payloads that occur again, one row each; combined before the shuffle, so a hot payload is no hot group
    again = rows.where(F.col("payload_length") >= least_bytes).groupBy("hex").agg(F.max("page_id").alias("best"), F.count("*").alias("n")).where("n > 1")
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")
    again = again.select(F.col("hex").alias("of"), "best", F.explode(salts).alias("of_salt"))
    # pages of a hot payload meet its row in SALTS places; few repeated payloads are broadcast by their measured size instead
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "target_uri"), F.lit(SALTS)))
    rows = rows.join(again, (F.col("hex") == F.col("of")) & (F.col("salt") == F.col("of_salt")), "left")
    old = F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best"))
    name = lambda c: F.concat(F.lit(PAGE), F.coalesce(F.col(c).cast("string"), F.lit("none")))
    out = rows.select(
        F.when(old, "revisit").otherwise("response").alias("warc_type"), name("page_id").alias("record_id"), "target_uri",
        F.when(old, name("best")).alias("refers_to"), "payload_length", "hex", F.when(~old, F.col("payload")).alias("payload"),
    )
    schema = "warc_type string, record_id string, target_uri string, refers_to string, payload_length long, payload binary, payload_digest string"
    out.mapInArrow(_with_digests, schema).write.format("warc").option("date", date).mode("append").save(qualified(spark, path))
    return path


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`write_pages` stored: page_id, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits)."""
    number = lambda c: F.substring(F.col(c), len(PAGE) + 1, 20).try_cast("long")
    digest = F.regexp_replace("payload_digest", "^sha1:", "")
    columns = "warc_type string, record_id string, refers_to string, payload_digest string, payload_length long, payload binary"
    return read(spark, path, columns, [("warc_type", "in", ["response", "revisit"])], verify=True).select(
        number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), digest.alias("payload_digest"), F.col("warc_type").alias("record_type"), number("refers_to").alias("refers_to"), "payload"
    )
