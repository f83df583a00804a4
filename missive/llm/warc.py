"""Operator 13: WARC archives as a PySpark Python data source.

``spark.read.format("warc")`` reads a folder of ``.warc`` and ``.warc.gz``
files (WARC 1.0 and 1.1), ``df.write.format("warc")`` writes one. Both reach
any store that ``pyarrow.fs`` knows by its address (local folders, HDFS,
object stores).

Reading: files are planned into partitions of about ``partitionBytes`` each
(a file is never split; the writer starts a new one at ``fileBytes``). Filters
on the record type and other header columns (equality, IN, prefix, IS NOT
NULL) are pushed down. A task parses a record's header first; if a pushed
filter rejects it, or no asked column needs the payload, the block is not
decoded: it is skipped by a seek in plain files and, in gzip files, by the
compressed length that the writer keeps in the member's ``sl`` extra field (a
member without it is inflated and thrown away in pieces). Name fewer columns
in ``.schema(...)`` to read less: Spark does not prune a Python source.

Writing: a task attempt writes files with names of their own, and the commit
lists the files of the attempts that won in ``_manifest``, which readers
follow; a lost executor's files are never read. Responses and resources carry
the payload after an HTTP header; revisits only the HTTP header.

``dedup_records`` decides which pages are responses and which revisit them.
Digests are compared, not payloads; revisits are made from narrow rows, so the
html of a page moves between tasks only when the groups of equal pages are too
many to broadcast (then pages of groups with over a thousandth of all rows
still do not move).

Defined cases: a null html is an empty payload; of equal payloads the largest
``page_id`` is the response, null ranks lowest; of rows that repeat the id too,
the largest url, and of entirely equal rows one, are the response; payloads
under ``min_bytes`` are all responses; a null url or id leaves its header out;
line ends in a url are written as %0D and %0A; an empty table gives an archive
without records; a payload may be of any length that a row can have and may
itself look like WARC records; only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, In,
                                    InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage)
from pyspark.sql.types import StructType

from missive.llm.common import BROADCAST_ROWS, HEAVY_ONE_IN, quoted, small_batches
from missive.session import materialise, scratch_path

#: Columns a reader knows. Those in ``FIELDS`` are header fields of the WARC format (fixed names).
SCHEMA = ("record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, "
          "content_length long, headers map<string,string>, payload_bytes long, computed_digest string, payload binary")
FIELDS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "content_length": "Content-Length",
}
#: Columns for which the payload must be read.
FROM_PAYLOAD = {"computed_digest", "payload"}
#: Rows that a writer takes.
WRITE_SCHEMA = ("record_type string, record_id string, target_uri string, date string, refers_to string, "
                "sha1 string, payload_bytes long, payload binary, extra map<string,string>")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
MANIFEST = "_manifest"
FILE_BYTES = 256 << 20
PARTITION_BYTES = 64 << 20
_PIECE = 1 << 20
_BATCH_BYTES = 8 << 20


def _store(path: str):
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def base32_of(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


# ---------------------------------------------------------------------------
# Writing
# ---------------------------------------------------------------------------

def record_bytes(row: dict) -> tuple[bytes, bytes]:
    """The header and the block of a record."""
    payload = row["payload"] or b""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n").encode()
    block = http if row["record_type"] == "revisit" else http + payload
    lines = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"] or f"<urn:uuid:{uuid.uuid4()}>"),
             ("WARC-Date", row["date"]), ("WARC-Target-URI", row["target_uri"]),
             ("WARC-Payload-Digest", "sha1:" + base32_of(row["sha1"])), ("WARC-Refers-To", row["refers_to"]),
             ("WARC-Profile", REVISIT_PROFILE if row["record_type"] == "revisit" else None),
             *(row["extra"] or ()), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.0\r\n" + "".join(f"{k}: {_one_line(v)}\r\n" for k, v in lines if v is not None) + "\r\n"
    return head.encode(), block


def _one_line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """A gzip member whose ``sl`` extra field holds its compressed and its whole length (zeros, for none, beyond 4 GB)."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    total = 10 + 2 + 12 + len(body) + 8
    lengths = (total, len(data)) if max(total, len(data)) < 1 << 32 else (0, 0)
    return (b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H2sHII", 12, b"sl", 8, *lengths) + body
            + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF))


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"].rstrip("/")
        self.gzip = options.get("compression", "gzip") == "gzip"
        self.file_bytes = int(options.get("filebytes", FILE_BYTES))
        self.before = [] if overwrite else _listed(self.path)   # before any task writes

    def write(self, iterator):
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        files, out = [], None
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or files[-1][1] >= self.file_bytes:
                    if out is not None:
                        out.close()
                    name = f"part-{uuid.uuid4().hex}.warc" + (".gz" if self.gzip else "")
                    files.append([name, 0])
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                head, block = record_bytes(row)
                data = head + block + b"\r\n\r\n"
                files[-1][1] += out.write(gzip_member(data) if self.gzip else data)
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages):
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        files = self.before + [tuple(f) for m in messages if m is not None for f in m.files]
        with store.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages):
        store, root = _store(self.path)
        for m in messages:
            for name, _ in (m.files if m is not None else []):
                store.delete_file(f"{root}/{name}")


# ---------------------------------------------------------------------------
# Reading
# ---------------------------------------------------------------------------

def _listed(path: str) -> list[tuple[str, int]]:
    """(name, bytes) of an archive's files: those of the manifest, without one all WARC files."""
    store, root = _store(path)
    root = root.rstrip("/")
    there = {i.path[len(root):].lstrip("/"): i.size for i in store.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
             if i.type == pafs.FileType.File}
    if MANIFEST in there:
        with store.open_input_stream(f"{root}/{MANIFEST}") as f:
            return [tuple(x) for x in json.loads(f.read())]
    return sorted((n, s) for n, s in there.items() if n.endswith((".warc", ".warc.gz")))


class _Member:
    """Bytes of one gzip member, inflated piece by piece."""

    def __init__(self, raw):
        self.raw, self.start = raw, raw.tell()
        head = raw.read(24)
        self.skip_to = None
        if len(head) == 24 and head[3] & 4 and head[12:14] == b"sl" and head[10:12] == b"\x0c\x00":
            length = struct.unpack("<I", head[16:20])[0]
            self.skip_to = self.start + length if length else None
        raw.seek(self.start)
        self.inflate, self.buffer, self.ended = zlib.decompressobj(31), b"", False

    def _more(self) -> bool:
        if self.ended:
            return False
        data = self.inflate.unconsumed_tail or self.raw.read(4096 if not self.buffer else _PIECE)
        piece = self.inflate.decompress(data, _PIECE)
        if not data and not piece and not self.inflate.eof:
            raise ValueError("a WARC file ends inside a gzip member")
        self.buffer += piece
        if self.inflate.eof:
            self.ended = True
            self.raw.seek(self.raw.tell() - len(self.inflate.unused_data))
        return True

    def line(self) -> bytes:
        while b"\n" not in self.buffer and self._more():
            pass
        line, _, self.buffer = self.buffer.partition(b"\n")
        return line.rstrip(b"\r")

    def take(self, n: int) -> bytes:
        pieces, have = [self.buffer], len(self.buffer)
        self.buffer = b""
        while have < n and self._more():
            pieces.append(self.buffer)
            have += len(self.buffer)
            self.buffer = b""
        data = b"".join(pieces)
        if have < n:
            raise ValueError("a WARC record is cut short")
        self.buffer = data[n:]
        return data[:n]

    def finish(self, _rest: int) -> None:
        if self.ended:
            return
        if self.skip_to is not None:
            self.raw.seek(self.skip_to)
            return
        while not self.ended:
            self.buffer = b""
            self._more()


class _Plain:
    """A record of a plain file; skipping is a seek."""

    def __init__(self, raw):
        self.raw = raw

    def line(self) -> bytes:
        return self.raw.readline().rstrip(b"\r\n")

    def take(self, n: int) -> bytes:
        data = self.raw.read(n)
        if len(data) < n:
            raise ValueError("a WARC record is cut short")
        return data

    def finish(self, rest: int) -> None:
        self.raw.seek(rest + 4, 1)   # two line ends close a record


def parse_head(source) -> dict[str, str]:
    """The named fields of a record's header, by their names as written (continued lines joined)."""
    version = source.line()
    if not version.startswith(b"WARC/"):
        raise ValueError("not a WARC record: " + version[:40].decode("latin-1"))
    fields, last = {}, None
    while line := source.line():
        text = line.decode("utf-8", "replace")
        if text[0] in " \t" and last:
            fields[last] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            last = name.strip()
            fields[last] = value.strip()
    return fields


def records(raw, gzip: bool, wanted, need_payload: bool, need_http: bool):
    """(fields, http head, payload) of the records whose fields ``wanted`` accepts; unread parts are None."""
    end = raw.size()
    while raw.tell() < end:
        source = _Member(raw) if gzip else _Plain(raw)
        fields = parse_head(source)
        canonical = {k.lower(): v for k, v in fields.items()}
        length = int(canonical.get("content-length", "0"))
        if not wanted(canonical):
            source.finish(length)
            continue
        http, payload, left = None, None, length
        is_http = canonical.get("content-type", "").startswith("application/http")
        if need_payload:
            block, left = source.take(length), 0
            http, payload = _split_http(block) if is_http else (b"", block)
        elif need_http and is_http:
            http = b""
            while left and b"\r\n\r\n" not in http:   # the head alone
                piece = source.take(min(left, 1024))
                http, left = http + piece, left - len(piece)
            http = _split_http(http)[0]
        source.finish(left)
        yield fields, http, payload


def _split_http(block: bytes) -> tuple[bytes, bytes]:
    head, sep, body = block.partition(b"\r\n\r\n")
    return (head, body) if sep else (block, b"")


def _http_length(head: bytes | None) -> int | None:
    for line in (head or b"").split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return int(value)
    return None


@dataclass
class Files(InputPartition):
    names: list


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path = options["path"].rstrip("/")
        self.partition_bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.columns = schema.names
        self.schema = schema
        self.tests = []   # (header field, kind, value)

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in FIELDS and column != "content_length" and isinstance(f, (EqualTo, EqualNullSafe, In, StringStartsWith, IsNotNull)):
                self.tests.append((FIELDS[column].lower(), type(f).__name__, getattr(f, "value", None)))
            else:
                yield f

    def _wanted(self, fields: dict) -> bool:
        for name, kind, value in self.tests:
            got = fields.get(name)
            if kind == "IsNotNull":
                fine = got is not None
            elif kind == "In":
                fine = got is not None and got in value
            elif kind == "StringStartsWith":
                fine = got is not None and got.startswith(value)
            else:
                fine = got == value and (got is not None or kind == "EqualNullSafe")
            if not fine:
                return False
        return True

    def partitions(self):
        groups, size = [], 0
        for name, n in _listed(self.path):
            if not groups or size + n > self.partition_bytes:
                groups.append([])
                size = 0
            groups[-1].append(name)
            size += n
        return [Files(g) for g in groups] or [Files([])]

    def read(self, partition):
        from pyspark.sql.pandas.types import to_arrow_schema
        schema = to_arrow_schema(self.schema)
        store, root = _store(self.path)
        need_payload = bool(FROM_PAYLOAD & set(self.columns))
        need_http = "payload_bytes" in self.columns
        rows, size = [], 0
        for name in partition.names:
            with store.open_input_file(f"{root}/{name}") as f:
                raw = _Buffered(f)
                for fields, http, payload in records(raw, name.endswith(".gz"), self._wanted, need_payload, need_http):
                    rows.append(self._row(fields, http, payload))
                    size += 1024 + len(payload or b"")
                    if size > _BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def _row(self, fields: dict, http: bytes | None, payload: bytes | None) -> dict:
        canonical = {k.lower(): v for k, v in fields.items()}
        row = {}
        for c in self.columns:
            if c in FIELDS:
                row[c] = canonical.get(FIELDS[c].lower())
            elif c == "headers":
                row[c] = list(fields.items())
            elif c == "payload":
                row[c] = payload
            elif c == "payload_bytes":
                at_head = _http_length(http)
                row[c] = at_head if at_head is not None else (len(payload) if payload is not None else int(canonical.get("content-length", "0")))
            elif c == "computed_digest":
                row[c] = "sha1:" + base32_of(hashlib.sha1(payload).hexdigest()) if payload is not None else None
            else:
                raise ValueError(f"a WARC record has no column {c!r}")
        if row.get("content_length") is not None:
            row["content_length"] = int(row["content_length"])
        return row


class _Buffered(io.BufferedReader):
    """A buffered view of a store's file with its size; short seeks stay in the buffer."""

    def __init__(self, file):
        super().__init__(_Raw(file), 256 << 10)
        self._bytes = file.size()

    def size(self) -> int:
        return self._bytes


class _Raw(io.RawIOBase):
    def __init__(self, file):
        self._file = file

    def readable(self):
        return True

    def seekable(self):
        return True

    def readinto(self, buffer):
        return self._file.readinto(buffer)

    def seek(self, offset, whence=0):
        self._file.seek(offset, whence)
        return self._file.tell()

    def tell(self):
        return self._file.tell()


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options, schema)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """The records of an archive; name only the columns that are needed."""
    register(spark)
    return spark.read.format("warc").schema(schema).load(path)


def write_warc(rows: DataFrame, path: str, mode: str = "append", **options) -> None:
    """Write records (``WRITE_SCHEMA``) into the archive at ``path``."""
    register(rows.sparkSession)
    small_batches(rows.sparkSession)
    names = [part.split()[0] for part in WRITE_SCHEMA.replace("map<string,string>", "map").split(", ")]
    rows.select(*names).write.format("warc").mode(mode).options(**options).save(path)


# ---------------------------------------------------------------------------
# Pages to records
# ---------------------------------------------------------------------------

def dedup_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
                  min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Records (``WRITE_SCHEMA``) of pages: one response of each payload, revisits for its equals."""
    rows = pages.select(quoted(page_id).alias("page_id"), quoted(url).alias("url"),
                        F.encode(F.coalesce(quoted(html), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("payload_bytes", F.length("payload").cast("long"))
    keys = materialise(rows.filter(F.col("payload_bytes") >= min_bytes)
                       .groupBy("sha1", "payload_bytes", "page_id", "url").agg(F.count(F.lit(1)).alias("copies")), "warc-keys")
    groups = materialise(
        keys.groupBy("sha1", "payload_bytes").agg(F.max(F.struct("page_id", "url", "copies")).alias("best"), F.sum("copies").alias("members"))
        .filter("members > 1"), "warc-groups")

    is_best = F.col("page_id").eqNullSafe(F.col("best.page_id")) & F.col("url").eqNullSafe(F.col("best.url"))
    narrow = groups.select("sha1", "best")
    total = keys.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    n_groups, n_equal = groups.agg(F.count(F.lit(1)), F.count_if(F.col("best.copies") > 1)).first()
    heavy = groups.filter(F.col("members") * HEAVY_ONE_IN > total)
    tagged = _left_join(rows, narrow, heavy, n_groups)
    first = tagged.filter(F.col("best").isNull() | (is_best & (F.col("best.copies") == 1)))
    again = (_left_join(keys, narrow, heavy, n_groups).filter("best IS NOT NULL")
             .withColumn("times", F.col("copies") - is_best.cast("long")).filter("times > 0")
             .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))))

    own = F.concat(F.lit("<urn:sha1:"), F.col("sha1"), F.lit(":"), F.coalesce(F.col("best.page_id").cast("string"), F.lit("")), F.lit(">"))
    extra = F.when(F.col("page_id").isNotNull(), F.create_map(F.lit("X-Page-Id"), F.col("page_id").cast("string")))
    shared = [F.col("url").alias("target_uri"), F.lit(date).alias("date")]

    def responses(df):
        return df.select(F.lit("response").alias("record_type"), F.when(F.col("best").isNotNull(), own).alias("record_id"), *shared,
                         F.lit(None).cast("string").alias("refers_to"), "sha1", "payload_bytes", "payload", extra.alias("extra"))

    revisits = again.select(F.lit("revisit").alias("record_type"), F.lit(None).cast("string").alias("record_id"), *shared,
                            own.alias("refers_to"), "sha1", "payload_bytes", F.lit(None).cast("binary").alias("payload"), extra.alias("extra"))
    out = responses(first).unionByName(revisits)
    if n_equal:   # entirely equal rows at the head of a group
        out = out.unionByName(responses(tagged.filter(is_best & (F.col("best.copies") > 1)).dropDuplicates(["sha1"])))
    return out


def _left_join(rows: DataFrame, groups: DataFrame, heavy: DataFrame, n_groups: int) -> DataFrame:
    """rows with their group's ``best`` (null without a group), by ``sha1``.

    Up to ``BROADCAST_ROWS`` groups are broadcast. Beyond that the heavy ones
    (at most ``HEAVY_ONE_IN``) are, and the rest join by shuffle.
    """
    if n_groups <= BROADCAST_ROWS:
        return rows.join(F.broadcast(groups), "sha1", "left")
    hot = F.broadcast(heavy.select("sha1", "best"))
    return (rows.join(hot, "sha1").unionByName(
        rows.join(F.broadcast(heavy.select("sha1")), "sha1", "left_anti").join(groups, "sha1", "left")))


def archive_pages(pages: DataFrame, path: str | None = None, **options) -> str:
    """Write the pages' records into a new archive in the shared folder (or at ``path``); its address."""
    path = path or scratch_path(pages.sparkSession, "warc")
    write_warc(dedup_records(pages, **options), path)
    return path


def page_digest(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, read back from an archive of pages.

    Responses are read whole, and their digest is that of the payload read;
    of revisits only the headers are.
    """
    page = F.col("headers")["X-Page-Id"].cast("long").alias("page_id")
    bare = lambda c: F.regexp_replace(c, "^sha1:", "").alias("payload_digest")
    whole = read_warc(spark, path, "record_type string, headers map<string,string>, computed_digest string, payload binary")
    heads = read_warc(spark, path, "record_type string, headers map<string,string>, payload_digest string, refers_to string, payload_bytes long")
    response = whole.filter(F.col("record_type") == "response").select(
        page, F.length("payload").cast("long").alias("payload_bytes"), bare("computed_digest"), "record_type",
        F.lit(None).cast("long").alias("refers_to"))
    revisit = heads.filter(F.col("record_type") == "revisit").select(
        page, "payload_bytes", bare("payload_digest"), "record_type",
        F.regexp_extract("refers_to", r":(-?\d*)>$", 1).alias("target"))
    return response.unionByName(revisit.select("page_id", "payload_bytes", "payload_digest", "record_type",
                                               F.nullif("target", F.lit("")).cast("long").alias("refers_to")))
