"""WARC archives as a PySpark Python data source.

``spark.read.format("warc").load(dir)`` plans partitions of whole files (small
ones together, up to ``split_bytes``), takes record-type and header predicates
from Catalyst, parses the headers of a record first and seeks past payloads that
no row needs: those of records that fail a predicate, and all of them with
``option("payload", "false")``. Archives are gzip members, one a record, whose
extra field gives the member's length, so that the rest of a member is neither
read nor inflated; plain ``.warc`` files and members without that field are read too.
``df.write.format("warc").save(dir)`` writes one
or more archives a task; only files that committed tasks report are listed in
the manifest, so a lost or repeated task leaves no record twice.

Nulls and odd cases: a null html is an empty payload; a null url an empty target;
control characters and blanks of a url are percent-encoded in its header; rows
that repeat the smallest page_id of a payload are responses each; rows with a null
page_id never are what others revisit, but may revisit. An empty table gives an
archive folder without records.
"""

from __future__ import annotations

import io
import json
import re
import struct
import uuid
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from .common import KeyFilter, fresh_path, written

SCHEMA = "warc_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_length long, path string, offset long, payload binary"
#: column -> header, for the columns that a predicate can be pushed on
HEADERS = {"warc_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
#: Equal payloads shorter than this are stored each.
LEAST_REVISIT = 100
MANIFEST = "manifest.json"


@dataclass
class Files(InputPartition):
    paths: list


@dataclass
class Wrote(WriterCommitMessage):
    files: list


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def parse_records(stream, keep, payloads: bool):
    """(offset, headers, payload or None) of each record that ``keep(headers)`` takes."""
    while True:
        at = stream.tell()
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers, name = {}, ""
        while (line := stream.readline()).strip():
            try:
                text = line.decode("utf-8")
            except UnicodeDecodeError:
                text = line.decode("latin-1")
            if text[0] in " \t" and name:  # a folded line goes on with the value before it
                headers[name] += " " + text.strip()
                continue
            name, _, value = text.partition(":")
            name = name.strip().lower()
            headers[name] = value.strip()
        length = int(headers["content-length"])
        if payloads and keep(headers):
            block = stream.read(length)
            if "application/http" in headers.get("content-type", ""):
                block = block.partition(b"\r\n\r\n")[2]
            yield at, headers, block
        else:
            if keep(headers):
                yield at, headers, None
            stream.seek(length, 1)


def member(data: bytes) -> bytes:
    """A gzip member with its own length in the extra field ``sl`` (compressed, plain)."""
    press = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = press.compress(data) + press.flush()
    total = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total if total < 2**32 else 0, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def own_length(start: bytes) -> int:
    """The length of a gzip member from its extra field, or 0."""
    if len(start) < 12 or not start[3] & 4:
        return 0
    (size,) = struct.unpack_from("<H", start, 10)
    fields, at = start[12 : 12 + size], 0
    while at + 4 <= len(fields):
        (n,) = struct.unpack_from("<H", fields, at + 2)
        if fields[at : at + 2] == b"sl" and n == 8:
            return struct.unpack_from("<I", fields, at + 4)[0]
        at += 4 + n
    return 0


def gzip_records(file, keep, payloads: bool):
    """Like ``parse_records`` for a file of gzip members, each a record."""
    at, chunk = 0, 1 << 16
    while True:
        file.seek(at)
        data = file.read(chunk)
        if not data:
            return
        known, inflate, out, fed = own_length(data), zlib.decompressobj(31), bytearray(), len(data)
        out += inflate.decompress(data, chunk)
        while b"\r\n\r\n" not in out and not inflate.eof:
            more = inflate.unconsumed_tail or file.read(chunk)
            if not more:
                raise ValueError(f"cut-off WARC record at byte {at}")
            fed += 0 if inflate.unconsumed_tail else len(more)
            out += inflate.decompress(more, chunk)
        head = parse_records(io.BytesIO(bytes(out[: out.index(b"\r\n\r\n") + 4])), lambda h: True, False)
        _, headers, _ = next(head)
        wanted = keep(headers)
        if not known or (wanted and payloads):
            while not inflate.eof:
                more = inflate.unconsumed_tail or file.read(chunk)
                if not more:
                    raise ValueError(f"cut-off WARC record at byte {at}")
                fed += 0 if inflate.unconsumed_tail else len(more)
                out += inflate.decompress(more)
            known = known or fed - len(inflate.unused_data)
        if wanted:
            block = next(parse_records(io.BytesIO(bytes(out)), lambda h: True, True))[2] if payloads else None
            yield at, headers, block
        at += known


def archive_files(store, root: str) -> list:
    """The files of an archive: those of its manifest; without one, every ``.warc`` and
    ``.warc.gz`` file below the folder but hidden ones; or the file itself."""
    from pyarrow import fs

    whole = store.get_file_info(root)
    if whole.type == fs.FileType.File:
        return [whole]
    if store.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
        with store.open_input_stream(f"{root}/{MANIFEST}") as f:
            return store.get_file_info([f"{root}/{n}" for n in sorted(json.loads(f.read())["files"])])
    found = store.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted((x for x in found if x.type == fs.FileType.File and x.path.endswith((".warc", ".warc.gz")) and x.base_name[0] not in "._"), key=lambda x: x.path)


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payloads = options.get("payload", "true").lower() != "false"
        self.split = int(options.get("split_bytes", 128 << 20))
        self.wanted: list = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo):
                self.wanted.append((HEADERS[column], "in", [f.value]))
            elif column in HEADERS and isinstance(f, In):
                self.wanted.append((HEADERS[column], "in", list(f.value)))
            elif column in HEADERS and isinstance(f, StringStartsWith):
                self.wanted.append((HEADERS[column], "starts", f.value))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        store, root = _store(self.path)
        groups, room = [], 0
        for info in archive_files(store, root):
            if info.type != fs.FileType.File:
                raise FileNotFoundError(info.path)
            if not groups or info.size > room:
                groups.append([])
                room = self.split
            groups[-1].append(self.path if info.path == root else f"{self.path.rstrip('/')}{info.path.removeprefix(root.rstrip('/'))}")
            room -= info.size
        return [Files(g) for g in groups] or [Files([])]

    def keep(self, headers) -> bool:
        for name, kind, value in self.wanted:
            got = headers.get(name)
            if got is None or (got not in value if kind == "in" else not got.startswith(value)):
                return False
        return True

    def read(self, partition):
        for path in partition.paths:
            store, where = _store(path)
            with store.open_input_file(where) as raw:
                records = gzip_records(raw, self.keep, self.payloads) if path.endswith(".gz") else parse_records(io.BufferedReader(_Raw(raw), 1 << 20), self.keep, self.payloads)
                for at, h, payload in records:
                    length = h.get("x-payload-length")
                    yield (h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-refers-to"), h.get("warc-payload-digest"), int(length) if length else None, path, at, payload)


def _Raw(file):
    """An Arrow file as a raw stream for ``io.BufferedReader``."""

    class Raw(io.RawIOBase):
        def readable(self):
            return True

        def seekable(self):
            return True

        def readinto(self, buffer):
            data = file.read(len(buffer))
            buffer[: len(data)] = data
            return len(data)

        def seek(self, offset, whence=0):
            file.seek(offset, whence)
            return file.tell()

        def tell(self):
            return file.tell()

    return Raw()


def record(row) -> bytes:
    """One WARC/1.1 record of a row with warc_type, record_id, target_uri, refers_to,
    payload_digest, payload_length and payload."""
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["target_uri"] or "")
    payload = bytes(row["payload"] or b"")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_length"]
    block = http + (payload if row["warc_type"] == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {row['warc_type']}", f"WARC-Record-ID: {row['record_id']}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {url}"]
    if row["refers_to"]:
        head += [f"WARC-Refers-To: {row['refers_to']}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: {row['payload_digest']}", f"X-Payload-Length: {row['payload_length']}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


class WarcWriter(DataSourceWriter):
    def __init__(self, options):
        self.path = options["path"]
        self.most = int(options.get("file_bytes", 256 << 20))
        self.gzip = options.get("gzip", "true").lower() != "false"

    def write(self, iterator):
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        files, out, size = [], None, 0
        for row in iterator:
            data = member(record(row)) if self.gzip else record(row)
            if out is None or size + len(data) > self.most:
                if out is not None:
                    out.close()
                files.append(f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.gzip)
                out, size = store.open_output_stream(f"{root}/{files[-1]}", compression=None), 0
            out.write(data)
            size += len(data)
        if out is not None:
            out.close()
        return Wrote(files)

    def commit(self, messages):
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps({"files": sorted(n for m in messages if m for n in m.files)}).encode())

    def abort(self, messages):
        store, root = _store(self.path)
        for message in messages:
            for name in message.files if message else ():
                store.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes format "warc" known to the session and lets predicates reach it."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def to_records(pages: DataFrame) -> DataFrame:
    """Record rows for pages: equal payloads of at least LEAST_REVISIT bytes are one
    response, that with the smallest page_id, and revisits of it. Digests are joined;
    a payload moves only if it is a revisit's, which is not written."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload").cast("long"))
    rows = rows.withColumn("key", F.coalesce(F.col("page_id").cast("string"), F.lit("none")))
    slim = written(rows.where(F.col("n") >= LEAST_REVISIT).select("page_id", "key", "digest"), "digests")
    first = written(slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null").select("digest", "first"), "copies")
    again = written(slim.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).select("key", "digest", "first").distinct(), "revisits")
    maybe = KeyFilter(again, ["key", "digest"]).maybe()
    moved = rows.where(maybe).join(again, ["key", "digest"], "left").select(*rows.columns, "first")
    rows = rows.where(~maybe).withColumn("first", F.lit(None).cast("long")).unionByName(moved).withColumn("again", F.col("first").isNotNull())
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    return rows.select(
        F.when(F.col("again"), "revisit").otherwise("response").alias("warc_type"), urn("page_id").alias("record_id"), F.coalesce("url", F.lit("")).alias("target_uri"),
        F.when(F.col("again"), urn("first")).alias("refers_to"), F.concat(F.lit("sha256:"), "digest").alias("payload_digest"), F.col("n").alias("payload_length"),
        F.lit("").alias("path"), F.lit(0).cast("long").alias("offset"), F.when(~F.col("again"), F.col("payload")).alias("payload"),
    )


def archive(pages: DataFrame, target: str | None = None) -> str:
    """Writes a WARC record per page and returns the archive folder."""
    spark = pages.sparkSession
    register(spark)
    target = target or fresh_path(spark, "warc")
    to_records(pages).write.format("warc").mode("append").save(target)
    return target


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per record of an archive of pages: page_id, size and digest of the full payload
    (of responses: measured on what was read), record type and what it revisits."""
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    whole = read(spark, path).where("warc_type = 'response'").select("record_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "warc_type", "refers_to")
    again = read(spark, path, payload=False).where("warc_type = 'revisit'").select("record_id", F.col("payload_length").alias("payload_bytes"), F.expr("substring_index(payload_digest, ':', -1)").alias("payload_digest"), "warc_type", "refers_to")
    both = whole.unionByName(again)
    to_id = lambda c: F.when(number(c) != "", number(c).cast("long"))
    return both.select(to_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), to_id("refers_to").alias("refers_to"))
