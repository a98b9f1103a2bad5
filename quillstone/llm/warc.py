"""WARC archives: a Python data source that writes and reads them.

* **Writing.** Rows with equal payloads (by SHA-1) become one ``response`` and, for payloads of at least
  ``min_revisit_bytes``, ``revisit`` records that refer to it. Groups are counted with map-side combine; the join back is
  an ordinary one that adaptive execution splits where one payload is very frequent. Every task attempt writes files of
  its own, at most about ``max_file_bytes`` long; the commit lists those of the attempts that count in a manifest and
  deletes the others, so lost executors leave nothing behind. A gzip file has one member a record, whose length stands
  in its header (the ``sl`` extra field), so that a reader can seek past it.
* **Reading.** ``spark.read.format("warc")`` plans partitions of whole files up to ``partition_bytes``, takes equality and
  IN predicates on header columns (``record_type`` among them), parses headers first and tests them, and passes over the
  payload of records that are not wanted: a seek in plain files and in members of known length, a skip in other
  compressed ones. Payloads are only decoded if a column of the schema needs them. Rows leave as Arrow batches.

Defined cases: a null payload counts as empty; a null url gives a record without a target URI; line breaks in a url are
percent-encoded; a null page identifier is kept as null and is referred to only if its payload has no other; rows that
agree in identifier and payload are each a response; an empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from quillstone.storage import read_table, scratch_path, ship

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "file string, offset long, record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, headers map<string,string>, payload binary"
#: Column of SCHEMA that each header gives, as it stands.
MANIFEST = "_manifest.json"
HEADER_COLUMNS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to"}


def sha1_base32(data: Column) -> Column:
    """SHA-1 in upper-case base32, which needs no padding: 5 hex digits give 4 letters."""
    text, letters = F.sha1(data), []
    for k in range(8):
        value = F.conv(F.substring(text, 5 * k + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(value, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def record_urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def page_of_urn(urn: Column) -> Column:
    return F.regexp_extract(urn, "^<urn:x-page:(-?[0-9]+)>$", 1).try_cast("long")


def with_revisits(pages: DataFrame, id_col: str, payload: Column, min_revisit_bytes: int, keep: str) -> DataFrame:
    """Adds payload, digest, n_bytes and refers_to (null for a response)."""
    best = {"smallest": F.min, "largest": F.max}[keep]
    rows = pages.withColumn("payload", payload).withColumn("digest", sha1_base32(F.encode("payload", "utf-8"))).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    several = rows.where(F.col("n_bytes") >= min_revisit_bytes).groupBy("digest").agg(best(id_col).alias("first_id"), F.count("*").alias("n")).where("n > 1")
    joined = rows.join(several.drop("n"), "digest", "left")
    repeated = F.col("first_id").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("first_id"))
    return joined.withColumn("refers_to", F.when(repeated, F.col("first_id"))).drop("first_id")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z", min_revisit_bytes: int = 0, keep: str = "smallest", compression: str = "gzip", max_file_bytes: int = 1 << 30) -> None:
    """Write one record for each row. date: of the crawl, for all records."""
    narrow = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("html"))
    rows = with_revisits(narrow, "page_id", F.col("html"), min_revisit_bytes, keep)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(F.col("refers_to").isNull(), F.concat(http, F.col("payload"))).otherwise(http)
    clean = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    revisit = F.col("refers_to").isNotNull()
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_urn(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", clean),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Profile", F.when(revisit, PROFILE)),
        line("WARC-Refers-To", F.when(revisit, record_urn(F.col("refers_to")))),
        line("X-Payload-Length", F.col("n_bytes").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    register(pages.sparkSession)
    records = rows.select(F.concat(head, block, F.lit("\r\n\r\n")).cast("binary").alias("record"))
    records.write.format("warc").mode("append").option("compression", compression).option("max_file_bytes", max_file_bytes).save(path)


def filesystem(uri: str):
    """The pyarrow file system of a local path or URI, and the path in it."""
    from pyarrow import fs

    if "://" in uri and not uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else uri


def list_files(uri: str) -> list[tuple[str, int]]:
    """(path, bytes) of the archives in a folder: those of its manifest, else all; a file is itself."""
    from pyarrow import fs

    system, path = filesystem(uri)
    found = system.get_file_info(path)
    if found.type == fs.FileType.File:
        return [(path, found.size)]
    manifest = f"{path.rstrip('/')}/{MANIFEST}"
    if system.get_file_info(manifest).type == fs.FileType.File:
        with system.open_input_file(manifest) as stream:
            return [(f"{path.rstrip('/')}/{name}", size) for name, size in json.loads(stream.read())]
    inside = system.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted((x.path, x.size) for x in inside if x.type == fs.FileType.File and x.base_name[:1] not in "._")


def member(record: bytes) -> bytes:
    """A gzip member that tells its own length, compressed and not, in the extra field "sl"."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    length = 10 + 14 + len(body) + 8
    if max(length, len(record)) >= 1 << 32:
        return gzip.compress(record, mtime=0)
    extra = b"sl" + (8).to_bytes(2, "little") + length.to_bytes(4, "little") + len(record).to_bytes(4, "little")
    head = b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + len(extra).to_bytes(2, "little") + extra
    return head + body + zlib.crc32(record).to_bytes(4, "little") + len(record).to_bytes(4, "little")


class Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    """Writes the rows (record) of each task to files of its own."""

    def __init__(self, options: dict):
        self.uri, self.zipped = options["path"], options.get("compression", "gzip") == "gzip"
        self.most = int(options.get("max_file_bytes", 1 << 30))
        system, path = filesystem(self.uri)
        system.create_dir(path, recursive=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, path = filesystem(self.uri)
        files, stream, size, name = [], None, 0, ""
        for batch in batches:
            for record in batch.column(0):
                if stream is None:
                    name, size = f"part-{uuid.uuid4().hex}.warc" + (".gz" if self.zipped else ""), 0
                    stream = system.open_output_stream(f"{path.rstrip('/')}/{name}", compression=None)
                data = record.as_py()
                size += stream.write(member(data) if self.zipped else data)
                if size >= self.most:
                    stream.close()
                    files.append((name, size))
                    stream = None
        if stream is not None:
            stream.close()
            files.append((name, size))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = filesystem(self.uri)
        files = dict(x for m in messages if m is not None for x in m.files)
        known = {}
        if any(p.endswith(MANIFEST) for p in self._names(system, path)):
            known = {p.rpartition("/")[2]: size for p, size in list_files(self.uri)}
        for name in self._names(system, path):
            if name not in files and name not in known and name.startswith("part-"):
                system.delete_file(f"{path.rstrip('/')}/{name}")
        with system.open_output_stream(f"{path.rstrip('/')}/{MANIFEST}") as stream:
            stream.write(json.dumps(sorted((known | files).items())).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, path = filesystem(self.uri)
        for m in messages:
            for name, _ in m.files if m is not None else ():
                system.delete_file(f"{path.rstrip('/')}/{name}")

    @staticmethod
    def _names(system, path: str) -> list[str]:
        from pyarrow import fs

        return [x.base_name for x in system.get_file_info(fs.FileSelector(path))]


def parse_headers(stream, line: bytes, at: int, where: str) -> dict[str, str]:
    """The headers, names in lower case, of the record whose first line was read."""
    if not line.startswith(b"WARC/"):
        raise ValueError(f"{where}: no WARC record at offset {at}")
    headers: dict[str, str] = {}
    name = None
    while (line := stream.readline()) not in (b"\r\n", b"\n"):
        if not line:
            raise ValueError(f"{where}: the record at offset {at} ends in its headers")
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and name:
            headers[name] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            name = name.strip().lower()
            headers[name] = value.strip()
    return headers


def payload_of(headers: dict[str, str], block: bytes, at: int, where: str) -> bytes:
    if len(block) < int(headers.get("content-length") or 0):
        raise ValueError(f"{where}: the record at offset {at} is cut off")
    return block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block


def parse_records(stream, wanted, decode: bool, where: str) -> Iterator[tuple[int, dict[str, str], bytes | None]]:
    """Offset, headers in lower case and payload of the records for which wanted(headers) holds."""
    while True:
        at = stream.tell()
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            at = stream.tell()
            line = stream.readline()
        if not line:
            return
        headers = parse_headers(stream, line, at, where)
        length = int(headers.get("content-length") or 0)
        if not wanted(headers):
            stream.seek(length, io.SEEK_CUR)
        elif not decode or headers.get("warc-type") == "revisit":
            stream.seek(length, io.SEEK_CUR)
            yield at, headers, None
        else:
            yield at, headers, payload_of(headers, stream.read(length), at, where)


_HEAD_BYTES = 2048  # of a member, in which headers are looked for first


def member_length(head: bytes) -> int | None:
    """What the gzip header says about its member's length."""
    if len(head) < 24 or head[:3] != b"\x1f\x8b\x08" or not head[3] & 4 or head[12:16] != b"sl\x08\x00":
        return None
    return int.from_bytes(head[16:20], "little")


def parse_members(raw, wanted, decode: bool, where: str) -> Iterator[tuple[int, dict[str, str], bytes | None]]:
    """parse_records over a gzip file. Of members that tell their length, only the headers' part is unpacked at first."""
    while True:
        at = raw.tell()
        first = raw.read(_HEAD_BYTES)
        if not first:
            return
        length = member_length(first)
        if length is None:
            raw.seek(at)
            yield from parse_records(gzip.GzipFile(fileobj=raw), wanted, decode, where)
            return
        unpack = zlib.decompressobj(31)
        try:
            text, read = unpack.decompress(first[:length]), min(len(first), length)
            while b"\r\n\r\n" not in text and read < length:
                more = raw.read(min(_HEAD_BYTES, length - read))
                if not more:
                    break
                text, read = text + unpack.decompress(more), read + len(more)
            stream = io.BytesIO(text)
            headers = parse_headers(stream, stream.readline(), at, where)
            if wanted(headers):
                payload = None
                if decode and headers.get("warc-type") != "revisit":
                    raw.seek(at + read)
                    text = stream.read() + unpack.decompress(raw.read(length - read))
                    if not unpack.eof:
                        raise ValueError(f"{where}: the record at offset {at} is cut off")
                    payload = payload_of(headers, text[: int(headers.get("content-length") or 0)], at, where)
                yield at, headers, payload
        except zlib.error as e:
            raise ValueError(f"{where}: the member at offset {at} is damaged") from e
        raw.seek(at + length)


class WarcPartition(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.uri, self.schema, self.most = options["path"], schema, int(options.get("partition_bytes", 128 << 20))
        self.decode = str(options.get("payload", "true")).lower() != "false" and bool({"payload", "payload_digest", "payload_bytes"} & set(schema.fieldNames()))
        self.tests: list[tuple[str, tuple]] = []

    def pushFilters(self, filters: list[Filter]):
        """Take EQUAL and IN on header columns; return the rest to Spark."""
        for f in filters:
            header = HEADER_COLUMNS.get(f.attribute[0]) if isinstance(f, (EqualTo, In, IsNotNull)) and len(f.attribute) == 1 else None
            if header is None:
                yield f
            elif isinstance(f, IsNotNull):
                self.tests.append((header, ()))
            else:
                self.tests.append((header, tuple(f.value) if isinstance(f, In) else (f.value,)))

    def partitions(self):
        out, size = [[]], 0
        for path, n in list_files(self.uri):
            if out[-1] and size + n > self.most:
                out.append([])
                size = 0
            out[-1].append(path)
            size += n
        return [WarcPartition(files) for files in out]

    def wanted(self, headers: dict[str, str]) -> bool:
        return all(name in headers and (not values or headers[name] in values) for name, values in self.tests)

    def rows(self, path: str) -> Iterator[tuple[dict, int]]:
        """Values by column, and about how many bytes they take."""
        with filesystem(self.uri)[0].open_input_file(path) as raw:
            parse = parse_members if path.endswith(".gz") else parse_records
            for at, h, payload in parse(io.BufferedReader(raw, 1 << 16), self.wanted, self.decode, path):
                if payload is None:
                    digest, size = h.get("warc-payload-digest"), h.get("x-payload-length")
                    digest, size = digest and digest.rpartition(":")[2], size and int(size)
                else:
                    digest, size = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
                columns = {c: h.get(x) for c, x in HEADER_COLUMNS.items()}
                yield columns | {"file": path, "offset": at, "payload_digest": digest, "payload_bytes": size, "headers": list(h.items()), "payload": payload}, len(payload or b"") + 500

    def read(self, partition: WarcPartition) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        held: list[dict] = []
        size = 0
        for path in partition.files:
            for row, n in self.rows(path):
                held.append({c: row[c] for c in schema.names})
                size += n
                if size >= 8 << 20 or len(held) >= 10_000:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)


class WarcDataSource(DataSource):
    """Options: path of a file or folder; payload=false leaves payloads undecoded; a schema of fewer columns reads those only."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options, schema)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        if schema.fieldNames() != ["record"] or overwrite:
            raise ValueError("records are appended as one binary column, record")
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read_warc(spark: SparkSession, path: str, payload: bool = True, columns: list[str] | None = None) -> DataFrame:
    """The records of the files in a folder, some columns or all. Without payload the digest and length are those of the headers."""
    register(spark)
    every = dict(x.rsplit(" ", 1) for x in SCHEMA.split(", "))
    chosen = ", ".join(f"{c} {every[c]}" for c in columns or every)
    return spark.read.format("warc").schema(chosen).option("payload", str(payload).lower()).load(path)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_warc(read_table(spark, sf_dir, "pages"), path, keep="largest")
    columns = ["record_type", "record_id", "refers_to", "payload_digest", "payload_bytes"]
    # Revisits have no payload to decode: their headers tell its digest and length.
    responses = read_warc(spark, path, columns=columns).where("record_type = 'response'")
    revisits = read_warc(spark, path, payload=False, columns=columns).where("record_type = 'revisit'")
    records = responses.unionByName(revisits)
    return records.select(page_of_urn(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of_urn(F.col("refers_to")).alias("refers_to"))


_LETTERS = "list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, 1 + 5 * (k // 4), 5))::BIGINT >> (15 - 5 * (k % 4))) & 31) + 1)::BIGINT, 1))"
OP10_SQL = f"""
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS hex, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS first_id FROM p)
SELECT page_id, payload_bytes, array_to_string({_LETTERS}, '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM g
"""
