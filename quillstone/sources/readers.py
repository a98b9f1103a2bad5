"""Scans: files, folders of files, tables of a session, databases and streams, each registered as a view."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENCODINGS = ("utf-8-sig", "utf-8", "cp949", "euc-kr", "latin-1")  # fixed values, tried in this order
_PEEK = 1 << 16


def head_bytes(spark: SparkSession, path: str, size: int = _PEEK) -> bytes:
    """The first bytes of a file, through Spark's own file systems."""
    row = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, size).alias("head")).first()
    return bytes(row.head) if row else b""


def detect_encoding(head: bytes, encodings: Iterable[str] = ENCODINGS) -> str:
    """The first encoding that decodes the head; a character cut at its end is forgiven."""
    for name in encodings:
        if name == "utf-8-sig" and not head.startswith(b"\xef\xbb\xbf"):
            continue
        for cut in range(4):
            try:
                head[: len(head) - cut].decode(name)
                return name
            except UnicodeDecodeError:
                continue
    return "latin-1"


def detect_header(lines: list[str], separator: str = ",") -> int:
    """How many lines stand above the header: comments, blank lines and lines with fewer fields than most."""
    counts = [line.count(separator) for line in lines if line.strip() and not line.lstrip().startswith(("#", "//"))]
    usual = max(set(counts), key=lambda k: (counts.count(k), k)) if counts else 0
    for k, line in enumerate(lines):
        if line.strip() and not line.lstrip().startswith(("#", "//")) and line.count(separator) >= max(usual, 1):
            return k
    return 0


def unique_names(names: Iterable[str]) -> list[str]:
    """Column names made single-level and distinct: x, x_1, x_2, ..."""
    out: list[str] = []
    for k, name in enumerate(names):
        base = re.sub(r"\s+", "_", (name or "").strip()) or f"column_{k}"
        found, n = base, 0
        while found.lower() in {x.lower() for x in out}:
            n += 1
            found = f"{base}_{n}"
        out.append(found)
    return out


def read_csv(spark: SparkSession, path: str, separator: str = ",", infer: bool = True) -> DataFrame:
    """A CSV file or folder: encoding and offset of the header are found from the head, malformed lines dropped.

    Where lines stand above the header they are skipped by content, so the file stays splittable.
    """
    head = head_bytes(spark, path)
    encoding = detect_encoding(head)
    lines = head.decode(encoding, "replace").splitlines()
    offset = detect_header(lines, separator)
    reader = spark.read.option("sep", separator).option("mode", "DROPMALFORMED").option("encoding", "UTF-8" if encoding.startswith("utf-8") else encoding)
    if offset == 0:
        df = reader.option("header", True).option("comment", "#").option("inferSchema", infer).option("quote", '"').option("escape", '"').csv(path)
        return df.toDF(*unique_names(df.columns))
    above, header = lines[:offset], lines[offset]
    names = unique_names(x.strip().strip('"') for x in header.split(separator))
    text = spark.read.option("encoding", encoding).text(path).where(~F.col("value").isin(*above, header) & (F.trim("value") != "") & ~F.col("value").startswith("#"))
    schema = ", ".join(f"`{n}` string" for n in names)
    df = text.select(F.from_csv("value", schema, {"sep": separator}).alias("r")).select("r.*")
    return infer_types(df) if infer else df


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns as BIGINT or DOUBLE where every value is one. One pass over the data."""
    texts = [c for c, t in df.dtypes if t == "string"]
    if not texts:
        return df
    tests = []
    for c in texts:
        full = F.col(c).isNotNull() & (F.col(c) != "")
        tests += [F.coalesce(F.bool_and(F.when(full, F.col(c).try_cast(t).isNotNull())), F.lit(False)).alias(f"{c}|{t}") for t in ("bigint", "double")]
    row = df.agg(*tests).first()
    kinds = {c: next((t for t in ("bigint", "double") if row[f"{c}|{t}"]), None) for c in texts}
    return df.select(*(F.col(c).try_cast(kinds[c]).alias(c) if kinds.get(c) else F.col(c) for c in df.columns))


def read_json(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    return spark.read.option("multiLine", multiline).json(path)


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """By the file's suffix. Excel needs a reader library, which this package does not bring."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix in ("csv", "tsv"):
        return read_csv(spark, path, "\t" if suffix == "tsv" else ",")
    if suffix in ("json", "jsonl", "ndjson"):
        return read_json(spark, path, multiline=suffix == "json")
    if suffix == "parquet":
        return spark.read.parquet(path)
    if suffix == "orc":
        return spark.read.orc(path)
    if suffix in ("xlsx", "xls"):
        try:
            import openpyxl  # noqa: F401
            import pandas
        except ImportError as why:
            raise NotImplementedError("reading Excel files needs openpyxl") from why
        with_bytes = head_bytes(spark, path, (1 << 31) - 1)
        import io

        return spark.createDataFrame(pandas.read_excel(io.BytesIO(with_bytes)))
    raise ValueError(f"no reader for .{suffix} files")


def view_name(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9_]", "_", name.replace("/", "__"))


class Catalog:
    """Tables by name, each also a temporary view. Reading stays lazy; full tables are never collected."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, DataFrame] = {}

    def add(self, name: str, df: DataFrame) -> DataFrame:
        name = view_name(name)
        df.createOrReplaceTempView(name)
        self.tables[name] = df
        return df

    def add_all(self, tables: Mapping[str, DataFrame]) -> Catalog:
        for name, df in tables.items():
            self.add(name, df)
        return self

    def load_each(self, sources: Mapping[str, DataFrame | str]) -> list[tuple[str, str | None]]:
        """Adds tables, or files by their paths; (name, error) of each in order. A source that fails stops no other one."""
        out: list[tuple[str, str | None]] = []
        for name, source in sources.items():
            try:
                self.add(name, read_file(self.spark, source) if isinstance(source, str) else source)
                out.append((name, None))
            except Exception as why:  # whatever a reader meets is the source's finding
                out.append((name, str(why).splitlines()[0]))
        return out

    def load_file(self, path: str) -> DataFrame:
        stem = path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
        return self.add(stem, read_file(self.spark, path))

    def load_folder(self, path: str, suffixes: tuple[str, ...] = ("csv", "json", "parquet", "xlsx", "xls")) -> Catalog:
        """All data files in a folder and one level below; files below are called folder__stem. Hidden ones are left out."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(path)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())

        def entries(where):
            return sorted(((s.getPath().getName(), s.isDirectory(), s.getPath().toString()) for s in files.listStatus(where)), key=lambda x: x[0])

        def visit(where, prefix: str, depth: int) -> None:
            for name, folder, full in entries(where):
                if name.startswith((".", "_")):
                    continue
                if name.rsplit(".", 1)[-1].lower() in suffixes:
                    self.add(prefix + name.rsplit(".", 1)[0], read_file(self.spark, full))
                elif folder and depth == 0:
                    visit(hadoop.Path(full), f"{name}/", 1)

        visit(root, "", 0)
        return self

    def table(self, name: str) -> DataFrame:
        """A whole table. Unknown names raise."""
        key = view_name(name)
        if key not in self.tables:
            raise KeyError(f"no table {name}; there are {sorted(self.tables)}")
        return self.tables[key]

    def non_empty(self) -> dict[str, DataFrame]:
        return {n: df for n, df in self.tables.items() if not df.isEmpty()}

    def columns(self) -> list[tuple[str, str, str]]:
        """(table, column, type) of everything."""
        return [(n, c, t) for n, df in self.tables.items() for c, t in df.dtypes]

    def object_schema(self) -> DataFrame:
        """One row for each column: the schema summary of all object types."""
        return self.spark.createDataFrame(self.columns(), "table string, column string, type string")


def read_jdbc(spark: SparkSession, url: str, table: str, filters: Mapping[str, object] | None = None, **options: str) -> DataFrame:
    """A database table; equality filters are pushed down."""
    df = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options).load()
    for column, value in (filters or {}).items():
        df = df.where(F.col(column) == value)
    return df


def read_kafka(spark: SparkSession, servers: str, topics: str) -> DataFrame:
    """Topics as a stream of events; a value that is no JSON object becomes {"value": it}; ids are topic-partition-offset."""
    return kafka_events(spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics).option("startingOffsets", "latest").load())


def kafka_events(raw: DataFrame) -> DataFrame:
    """Events of Kafka's rows (topic, partition, offset, timestamp, key, value), a stream's or a table's."""
    text = F.col("value").cast("string")
    payload = F.coalesce(F.from_json(text, "map<string,string>"), F.create_map(F.lit("value"), text))
    return raw.select(F.concat_ws("-", "topic", "partition", "offset").alias("event_id"), F.col("topic").alias("source"), "timestamp", payload.alias("payload"), F.col("key").cast("string").alias("partition_key"))


def stream_parquet(spark: SparkSession, path: str, schema=None, max_files: int = 1) -> DataFrame:
    """Files of a folder as a stream, as tests and replays use it."""
    schema = schema or spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def instances(df: DataFrame, filters: Mapping[str, object] | None = None, order: Iterable[str] = (), limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows of a table by equality filters, a page of them if asked; filters go down to the source, pages need an order."""
    for column, value in (filters or {}).items():
        df = df.where(F.col(column) == value)
    if (limit is not None or offset) and not list(order):
        raise ValueError("a page needs an order")
    df = df.orderBy(*order) if list(order) else df
    df = df.offset(offset) if offset else df
    return df.limit(limit) if limit is not None else df


def find_table(spark: SparkSession, folder: str, name: str, suffixes: tuple[str, ...] = ("csv", "json", "parquet")) -> DataFrame:
    """The table of a name anywhere below a folder; the first path in order if there are several."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    queue, found = [root], []
    while queue:
        for s in files.listStatus(queue.pop()):
            stem, _, suffix = s.getPath().getName().rpartition(".")
            if stem == name and suffix in suffixes:
                found.append(s.getPath().toString())
            elif s.isDirectory():
                queue.append(s.getPath())
    if not found:
        raise KeyError(f"no table {name} below {folder}")
    return read_file(spark, min(found))
