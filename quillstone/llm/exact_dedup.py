"""Exact dedup as a log-structured merge index over text digests; DataFrame operations only.

* **Memtable and flush.** Every task of a flush is one memtable: it sorts the digests of its rows and writes them as one
  sorted run (Parquet, with the format's own Bloom filter on the digest). Nothing is shuffled.
* **Compaction.** The runs written since the last compaction merge with the level before it into one new level that holds,
  for each digest, the identifier that stays and the number of rows; earlier runs are not read again. Counts are combined
  on the map side, so a group of copies of any size reaches the shuffle as one row a task.
* **Filter.** Digests that occur more than once set bits in a bitmap whose size has a fixed bound (``bitmaps``),
  small enough to broadcast at any input size; when it fills up it only passes more rows on.
* **Verification.** Rows that pass the filter are grouped by digest *and text*, which compares the bytes. A digest
  with two different texts (a collision) has its rows told apart by text.
* **Later batches.** ``seen`` takes a batch through the level's filter, joins what passes with the level and compares its
  bytes with the stored text of the row that stays, and of the digest's other rows where that one differs.

Defined cases: a null text counts as empty; a null identifier takes part like any
other but stays only where its text has no row with an identifier;
rows that agree in both identifier and text are one record and share its verdict; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import bitmaps
from quillstone.storage import discard, materialize, read_table, release, scratch_path


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class DigestIndex:
    """Runs and a compacted level of (digest, keep_id, group_size) in the shared folder.

    keep: "smallest" or "largest", the identifier that stays of equal texts.
    digest: from a text column to a binary digest; any function is right, a weak one costs time.
    """

    def __init__(self, spark: SparkSession, keep: str = "smallest", digest: Callable[[Column], Column] = sha256):
        self.spark, self.digest = spark, digest
        self.best = {"smallest": F.min, "largest": F.max}[keep]
        self.home, self.runs, self.merged, self.level = scratch_path(spark, "digest-index"), [], 0, None

    def rows(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        text = F.coalesce(F.col(text_col), F.lit(""))
        return df.select(F.col(id_col).alias("id"), self.digest(text).alias("digest"), text.alias("text"))

    def flush(self, df: DataFrame, id_col: str, text_col: str) -> None:
        """Write the digests of df as sorted runs, one for each task."""
        path = f"{self.home}/run-{len(self.runs)}"
        memtables = self.rows(df, id_col, text_col).select("digest", "id").sortWithinPartitions("digest", "id")
        memtables.write.option("parquet.bloom.filter.enabled#digest", "true").parquet(path)
        self.runs.append(path)

    def entries(self) -> DataFrame:
        return self.spark.read.parquet(*self.runs)

    def compact(self) -> DataFrame:
        """Merge the runs not merged yet into the level of (digest, keep_id, group_size), sorted by digest within each file."""
        fresh, before = self.runs[self.merged :], self.level
        if fresh:
            path = f"{self.home}/level-{len(self.runs)}"
            rows = self.spark.read.parquet(*fresh).select("digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
            if before is not None:
                rows = rows.unionByName(before)
            merged = rows.groupBy("digest").agg(self.best("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
            merged.sortWithinPartitions("digest").write.option("parquet.bloom.filter.enabled#digest", "true").parquet(path)
            release(self.spark)
            self.level, self.merged = self.spark.read.parquet(path), len(self.runs)
            self.level._scratch_path = path
            if before is not None:
                discard(before)
        return self.level

    def seen(self, batch: DataFrame, store: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, digest, text, keep_id) for the rows of a batch whose text some flushed row has. store: the flushed rows with their texts."""
        level = self.compact()
        bitmap, bits = self.filter(level.select("digest"))
        hits = materialize(self.may_hold(self.rows(batch, id_col, text_col), bitmap, bits).join(level.select("digest", "keep_id"), "digest"), "digest-hits")
        stored = store.select(F.col(id_col).alias("stored_id"), F.coalesce(F.col(text_col), F.lit("")).alias("stored"))
        kept = hits.join(stored, F.col("keep_id").eqNullSafe(F.col("stored_id"))).where(F.col("text") == F.col("stored")).select(*hits.columns).distinct()
        # Rows of equal digest that differ from the row that stays: a collision, or a row without an identifier.
        rest = hits.select("digest", "text").distinct().join(kept.select("digest", "text").distinct(), ["digest", "text"], "left_anti")
        others = rest.join(self.entries().select("digest", F.col("id").alias("other_id")), "digest").join(stored, F.col("other_id").eqNullSafe(F.col("stored_id")))
        found = others.where(F.col("text") == F.col("stored")).groupBy("digest", "text").agg(self.best("other_id").alias("keep_id"))
        return kept.unionByName(hits.drop("keep_id").join(found, ["digest", "text"]).select(*hits.columns).distinct())

    def filter(self, digests: DataFrame) -> tuple[DataFrame, int]:
        """A bitmap of the digests as (bucket, bits) and its number of bits."""
        bits = bitmaps.bits_for(digests.count())
        return bitmaps.bitmap(digests, F.xxhash64("digest"), bits), bits

    def may_hold(self, rows: DataFrame, bitmap: DataFrame, bits: int) -> DataFrame:
        """The rows whose digest's bit is set."""
        return bitmaps.flagged(rows, F.xxhash64("digest"), bitmap, bits, "held").where("held").drop("held")

    def assign(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, digest, keep_id, group_size) for every row of df, all of which must have been flushed."""
        level = self.compact()
        several = level.where("group_size > 1")
        bitmap, bits = self.filter(several)
        hits = self.may_hold(self.rows(df, id_col, text_col), bitmap, bits)
        texts = hits.groupBy("digest", "text").agg(self.best("id").alias("keep_id"), F.count("*").alias("group_size"))
        clashes = materialize(texts.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "digest-clashes")
        plain = self.entries().join(level, "digest").select("id", "digest", "keep_id", "group_size")
        if clashes.isEmpty():
            return plain
        told = hits.join(clashes, "digest", "left_semi").join(texts, ["digest", "text"]).select("id", "digest", "keep_id", "group_size")
        return plain.join(clashes, "digest", "left_anti").unionByName(told)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row for each row of df: id, keep_id, group_size, kept, digest. See the module for nulls, ties and empty input."""
    index = DigestIndex(df.sparkSession, keep, digest)
    index.flush(df, id_col, text_col)
    found = index.assign(df, id_col, text_col)
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of df, as they are, less all but one of each group of equal texts. Only texts that occur again are shuffled."""
    index = DigestIndex(df.sparkSession, keep)
    index.flush(df, id_col, text_col)
    several = index.compact().where("group_size > 1")
    bitmap, bits = index.filter(several)
    text = F.coalesce(F.col(text_col), F.lit(""))
    # The row goes as one struct, so that its columns cannot clash with those added here; its text goes once, as key.
    others = [c for c in df.columns if c != text_col]
    rows = df.select(F.struct(*(F.col(c) for c in others)).alias("row"), F.col(text_col).isNull().alias("none"), F.col(id_col).alias("id"), sha256(text).alias("digest"), text.alias("text"))
    told = bitmaps.flagged(rows, F.xxhash64("digest"), bitmap, bits, "held")
    place = F.struct(F.col("id").isNull(), F.col("id")) if keep == "smallest" else F.struct(F.col("id").isNotNull(), F.col("id"))
    best = (F.min_by if keep == "smallest" else F.max_by)(F.struct("row", "none"), place)
    # One row of each text leaves a task, so a group of copies of any size is small before the shuffle.
    once = told.where("held").groupBy("digest", "text").agg(best.alias("best")).select("best.row", "best.none", "text")
    kept = told.where("not held").select("row", "none", "text").unionByName(once)
    return kept.select(*(F.when(~F.col("none"), F.col("text")).alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in df.columns))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(read_table(spark, sf_dir, "documents"), keep="largest")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP8_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
