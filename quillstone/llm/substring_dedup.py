"""Substring dedup with fixed-block anchors.

* **Index.** Every document is cut into non-overlapping reference blocks of ``(window + 1) // 2`` words from its first
  word on, so that any window holds at least one whole block of its own document.
* **Probe.** Every rolling window of a block's length is probed against the index. A bitmap of the block hashes, of
  bounded size, keeps probes that cannot hit out of the shuffle; the join by hash decides.
* **Extension.** A block, and a probe that hits it, stand for the windows around them. Hits whose surroundings are equal
  extend over all those windows at once, without forming pairs; where surroundings differ, the repeat ends inside, and
  the windows are compared one by one (``repeats``). The union of repeated windows is the set of maximal exact repeats.

Defined cases: a null or empty text has no words; a text shorter than a window keeps everything; windows never cross
documents; overlapping repeats within a document count; repeated rows are documents of their own and lose everything a
window covers; null identifiers take part; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import bitmaps, repeats
from quillstone.storage import read_table, ship


def word_values(text: bytes | None) -> np.ndarray:
    words = text.split() if text else []
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _block_hashes(docs: DataFrame, window: int) -> DataFrame:
    block = (window + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for text in batch.column(0).to_pylist():
                values = word_values(text)
                if len(values) >= window:
                    found.append(repeats.Rolling(values).windows(block)[::block])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["key"])

    return docs.select("text").mapInArrow(run, "key long")


def _occurrences(docs: DataFrame, window: int, index, bits: int) -> DataFrame:
    block = (window + 1) // 2
    reach = window - block  # words that a window holding a block may have before it
    shift = np.uint64(64 - (bits.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(index.value, np.uint8)
        for batch in batches:
            rows, parts = [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                values = word_values(text)
                if len(values) < window:
                    continue
                rolling = repeats.Rolling(values)
                keys = rolling.windows(block)
                slot = keys >> shift
                hit = (table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                hit[::block] = True
                at = np.nonzero(hit)[0]
                lo, last = np.maximum(at - reach, 0), np.minimum(at, len(values) - window)
                around = rolling.stretches(lo, last + window)
                span = repeats.mix(around + (at - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                rows.append(np.full(len(at), k))
                parts.append((keys[at], span, at, lo, last - lo + 1))
            if rows:
                columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
                yield repeats.occurrence_batch(np.concatenate(rows), *columns, batch.column(0), batch.column(1))

    return docs.mapInArrow(run, repeats.OCCURRENCES.format(kind=dict(docs.dtypes)["id"]))


def _payload(window: int):
    def of_text(text: bytes):
        codes = repeats.Rolling(word_values(text)).windows(window)
        return lambda lo, n: codes[lo : lo + n].tobytes()

    return of_text


def _same_code(group: np.ndarray, row: np.ndarray, number: np.ndarray, payloads: list[bytes], ns: np.ndarray) -> np.ndarray:
    codes = np.frombuffer(b"".join(payloads), np.uint64)
    order = np.lexsort((codes, group))
    g, c = group[order], codes[order]
    same = np.r_[False, (g[1:] == g[:-1]) & (c[1:] == c[:-1])]
    out = np.zeros(len(order), bool)
    out[order] = same | np.r_[same[1:], False]
    return out


def repeated_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, group_limit: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(documents, hits): see repeats.repeated_windows."""
    spark = df.sparkSession
    ship(spark)
    docs = repeats.documents(df, id_col, text_col)
    # An upper bound on the number of blocks, without counting them: they have two bytes a word at least.
    size = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    bits = bitmaps.bits_for(size // (4 * ((window + 1) // 2)))
    index = spark.sparkContext.broadcast(bitmaps.as_bytes(bitmaps.bitmap(_block_hashes(docs, window), F.col("key"), bits), bits))
    hits = repeats.repeated_windows(docs, _occurrences(docs, window, index, bits), _payload(window), _same_code, lambda data, n: np.frombuffer(data, np.uint64), group_limit)
    return docs, hits


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, group_limit: int = 100_000) -> DataFrame:
    """For every row: identifier, n_words, n_removed, spans [start, end) of removed words, and the kept words joined by one space."""
    docs, hits = repeated_words(df, id_col, text_col, window, group_limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, spans, kept = [], [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.split() if text else []
                out = repeats.covered(found, len(words), window)
                n.append(len(words))
                removed.append(int(out.sum()))
                edges = np.nonzero(np.diff(np.r_[0, out.astype(np.int8), 0]))[0].reshape(-1, 2)
                spans.append([{"start": int(a), "end": int(b)} for a, b in edges])
                kept.append((b" ".join(w for w, x in zip(words, out, strict=True) if not x) if found else b" ".join(words)).decode())
            pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pairs), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "spans", "kept_text"])

    kind = dict(docs.dtypes)["id"]
    found = repeats.with_hits(docs, hits).mapInArrow(run, f"id {kind}, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_text string")
    return found.withColumnRenamed("id", id_col)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP6_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
o AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS win
      FROM (SELECT *, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT doc_id, i FROM o SEMI JOIN (SELECT win FROM o GROUP BY win HAVING count(*) > 1) USING (win)),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS pos FROM r),
k AS (SELECT d.doc_id, pos, w[pos] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM d) d ANTI JOIN c USING (doc_id, pos)),
t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM k GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""
