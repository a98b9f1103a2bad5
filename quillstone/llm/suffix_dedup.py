"""Suffix-array dedup by depth-limited radix sort over bytes.

Suffixes are ordered only through ``window`` bytes, by most-significant-digit passes; suffixes left together after the
last digit are exactly the repeated windows, and a suffix that is alone after a digit leaves the sort.

* **First digit.** Shuffling all suffixes of a corpus would move many times its size, so the sort's first digit is the
  window's *anchor*: the ``anchor`` bytes at the position with the least hash among those inside the window, the first of
  equals. It depends on the window's content only, so equal windows agree on it, and one row stands for all
  neighbouring suffixes that share an anchor (about 80 at 200 bytes). Anchors that occur once end the sort for theirs.
* **Second digit.** All bytes of those windows together. Rows that agree hold nothing but repeated windows and are
  counted with map-side combine, without being gathered.
* **Remaining digits.** Where an anchor has several surroundings, the suffixes of one of each are sorted digit by digit
  of ``DIGIT`` bytes, named by 64-bit hashes, in the anchor's group. Groups of very many surroundings are sorted by one
  digit of full depth instead, spread over the cluster (``repeats``).

Defined cases: a null text is empty; windows never cross documents; overlapping repeats within a document count;
repeated rows are documents of their own; null identifiers take part; texts of any length are cut into stretches of
windows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import repeats
from quillstone.storage import read_table, ship

DIGIT = 50
_STRETCH = 1 << 18  # windows looked at together
_BYTE_VALUES = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)


def byte_values(text: bytes) -> np.ndarray:
    return _BYTE_VALUES[np.frombuffer(text, np.uint8)]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of every stretch of width values, in constant time for each."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(text: bytes, window: int, anchor: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, span, at, lo, n) for the runs of windows that share an anchor."""
    low = np.uint64((1 << 24) - 1)
    for start in range(0, len(text) - window + 1, _STRETCH):
        part = text[start : start + _STRETCH + window - 1]
        rolling = repeats.Rolling(byte_values(part))
        keys = rolling.windows(anchor)
        ranked = (keys & ~low) | np.arange(len(keys), dtype=np.uint64)
        place = (sliding_min(ranked, window - anchor + 1) & low).astype(np.int64)
        lo = np.r_[0, np.nonzero(np.diff(place))[0] + 1]
        n = np.diff(np.r_[lo, len(place)])
        at = place[lo]
        span = repeats.mix(rolling.stretches(lo, lo + n - 1 + window) + (at - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        yield keys[at], span, at + start, lo + start, n


def _occurrences(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts = [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                for part in anchors(text or b"", window, anchor):
                    rows.append(np.full(len(part[0]), k))
                    parts.append(part)
            if rows:
                columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
                yield repeats.occurrence_batch(np.concatenate(rows), *columns, batch.column(0), batch.column(1))

    return docs.mapInArrow(run, repeats.OCCURRENCES.format(kind=dict(docs.dtypes)["id"]))


def _payload(window: int):
    return lambda text: lambda lo, n: text[lo : lo + n - 1 + window]


def _radix_sort(window: int):
    def classes_of(group: np.ndarray, row: np.ndarray, number: np.ndarray, payloads: list[bytes], ns: np.ndarray) -> np.ndarray:
        base = np.cumsum([0, *map(len, payloads)])[:-1]
        rolling = repeats.Rolling(byte_values(b"".join(payloads)))
        suffix = base[row] + number
        live = np.arange(len(suffix))
        for depth in range(0, window, DIGIT):
            start = suffix[live] + depth
            digit = rolling.stretches(start, start + min(DIGIT, window - depth))
            order = np.lexsort((digit, group))
            live, group, digit = live[order], group[order], digit[order]
            same = np.r_[False, (group[1:] == group[:-1]) & (digit[1:] == digit[:-1])]
            together = same | np.r_[same[1:], False]
            group = np.cumsum(~same)[together]
            live = live[together]
        out = np.zeros(len(suffix), bool)
        out[live] = True
        return out

    return classes_of


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 200, anchor: int = 40, group_limit: int = 20_000) -> DataFrame:
    """For every row: identifier, n_bytes, n_removed, spans [start, end) of removed bytes and the bytes that stay."""
    if not 1 <= anchor <= window:
        raise ValueError("an anchor lies inside a window")
    ship(df.sparkSession)
    docs = repeats.documents(df, id_col, text_col)
    codes = lambda data, n: repeats.Rolling(byte_values(data)).windows(window)
    hits = repeats.repeated_windows(docs, _occurrences(docs, window, anchor), _payload(window), _radix_sort(window), codes, group_limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, spans, kept = [], [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = text or b""
                n.append(len(text))
                if not found:
                    removed.append(0)
                    spans.append([])
                    kept.append(text)
                    continue
                out = repeats.covered(found, len(text), window)
                removed.append(int(out.sum()))
                edges = np.nonzero(np.diff(np.r_[0, out.astype(np.int8), 0]))[0].reshape(-1, 2)
                spans.append([{"start": int(a), "end": int(b)} for a, b in edges])
                kept.append(np.frombuffer(text, np.uint8)[~out].tobytes())
            pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pairs), pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "spans", "kept"])

    kind = dict(docs.dtypes)["id"]
    found = repeats.with_hits(docs, hits).mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")
    return found.withColumnRenamed("id", id_col)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
o AS (SELECT doc_id, i, md5(substr(h, 2 * i - 1, 400)) AS win
      FROM (SELECT *, unnest(range(1, length(h) // 2 - 198)) AS i FROM d WHERE length(h) >= 400)),
r AS (SELECT doc_id, i FROM o SEMI JOIN (SELECT win FROM o GROUP BY win HAVING count(*) > 1) USING (win)),
s AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200, true) AS fresh FROM r),
g AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
u AS (SELECT doc_id, run, min(i) AS a, max(i) + 199 AS b FROM g GROUP BY doc_id, run),
e AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM u),
k AS (SELECT e.doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before - 1)), '' ORDER BY a) AS head, max(b) AS last,
             sum(b - a + 1) AS n_removed, count(*) AS n_spans
      FROM e JOIN d USING (doc_id) GROUP BY e.doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
