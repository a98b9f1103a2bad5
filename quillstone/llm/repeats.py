"""Which fixed-length windows of all documents occur more than once: the part that both window dedups share.

An operator picks *anchors* so that equal windows hold the same anchor at the same place, and writes one row for each
anchor occurrence: ``key`` (hash of the anchor), ``span`` (hash of all tokens of the windows it stands for, and its place
in them), the document (``id`` and text hash ``th``), ``lo`` (start of its first window), ``n`` (number of windows) and
``at`` (start of the anchor). Then

1. occurrences whose key is alone are dropped: none of their windows is repeated;
2. occurrences with an equal key and span are repeated as a whole. They are counted with map-side combine, so a group of
   copies of any size is one row a task, and pairs are never formed;
3. where a key has several spans, one occurrence of each span is looked into, window by window, in its key's group. A
   key with more than ``group_limit`` different spans isn't gathered: its windows are counted as rows of their own.

Rows are identified by identifier and text hash together, so repeated rows count as separate documents and get the same
result.

Stretches are compared by a 64-bit polynomial hash over random token values. Sequences of Thue-Morse kind, which collide in
any such hash, need 1,024 tokens; the stretches here have below twice a window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import bitmaps
from quillstone.storage import discard, materialize

_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 14)
        inverse = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)]) for b in (_BASE, inverse)]
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of any stretch of a sequence of 64-bit token values, the same wherever the stretch stands."""

    def __init__(self, tokens: np.ndarray):
        self.n = len(tokens)
        up, self.down = powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(tokens * up[: self.n], out=self.sums[1:])

    def windows(self, length: int) -> np.ndarray:
        if self.n < length:
            return np.zeros(0, np.uint64)
        return mix((self.sums[length:] - self.sums[:-length]) * self.down[: self.n - length + 1])

    def stretches(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


OCCURRENCES = "key long, span long, id {kind}, th long, at int, lo int, n int"


def occurrence_batch(docs: list, key: np.ndarray, span: np.ndarray, at: np.ndarray, lo: np.ndarray, n: np.ndarray, ids: pa.Array, ths: pa.Array) -> pa.RecordBatch:
    """docs: for each row, the index of its document in ids and ths."""
    take = pa.array(docs, pa.int64())
    columns = [pa.array(key.view(np.int64)), pa.array(span.view(np.int64)), ids.take(take), ths.take(take), *(pa.array(x.astype(np.int32)) for x in (at, lo, n))]
    return pa.RecordBatch.from_arrays(columns, ["key", "span", "id", "th", "at", "lo", "n"])


def documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("binary").alias("text"))


def _payloads(docs: DataFrame, wanted: DataFrame, payload: Callable) -> DataFrame:
    """For (key, span, id, th, at, lo, n, wide): payload(text, lo, n) of the document, read by those documents only."""
    lists = materialize(wanted.groupBy("id", "th").agg(F.collect_list(F.struct("key", "span", "at", "lo", "n", "wide")).alias("reps")), "repeat-reps")
    bits = bitmaps.bits_for(lists.count())
    row_key = F.xxhash64("id", "th")
    held = bitmaps.flagged(docs, row_key, bitmaps.bitmap(lists, row_key, bits), bits, "held").where("held").drop("held")
    own = lists.withColumnsRenamed({"id": "id2", "th": "th2"})
    joined = held.join(own, F.col("id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2"))).select("text", "reps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, reps in zip(batch.column(0), batch.column(1), strict=True):
                reps = reps.as_py()
                cut = payload(text.as_py())
                rows = [(r["key"], r["span"], r["at"] - r["lo"], r["n"], r["wide"], cut(r["lo"], r["n"])) for r in reps]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()), strict=True)], ["key", "span", "off", "n", "wide", "payload"])

    return joined.mapInArrow(run, "key long, span long, off int, n int, wide boolean, payload binary")


def _masks(keys: np.ndarray, offs: np.ndarray, ns: np.ndarray, payloads: list[bytes], classes_of: Callable) -> list[bytes | None]:
    """For each occurrence, a bit for each window that another occurrence with the same key has too."""
    row = np.repeat(np.arange(len(keys)), ns)
    starts = np.cumsum(ns) - ns
    number = np.arange(len(row)) - np.repeat(starts, ns)
    group = mix(keys[row].astype(np.uint64) + (offs[row] - number).astype(np.uint64) * np.uint64(_BASE))
    repeated = classes_of(group, row, number, payloads, ns)
    out: list[bytes | None] = []
    for k in range(len(keys)):
        own = repeated[starts[k] : starts[k] + ns[k]]
        out.append(np.packbits(own, bitorder="little").tobytes() if own.any() else None)
    return out


def _by_key(classes_of: Callable, at_once: int = 150_000) -> Callable:
    """Streams rows sorted by key through _masks, whole keys at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[tuple]) -> pa.RecordBatch:
            keys, spans, offs, ns, payloads = map(list, zip(*rows, strict=True))
            masks = _masks(np.array(keys, np.int64), np.array(offs, np.int64), np.array(ns, np.int64), payloads, classes_of)
            keep = [k for k, m in enumerate(masks) if m is not None]
            return pa.RecordBatch.from_arrays([pa.array([keys[k] for k in keep], pa.int64()), pa.array([spans[k] for k in keep], pa.int64()), pa.array([masks[k] for k in keep], pa.binary())], ["key", "span", "mask"])

        held: list[tuple] = []
        windows = 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if windows >= at_once and row[0] != held[-1][0]:
                    yield done(held)
                    held, windows = [], 0
                held.append(row)
                windows += row[3]
        if held:
            yield done(held)

    return run


def repeated_windows(docs: DataFrame, occurrences: DataFrame, payload: Callable, classes_of: Callable, window_codes: Callable, group_limit: int) -> DataFrame:
    """(id, th, hits) for the documents with repeated windows; hits: (lo, n, mask), a null mask standing for all n.

    payload(text) gives a function of (lo, n) to the bytes that decide on those windows; classes_of(group, row, number,
    payloads, ns) tells for each window of a batch whether another of its group equals it; window_codes(payload, n) gives
    a 64-bit code of each window's content.
    """
    every = materialize(occurrences, "occurrences")
    per_key = every.groupBy("key").agg(F.count("*").alias("rows"), (F.min("span") != F.max("span")).alias("mixed")).where("rows > 1").drop("rows")
    # Written first, so that the join below has a plain table on either side and a frequent key is split.
    several = materialize(per_key, "occurrence-keys")
    live = materialize(every.join(several, "key"), "occurrences-live")
    discard(every)
    discard(several)
    whole = live.groupBy("key", "span").agg(F.count("*").alias("rows")).where("rows > 1").select("key", "span", F.lit(None).cast("binary").alias("mask"))
    mixed = materialize(live.where("mixed").groupBy("key", "span").agg(F.count("*").alias("rows"), F.min(F.struct("id", "th", "at", "lo", "n")).alias("rep")), "occurrences-mixed")
    wide = materialize(mixed.groupBy("key").agg(F.count("*").alias("spans")).where(F.col("spans") > group_limit).select("key", F.lit(True).alias("wide")), "occurrence-wide")
    wanted = mixed.join(wide, "key", "left").select("key", "span", "rep.*", F.coalesce("wide", F.lit(False)).alias("wide"))
    cut = materialize(_payloads(docs, wanted, payload), "repeat-payloads")
    once = mixed.where("rows = 1").select("key", "span")
    verdict = "key long, span long, mask binary"
    narrow = cut.where("not wide").drop("wide").repartition("key").sortWithinPartitions("key").mapInArrow(_by_key(classes_of), verdict)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, span, off, n, data in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                number = np.arange(n)
                group = mix(np.uint64(key % (1 << 64)) + (off - number).astype(np.uint64) * np.uint64(_BASE))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key, np.int64)), pa.array(np.full(n, span, np.int64)), pa.array(number), pa.array(group.view(np.int64)), pa.array(window_codes(data, n).view(np.int64))], ["key", "span", "number", "group", "code"])

    single = cut.where("wide").drop("wide").mapInArrow(explode, "key long, span long, number long, group long, code long")
    common = single.groupBy("group", "code").agg(F.count("*").alias("rows")).where("rows > 1").drop("rows")
    marks = single.join(common, ["group", "code"]).groupBy("key", "span").agg(F.array_sort(F.collect_set("number")).alias("numbers"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = []
            for numbers in batch.column(2).to_pylist():
                own = np.zeros(numbers[-1] + 1, bool)
                own[numbers] = True
                masks.append(np.packbits(own, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks, pa.binary())], ["key", "span", "mask"])

    parts = narrow.union(marks.mapInArrow(pack, verdict)).join(once, ["key", "span"], "left_semi")
    verdicts = materialize(whole.union(parts), "repeat-verdicts")
    hits = live.join(verdicts, ["key", "span"]).groupBy("id", "th").agg(F.collect_list(F.struct("lo", "n", "mask")).alias("hits"))
    found = materialize(hits, "repeat-hits")
    for table in (live, mixed, wide, cut, verdicts):
        discard(table)
    return found


def covered(hits: list[dict] | None, n_tokens: int, window: int) -> np.ndarray:
    """Which tokens a repeated window covers."""
    edge = np.zeros(n_tokens + 1, np.int64)
    for hit in hits or ():
        if hit["mask"] is None:
            edge[hit["lo"]] += 1
            edge[hit["lo"] + hit["n"] - 1 + window] -= 1
        else:
            starts = hit["lo"] + np.nonzero(np.unpackbits(np.frombuffer(hit["mask"], np.uint8), bitorder="little"))[0]
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + window, -1)
    return np.cumsum(edge[:-1]) > 0


def with_hits(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """docs with their hits; the text of documents without any isn't shuffled."""
    bits = bitmaps.bits_for(hits.count())
    row_key = F.xxhash64("id", "th")
    told = bitmaps.flagged(docs, row_key, bitmaps.bitmap(hits, row_key, bits), bits, "held")
    right = hits.withColumnsRenamed({"id": "id2", "th": "th2"})
    joined = told.where("held").join(right, F.col("id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2")), "left").select("id", "text", "hits")
    return joined.unionByName(told.where("not held").select("id", "text"), allowMissingColumns=True)
