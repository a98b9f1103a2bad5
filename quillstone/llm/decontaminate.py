"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The benchmark's word windows are the patterns. For each pattern length a block of the last words looks up how far the
search may jump (the shift table); at a shift of nought the block's bucket of patterns is compared word by word. Most
positions of a document are never looked at, and documents are only scanned, never shuffled.

The tables are arrays: shifts and buckets by a hash of the block (equal hashes take the smaller shift), patterns as
places in the benchmark's own words, told apart by a checksum first and byte for byte then. They are sent to every task
and take at most about 20 bytes for each byte of benchmark text (of one-letter words; about 8 for prose), which is measured first: beyond ``max_block_bytes`` of
text the benchmark is taken in blocks of that size, each scan of a row adding to the spans and items that the row has so
far. ``_BLOCKS_AT_ONCE`` blocks are searched in one pass; between passes rows are written to the shared folder.

Defined cases: null or empty texts have no words; an item of fewer than ``window`` words is one pattern, an item of none
is no pattern; identifiers of items may have any type and keep it; items with a null identifier hit words but are not
listed; an identifier used by several items is listed once; an empty benchmark hits nothing; rows that agree in their
identifier are each judged by their own text; other columns are ignored.
"""

from __future__ import annotations

import pickle
import uuid
from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillstone.storage import materialize, read_table, ship

#: Byte classes of a word: 0-9, a-z and whatever is not ASCII; A-Z are lower-cased, the rest separates.
_WORD_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_BLOCKS_AT_ONCE = 2
_FACTOR = 0x9E3779B1


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD_BYTES).split() if text else []


class WuManber:
    """Search for patterns that all have the same number of words: the windows of items given as (owner, words)."""

    def __init__(self, length: int, items: list[tuple[int, list[bytes]]]):
        self.length, self.block = length, min(2, length)
        self.jump = min(length - self.block + 1, 255)
        self.blob = b"\n".join(b" ".join(words) for _, words in items)
        n = sum(len(words) for _, words in items)
        self.mask = (1 << max(8, (2 * n).bit_length())) - 1
        shift = np.full(self.mask + 1, self.jump, np.uint8)
        keys, parts, at = [], [], 0
        for owner, words in items:
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            starts = at + np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
            at += int(sizes.sum()) + len(words)
            sums = np.fromiter(map(crc32, words), np.uint64, len(words))
            key = sums if self.block == 1 else sums[:-1] * np.uint64(_FACTOR) + sums[1:]
            key &= np.uint64(self.mask)
            # The block that ends at a word is as near to a window's end as the first window with it allows.
            np.minimum.at(shift, key, np.clip(length - self.block - np.arange(len(key)), 0, self.jump).astype(np.uint8))
            last = key[length - self.block :]
            first, end = starts[: len(last)], (starts + sizes)[length - 1 :]
            keys.append(last)
            parts.append((first, end, np.full(len(last), owner)))
        key = np.concatenate(keys).astype(np.int64)
        first, end, owner = (np.concatenate(x).astype(np.int32) for x in zip(*parts, strict=True))
        view = memoryview(self.blob)
        sums = np.fromiter((crc32(view[x:y]) for x, y in zip(first.tolist(), end.tolist(), strict=True)), np.uint32, len(first))
        order = np.lexsort((owner, sums, key))
        key, first, end, owner, sums = key[order], first[order], end[order], owner[order], sums[order]
        # An item's own repeats of a window are one pattern.
        twice = np.nonzero((key[1:] == key[:-1]) & (sums[1:] == sums[:-1]) & (owner[1:] == owner[:-1]))[0]
        keep = np.ones(len(key), bool)
        keep[[k + 1 for k in twice.tolist() if view[first[k] : end[k]] == view[first[k + 1] : end[k + 1]]]] = False
        self.first, self.end, self.owner, self.sums = first[keep], end[keep], owner[keep], sums[keep]
        self.heads = np.searchsorted(key[keep], np.arange(self.mask + 2)).astype(np.int32)
        self.shift = shift.tobytes()

    def nbytes(self) -> int:
        return len(self.blob) + len(self.shift) + sum(x.nbytes for x in (self.first, self.end, self.owner, self.sums, self.heads))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """The first word of each occurrence and the owners that have it, from left to right."""
        length, shift, mask, n = self.length, self.shift, self.mask, len(words)
        single = self.block == 1
        end = length
        while end <= n:
            key = (crc32(words[end - 1]) if single else crc32(words[end - 2]) * _FACTOR + crc32(words[end - 1])) & mask
            step = shift[key]
            if step:
                end += step
                continue
            start = end - length
            window = b" ".join(words[start:end])
            checksum, last = crc32(window), self.heads[key + 1]
            k, found = bisect_left(self.sums, checksum, self.heads[key], last), []
            while k < last and self.sums[k] == checksum:
                if self.blob[self.first[k] : self.end[k]] == window:
                    found.append(int(self.owner[k]))
                k += 1
            if found:
                yield start, found
            end += 1


class Tables:
    """Searchers for each pattern length, and the identifiers of the items that own patterns."""

    def __init__(self, items: list[tuple], window: int):
        """items: (identifier, text)."""
        self.names = sorted({name for name, _ in items if name is not None})
        place = {name: k for k, name in enumerate(self.names)}
        by_length: dict[int, list[tuple[int, list[bytes]]]] = {}
        for name, text in items:
            words = words_of(text.encode() if text is not None else None)
            if words:
                by_length.setdefault(min(window, len(words)), []).append((place.get(name, -1), words))
        self.searchers = [WuManber(k, found) for k, found in sorted(by_length.items())]


def build(items: list[tuple], window: int) -> Tables:
    return Tables(items, window)


_HELD: OrderedDict[str, Tables] = OrderedDict()


def _tables(name: str, state) -> Tables:
    """The tables of a broadcast, which a worker's tasks share."""
    if name not in _HELD:
        _HELD[name] = pickle.loads(state.value)
        if len(_HELD) > 2:
            _HELD.popitem(last=False)
    return _HELD[name]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


def scan(words: list[bytes], tables: Tables) -> tuple[list[tuple[int, int]], list]:
    spans, owners = [], set()
    for searcher in tables.searchers:
        for start, found in searcher.search(words):
            if spans and spans[-1][0] <= start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(spans[-1][1], start + searcher.length))
            else:
                spans.append((start, start + searcher.length))
            owners.update(found)
    return merged(spans), [tables.names[k] for k in sorted(owners) if k >= 0]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, max_block_bytes: int) -> Iterator[tuple[bool, bool, list[tuple]]]:
    """The benchmark's rows, block by block; whether a pass ends with the block, and whether it is the last."""
    rows = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // max_block_bytes) or 1
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield (k + 1) % _BLOCKS_AT_ONCE == 0, k == n - 1, [tuple(r) for r in part.toLocalIterator()]


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_block_bytes: int = 8 << 20) -> DataFrame:
    """For each row of docs: identifier, n_words, hit spans [start, end) in words, and the items that occur."""
    spark = docs.sparkSession
    ship(spark)
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    pairs, listed = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(to_arrow_type(item_kind))
    schema = f"id {kind}, n_words long, spans array<struct<start:long,end:long>>, items array<{item_kind.simpleString()}>"
    for pass_ends, last, block in _blocks(benchmark, item_col, item_text_col, max_block_bytes):
        state, name = spark.sparkContext.broadcast(pickle.dumps(build(block, window))), uuid.uuid4().hex

        def search(batches, state=state, name=name, last=last):
            tables = _tables(name, state)
            for batch in batches:
                n, spans, items = [], [], []
                texts = batch.column("text").to_pylist()
                before = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True) if "spans" in batch.schema.names else (([], []) for _ in texts)
                for text, (had, owners) in zip(texts, before, strict=True):
                    words = words_of(text)
                    hit, found = scan(words, tables)
                    n.append(len(words))
                    spans.append([{"start": a, "end": b} for a, b in merged([*((x["start"], x["end"]) for x in had), *hit])])
                    items.append(sorted({*owners, *found}))
                made = [batch.column("id"), pa.array(n, pa.int64()), pa.array(spans, pairs), pa.array(items, listed)]
                yield pa.RecordBatch.from_arrays(made if last else [*made, batch.column("text")], ["id", "n_words", "spans", "items", *([] if last else ["text"])])

        rows = rows.mapInArrow(search, schema + ("" if last else ", text binary"))
        if pass_ends and not last:
            rows = materialize(rows, "benchmark-pass")
    return rows.withColumnRenamed("id", id_col)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of docs, as they are, in which no window of the benchmark occurs."""
    spark = docs.sparkSession
    ship(spark)
    at, kept = docs.columns.index(text_col), docs
    for pass_ends, last, block in _blocks(benchmark, item_col, item_text_col, max_block_bytes):
        state, name = spark.sparkContext.broadcast(pickle.dumps(build(block, window))), uuid.uuid4().hex

        def clean(batches, state=state, name=name):
            searchers = _tables(name, state).searchers
            for batch in batches:
                words = map(words_of, batch.column(at).cast(pa.binary()).to_pylist())
                yield batch.filter(pa.array([not any(True for s in searchers for _ in s.search(w)) for w in words], pa.bool_()))

        kept = kept.mapInArrow(clean, docs.schema)
        if pass_ends and not last:
            kept = materialize(kept, "benchmark-pass")
    return kept


def hit_words(spans: Column | str) -> Column:
    return F.aggregate(F.transform(spans, lambda x: x["end"] - x["start"]), F.lit(0).cast("long"), lambda a, b: a + b)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated_spans(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    n_hit = hit_words(F.col("spans"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


_LOWER = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP9_SQL = f"""
WITH d AS (SELECT doc_id, {_LOWER} AS w FROM documents),
b AS (SELECT item_id, {_LOWER} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
      FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
o AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS win
      FROM (SELECT d.*, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM p))),
h AS (SELECT o.doc_id, o.i, o.k, p.item_id FROM o JOIN p USING (k, win)),
n AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
      FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
