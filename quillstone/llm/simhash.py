"""SimHash near-dedup with Golay-code fuzzy hashing.

* **Fingerprints.** 64 bits; a bit is set if it is set in over half of the XXH64 values (seed 42) of the text's word
  shingles, repeats included.
* **Keys.** A fingerprint is cut into three segments of at most 22 bits, each read as a word of the binary Golay code
  [23, 12, 7], whose decoder maps any word to exactly one codeword. Of two fingerprints that differ in at most 4 bits,
  the two least damaged segments differ in at most 2 bits together (pigeonhole), so some word half way between them is
  within one flip of both. Decoding the pair of segments and all pairs one flip away to codeword indices therefore
  gives the two a key of 24 bits in common; a fingerprint has about 30 keys.
* **Join and verification.** Fingerprints meet by key; a link is a pair with at most ``max_bits`` differing bits. A
  bucket yields a spanning forest of its links and never all its pairs: a search visits every member once and drops
  those it has reached. A bucket over ``bucket_limit`` is dealt into blocks, and all pairs of blocks are searched in
  separate groups, so every link is found whatever the bucket's size.
* **Wider similarity.** ``keep_one`` finds near copies by the Jaccard similarity of word shingles, which at 0.8 is about
  10 of 64 bits. Fingerprints that meet by their keys give its first candidates; a prefix filter over the shingles, which
  misses no pair, is the exact way to those that differ in more bits. The shingles themselves decide about both.
* **Groups.** Equal fingerprints are one node from the start; components come from star rounds over the forest.

Defined cases: a null text is empty; a text without words has fingerprint 0, which links like any other; a text of
fewer words than a shingle is one shingle; null identifiers take part and never name a component that has others; rows
that agree give rows that agree; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import bitmaps
from quillstone.llm.components import components
from quillstone.storage import materialize, read_table, release, ship

SEGMENTS = (22, 21, 21)
GOLAY = 0b110001110101  # generator polynomial of the [23, 12, 7] code
MAX_BITS = 4  # two of three segments then differ in two bits at most
_CHUNK = 1 << 16


def fingerprint(text: bytes | None, shingle: int) -> int:
    """SimHash of UTF-8 bytes, A-Z lower-cased; words are what stands between space and \\x09-\\x0D."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        starts = [0, *(e + 1 for e in ends[:-shingle])]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :], strict=True)]
    values = np.array(hashes, np.uint64)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(values), _CHUNK):
        counts += np.unpackbits(values[k : k + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(values), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, th, fp) for every row; th is the text's hash, which tells rows of one identifier apart."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, shingle) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values)], ["id", "th", "fp"])

    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, th long, fp long")


def golay_table(width: int) -> np.ndarray:
    """The 12-bit index of the codeword that each word of width bits decodes to."""

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GOLAY << (bit - 11)
        return word

    errors = np.zeros(2048, np.uint32)
    for weight in (1, 2, 3):
        for bits in combinations(range(23), weight):
            error = sum(1 << b for b in bits)
            errors[remainder(error)] = error
    syndromes = np.zeros(1, np.uint16)
    for bit in range(width):
        syndromes = np.concatenate([syndromes, syndromes ^ np.uint16(remainder(1 << bit))])
    return ((np.arange(1 << width, dtype=np.uint32) ^ errors[syndromes]) >> 11).astype(np.uint16)


_TABLES: dict[int, np.ndarray] = {}


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and, for each, the index of its fingerprint (uint64 array)."""
    exact, near, at = [], [], 0
    for width in SEGMENTS:
        if width not in _TABLES:
            _TABLES[width] = golay_table(width)
        table = _TABLES[width]
        words = (fps >> np.uint64(at)).astype(np.int64) & ((1 << width) - 1)
        exact.append(table[words].astype(np.int64))
        near.append(table[words[:, None] ^ (1 << np.arange(width))].astype(np.int64))
        at += width
    keys, owners = [], []
    for n, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        pairs = np.concatenate([(exact[i] << 12 | exact[j])[:, None], near[i] << 12 | exact[j][:, None], exact[i][:, None] << 12 | near[j]], axis=1)
        pairs.sort(axis=1)
        fresh = np.ones(pairs.shape, bool)
        fresh[:, 1:] = pairs[:, 1:] != pairs[:, :-1]
        keys.append(pairs[fresh] | n << 24)
        owners.append(np.nonzero(fresh)[0])
    return np.concatenate(keys), np.concatenate(owners)


def bits_apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits, row by row; a row has one fingerprint or several."""
    apart = np.bitwise_count(x ^ y)
    return apart if apart.ndim == 1 else apart.sum(axis=1, dtype=np.int64)


def sketches_apart(x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """0 where rows (size, sketch) of two shingle sets may have that Jaccard similarity, else 1; no pair that has it gets 1.

    A shingle in one set only flips one bit of the sketches' difference, so the difference is at most that of the sets.
    """
    m, n = x[..., 0].astype(np.int64), y[..., 0].astype(np.int64)
    bits = np.bitwise_count(x[..., 1:] ^ y[..., 1:]).sum(axis=-1, dtype=np.int64)
    return ((np.minimum(m, n) < similarity * np.maximum(m, n) - _SLACK) | (bits > (1 - similarity) / (1 + similarity) * (m + n) + _SLACK)).astype(np.int64)


_SLACK = 1e-6  # against rounding


def forest(fps: np.ndarray, ids: np.ndarray, max_bits: int, apart=bits_apart) -> tuple[np.ndarray, np.ndarray]:
    """Links (of ids) that join what links of at most max_bits join, one fewer than members in each part."""
    left, right = [], []
    rest, names = fps, ids
    while len(rest) > 1:
        reached, rest, names = [(rest[0], names[0])], rest[1:], names[1:]
        while reached and len(rest):
            node, name = reached.pop()
            close = apart(rest, node) <= max_bits
            if close.any():
                found = names[close]
                reached.extend(zip(rest[close], found, strict=True))
                rest, names = rest[~close], names[~close]
                left.append(np.full(len(found), name))
                right.append(found)
    none = ids[:0]
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _small_groups(keys: np.ndarray, fps: np.ndarray, ids: np.ndarray, max_bits: int, apart=bits_apart) -> tuple[np.ndarray, np.ndarray]:
    """All links within runs of equal keys; for short runs."""
    left, right, at, step = [], [], np.arange(len(keys)), 1
    while True:
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            break
        close = at[apart(fps[at], fps[at + step]) <= max_bits]
        left.append(ids[close])
        right.append(ids[close + step])
        step += 1
    none = ids[:0]
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


LINKS = "a long, b long, key long, n long"
_SHORT = 32  # longest run for which all links are listed


def _link(batches: Iterator[pa.RecordBatch], max_bits: int, limit: int, apart=bits_apart) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp), or (key, fp, id, further words of fp), sorted by key: links of ids as (a, b), and (key, n) for buckets over the limit, which are left."""

    def rows(a, b, key=None, n=None):
        if key is None:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int64())], ["a", "b", "key", "n"])
        return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([key], pa.int64()), pa.array([n], pa.int64())], ["a", "b", "key", "n"])

    def whole(rows_):
        """Links of whole buckets, and the size of those over the limit."""
        keys, fps, ids = rows_
        if not len(keys):
            return
        starts = np.nonzero(np.r_[True, keys[1:] != keys[:-1]])[0]
        sizes = np.diff(np.r_[starts, len(keys)])
        of_row = np.repeat(sizes, sizes)
        short = (of_row > 1) & (of_row <= min(_SHORT, limit))
        yield rows(*_small_groups(keys[short], fps[short], ids[short], max_bits, apart))
        for k in np.nonzero(sizes > min(_SHORT, limit))[0]:
            part = slice(starts[k], starts[k] + sizes[k])
            yield rows([], [], int(keys[starts[k]]), int(sizes[k])) if sizes[k] > limit else rows(*forest(fps[part], ids[part], max_bits, apart))

    held, extra = None, 0  # held: the last bucket so far; extra: rows of it that are only counted
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if len(columns) == 2:
            fresh = (columns[0], columns[1].view(np.uint64), columns[1])
        else:
            words = np.frombuffer(b"".join(columns[3]), np.int64).reshape(len(columns[0]), -1)
            fresh = (columns[0], np.concatenate([columns[1][:, None], words], axis=1).view(np.uint64), columns[2])
        now = fresh if held is None else tuple(np.concatenate(x) for x in zip(held, fresh, strict=True))
        if extra and now[0][-1] != now[0][0]:  # the bucket that was over the limit has ended
            first = int(np.searchsorted(now[0], now[0][0], "right"))
            yield rows([], [], int(now[0][0]), first + extra)
            now, extra = tuple(x[first:] for x in now), 0
        last = int(np.searchsorted(now[0], now[0][-1], "left"))
        yield from whole(tuple(x[:last] for x in now))
        held = tuple(x[last:] for x in now)
        if len(held[0]) > limit:
            extra += len(held[0]) - limit - 1
            held = tuple(x[: limit + 1] for x in held)
    if extra:
        yield rows([], [], int(held[0][0]), len(held[0]) + extra)
    elif held is not None:
        yield from whole(held)


def _keys(fps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            for k in range(0, len(values), 4096):
                part = values[k : k + 4096]
                keys, owners = keys_of(part)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[owners].view(np.int64))], ["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def _search(keyed: DataFrame, max_bits: int, bucket_limit: int, apart=bits_apart) -> DataFrame:
    """Links (a, b) within the buckets of rows (key, fp) or (key, fp, id, further words of fp)."""

    def searched(rows: DataFrame, limit: int) -> DataFrame:
        return rows.repartition("key").sortWithinPartitions("key", rows.columns[min(2, len(rows.columns) - 1)]).mapInArrow(lambda batches: _link(batches, max_bits, limit, apart), LINKS)

    found = materialize(searched(keyed, bucket_limit), "simhash-links")
    parts, large = found.where("key is null").select("a", "b"), found.where("key is not null").select("key", "n")
    if large.isEmpty():
        return parts
    # Blocks of a third of the limit on average, so that a pair of them stays below it.
    own = keyed.columns[min(2, len(keyed.columns) - 1)]
    dealt = keyed.join(large.withColumn("blocks", F.ceil(F.col("n") * 3 / bucket_limit) + 1), "key")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(own), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), *keyed.columns[1:])
    more = materialize(searched(pairs, 1 << 62), "simhash-links")
    return parts.union(more.where("key is null").select("a", "b"))


def links(fps: DataFrame, max_bits: int = MAX_BITS, bucket_limit: int = 16384) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) whose components are those of all links of at most max_bits."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"keys find every pair only up to {MAX_BITS} bits")
    return _search(_keys(fps), max_bits, bucket_limit)


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = MAX_BITS, bucket_limit: int = 16384) -> DataFrame:
    """For every row of df: identifier, text hash th, fp (long) and component_id, the smallest identifier that links reach."""
    rows = materialize(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("id").alias("least_id")), "fingerprint-nodes")
    roots = components(links(nodes, max_bits, bucket_limit))
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = placed.join(names, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("id").alias(id_col), "th", "fp", "component_id")


def shingle_hashes(text: bytes | None, size: int) -> list[int]:
    """Hashes of the distinct word shingles, of the whole sequence if it is shorter."""
    words = text.lower().split() if text else []
    grams = {b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else ()
    return np.array([xxhash.xxh64_intdigest(g) for g in grams], np.uint64).view(np.int64).tolist()


def verified(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (places in the list) that join what pairs of at least that Jaccard similarity join, by an inverted index."""
    sizes = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, item = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(item, kind="stable")
    posting, starts = owner[order], np.concatenate([[0], np.cumsum(np.bincount(item))])
    own_start = np.cumsum(sizes) - sizes
    root = list(range(len(sets)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    out = []
    for k in range(len(sets) - 1):
        mine = item[own_start[k] : own_start[k] + sizes[k]]
        met = np.concatenate([posting[starts[i] : starts[i + 1]] for i in mine])
        common = np.bincount(met[met > k], minlength=len(sets))
        for j in np.nonzero((common > 0) & (common >= similarity * (sizes + sizes[k] - common)))[0]:
            x, y = find(k), find(int(j))
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((k, int(j)))
    return out


SKETCH_WORDS = 4  # of 64 bits, of sets in the first tier; each further tier has four times as many
TIERS = (400, 1600, 6400, 25600)  # shingles from which on a set is in the next tier
_RANGES = 64  # in which the slots of shingles are counted, at least
_RANGE = 1 << 18  # shingles of a range, about
_COUNTED = 1 << 21  # shingles that a task counts before it hands them on
_FULL = np.uint64(1 << 31)  # counts stop here


def words_of(texts: DataFrame) -> int:
    """About how many words all texts have."""
    return (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6


def shingle_levels(texts: DataFrame, shingle: int, words: int | None = None) -> tuple[np.ndarray, int]:
    """How common the shingles of each slot are, as bitmaps (one a level) of their counts, and the number of slots.

    Shingles that share a slot by chance count together; a slot below the first level has one row's shingle only. The
    later levels only order the shingles, so that passages many rows have come last.
    """
    words = words_of(texts) if words is None else words
    slots = min(bitmaps.bits_for(words, 1), bitmaps.MAX_BITS // 2)
    # A range gets a few hundred thousand shingles, however many there are in all, so tasks have many ranges of like size;
    # a common one comes once from a task's count. A place within a range fits in two bytes.
    ranges = max(_RANGES, slots >> 16)
    while ranges < slots // 4096 and ranges * _RANGE < words:
        ranges *= 2
    shift, width = np.uint64(64 - (slots.bit_length() - 1)), slots // ranges
    levels = [2, 8 + 2 * words // slots, 64 + 2 * words // slots]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counts(held: list[np.ndarray]) -> pa.RecordBatch:
            at, n = np.unique(np.concatenate(held), return_counts=True)
            once, several, times = at[n == 1], at[n > 1], n[n > 1].astype(np.uint32)
            edges = np.arange(ranges + 1) * width
            a, b = np.searchsorted(once, edges), np.searchsorted(several, edges)
            once, several = ((x % np.uint32(width)).astype(np.uint16) for x in (once, several))
            rows = []
            for k in np.nonzero((np.diff(a) > 0) | (np.diff(b) > 0))[0].tolist():
                part = slice(b[k], b[k + 1])
                rows.append((k, once[a[k] : a[k + 1]].tobytes(), several[part].tobytes() + times[part].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["range", "once", "several"])

        held, size = [], 0
        for batch in batches:
            found = [shingle_hashes(t, shingle) for t in batch.column(0).to_pylist()]
            at = np.concatenate([np.zeros(0, np.int64), *(np.array(x, np.int64) for x in found)]).view(np.uint64) >> shift
            held.append(at.astype(np.uint32))
            size += len(at)
            if size >= _COUNTED:
                yield counts(held)
                held, size = [], 0
        if held:
            yield counts(held)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            planes = b"".join(np.packbits(total >= least, bitorder="little").tobytes() for least in levels)
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([planes], pa.binary())], ["range", "bits"])

        key, total = None, np.zeros(0, np.uint64)
        for batch in batches:
            for k, once, several in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if k != key:
                    if key is not None:
                        yield done()
                    key, total = k, np.zeros(width, np.uint64)
                total[np.frombuffer(once.as_buffer(), np.uint16)] += np.uint64(1)
                several = several.as_buffer()
                at, n = np.frombuffer(several, np.uint16, several.size // 6), np.frombuffer(several, np.uint32, several.size // 6, several.size // 3)
                total[at] = np.minimum(total[at] + n, _FULL)
        if key is not None:
            yield done()

    rows = texts.select("text").mapInArrow(placed, "range long, once binary, several binary")
    rows = rows.repartition("range").sortWithinPartitions("range").mapInArrow(counted, "range long, bits binary")
    bitmap = np.zeros((len(levels), slots // 8), np.uint8)
    for k, bits in rows.toLocalIterator():
        bitmap[:, k * width // 8 : (k + 1) * width // 8] = np.frombuffer(bits, np.uint8).reshape(len(levels), -1)
    return bitmap, slots


def prefix(hashes: np.ndarray, bitmap: np.ndarray, shift: np.uint64, similarity: float) -> np.ndarray:
    """The shingles by which a set meets every other of that Jaccard similarity.

    In one order of all shingles, two such sets have their first common shingle among the first 1 + n - similarity * n of
    each. The order is by level, then hash; no other set has the shingles below the first level, so they are left out.
    """
    at = hashes >> shift
    level = ((bitmap[:, (at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).sum(axis=0)
    order = np.lexsort((hashes, level))[: len(hashes) - int(np.ceil(similarity * len(hashes) - _SLACK)) + 1]
    return hashes[order[level[order] > 0]]


def sketch(hashes: np.ndarray, words: int = SKETCH_WORDS) -> np.ndarray:
    """Bit i is whether an odd number of shingles fall on it."""
    odd = np.bincount((hashes & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def tiers_of(n: int, similarity: float) -> range:
    """The tiers of sets up to 1 / similarity times as large: two sets that may be alike are both in that of the larger."""
    return range(int(np.searchsorted(TIERS, n, "right")), int(np.searchsorted(TIERS, int(n / similarity + _SLACK), "right")) + 1)


def shared(keys: np.ndarray, nodes: np.ndarray, told: np.ndarray, last: bool) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, ...]]:
    """(bucket, node) of the keys that several nodes have, and what is left for later rows of the same range.

    The last time, keys with the same nodes give one bucket, named by a hash of these; before, keys are buckets of their
    own, and one row of each stays that is told already.
    """
    order = np.lexsort((~told, nodes, keys))  # of equal rows the told one is first
    keys, nodes, told = keys[order], nodes[order], told[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
    keys, nodes, told = keys[fresh], nodes[fresh], told[fresh]
    starts = np.nonzero(np.r_[True, keys[1:] != keys[:-1]])[0] if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(keys)])
    known = np.logical_or.reduceat(told, starts) if len(starts) else np.zeros(0, bool)
    if not last:
        out = np.repeat((sizes > 1) | known, sizes) & ~told
        told = told | np.repeat(sizes > 1, sizes)
        stay = np.ones(len(keys), bool)
        stay[np.repeat(known | (sizes > 1), sizes)] = False
        stay[starts] = True
        return (keys[out], nodes[out]), (keys[stay], nodes[stay], told[stay])
    single = np.repeat(known, sizes) & ~told
    several = ~known & (sizes > 1)
    mixed = nodes.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    mixed ^= mixed >> np.uint64(31)
    names = np.add.reduceat(mixed, starts) if len(starts) else mixed
    _, at = np.unique(names[several], return_index=True)
    kept = np.zeros(len(starts), bool)
    kept[np.nonzero(several)[0][at]] = True
    rows = np.repeat(kept, sizes)
    return (np.concatenate([keys[single], np.repeat(names, sizes)[rows]]), np.concatenate([nodes[single], nodes[rows]])), (keys[:0], nodes[:0], told[:0])


def meetings(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(key, node): buckets of the nodes that share a shingle of their prefixes, one for all shingles that the same nodes share.

    Prefixes go to ranges of hashes as arrays, 16 bytes a shingle; only shingles that several nodes have leave them.
    """
    words = words_of(texts)
    bitmap, slots = shingle_levels(texts, shingle, words)
    release(texts.sparkSession)  # of the counts, before the prefixes are shuffled
    shift, told, n_levels = np.uint64(64 - (slots.bit_length() - 1)), texts.sparkSession.sparkContext.broadcast(bitmap.tobytes()), len(bitmap)
    ranges = _RANGES
    while ranges * _RANGE < (1 - similarity) * words and ranges < 1 << 16:
        ranges *= 2
    down, held_most = np.uint64(64 - (ranges.bit_length() - 1)), _COUNTED

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts(keys: list[np.ndarray], nodes: list[np.ndarray]) -> pa.RecordBatch:
            keys, nodes = np.concatenate(keys), np.concatenate(nodes)
            order = np.argsort(keys)
            keys, nodes = keys[order], nodes[order]
            ends = np.searchsorted(keys >> down, np.arange(ranges + 1, dtype=np.uint64))
            rows = [(k, keys[ends[k] : ends[k + 1]].tobytes(), nodes[ends[k] : ends[k + 1]].tobytes()) for k in np.nonzero(np.diff(ends))[0].tolist()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["range", "keys", "nodes"])

        levels = np.frombuffer(told.value, np.uint8).reshape(n_levels, -1)
        keys, nodes, size = [], [], 0
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = prefix(np.array(shingle_hashes(text, shingle), np.int64).view(np.uint64), levels, shift, similarity)
                keys.append(found)
                nodes.append(np.full(len(found), node, np.int64))
                size += len(found)
            if size >= held_most // 2:
                yield parts(keys, nodes)
                keys, nodes, size = [], [], 0
        if size:
            yield parts(keys, nodes)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found[0].view(np.int64)), pa.array(found[1])], ["key", "node"])

        now, held, size = None, [], 0
        for batch in batches:
            for k, keys, nodes in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if held and (k != now or size >= held_most):
                    found, left = shared(*(np.concatenate(x) for x in zip(*held, strict=True)), k != now)
                    yield rows(found)
                    held, size = [left], 0
                part = np.frombuffer(keys.as_buffer(), np.uint64), np.frombuffer(nodes.as_buffer(), np.int64)
                held.append((*part, np.zeros(len(part[0]), bool)))
                now, size = k, size + len(part[0])
        if held:
            yield rows(shared(*(np.concatenate(x) for x in zip(*held, strict=True)), True)[0])

    dealt = texts.mapInArrow(placed, "range long, keys binary, nodes binary").repartition("range").sortWithinPartitions("range")
    return materialize(dealt.mapInArrow(met, "key long, node long").distinct(), "near-meetings")


def _held(texts: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """The texts of nodes, and by chance some more."""
    bits = bitmaps.bits_for(n)
    return bitmaps.flagged(texts, F.xxhash64("node"), bitmaps.bitmap(nodes, F.xxhash64("node"), bits), bits, "held").where("held").select("node", "text")


def shingle_links(texts: DataFrame, shingle: int, similarity: float, bucket_limit: int) -> list[DataFrame]:
    """Links (a, b), in parts, that join all nodes of that Jaccard similarity, by the shingles of their prefixes.

    Sizes and sketches that rule the similarity out make no link; a sketch is wide enough for the size of its tier's sets
    to tell unlike ones apart, so that chance meetings of long texts do not hang together.
    """
    met = meetings(texts, shingle, similarity)
    release(texts.sparkSession)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes = np.array(shingle_hashes(text, shingle), np.int64).view(np.uint64)
                rows += [(node, t, len(hashes), sketch(hashes, SKETCH_WORDS << 2 * t).tobytes()) for t in tiers_of(len(hashes), similarity)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.binary()))], ["node", "tier", "fp", "sketch"])

    sketches = materialize(_held(texts, met, met.count()).mapInArrow(sketched, "node long, tier int, fp long, sketch binary"), "near-sketches")

    def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return sketches_apart(x, y, similarity)

    out = []
    for tier in sorted(r.tier for r in sketches.select("tier").distinct().collect()):
        rows = met.join(sketches.where(F.col("tier") == tier), "node").select("key", "fp", F.col("node").alias("id"), "sketch")
        out.append(_search(rows, 0, max(min(bucket_limit, 1024), bucket_limit >> tier), apart))
    return out


def fingerprint_links(df: DataFrame, id_col: str, text_col: str, shingle: int, bucket_limit: int) -> DataFrame:
    """Links (a, b) that join the nodes whose fingerprints links of at most MAX_BITS join; texts without words have none."""
    rows = materialize(fingerprints(df, id_col, text_col, shingle).where("fp <> 0").select(F.xxhash64("id", "th").alias("node"), "fp"), "near-fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("node").alias("least")), "near-fingerprint-nodes")
    roots = components(links(nodes, MAX_BITS, bucket_limit)).withColumnRenamed("node", "fp")
    placed = nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    named = placed.join(nodes.select(F.col("fp").alias("root"), "least"), "root").select("fp", "least")
    return rows.join(named, "fp").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()


def near_links(df: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, bucket_limit: int) -> DataFrame:
    """Links (a, b) of nodes, xxhash64(identifier, text hash), with the components of all links of that Jaccard similarity.

    Candidates have fingerprints that meet by the Golay keys, or share a shingle of their prefixes and have sizes and
    sketches that allow the similarity, so no pair is missed. They hang together in blocks, and the shingle sets of a
    block's members are compared exactly; a block over the limit is dealt into parts, all pairs of which are compared.
    No step writes out a block's pairs.
    """
    ship(df.sparkSession)
    texts = df.select(F.xxhash64(id_col, F.xxhash64(text_col)).alias("node"), F.col(text_col).cast("binary").alias("text"))
    candidates = materialize(fingerprint_links(df, id_col, text_col, shingle, bucket_limit), "near-candidates")
    release(df.sparkSession)
    for part in shingle_links(texts, shingle, similarity, bucket_limit):
        candidates = candidates.union(part)
    found = components(candidates)
    blocks = found.union(found.select(F.col("root").alias("node"), "root").distinct())
    held = _held(texts, blocks, blocks.count())

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_hashes(t, shingle) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))], ["node", "s"])

    sets = materialize(held.mapInArrow(shingled, "node long, s array<long>").join(blocks, "node"), "near-shingles")
    sizes = sets.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.size("s")).alias("w"))
    parts = F.greatest(F.ceil(F.col("n") * 3 / _BLOCK_NODES), F.ceil(F.col("w") * 3 / _BLOCK_SHINGLES))
    large = materialize(sizes.where((F.col("n") > _BLOCK_NODES) | (F.col("w") > _BLOCK_SHINGLES)).select("root", (parts + 1).alias("parts")), "near-large")
    dealt = sets.join(large, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    groups = dealt.select(F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "node", "s").unionByName(sets.join(large, "root", "left_anti").select(F.col("root").alias("key"), "node", "s"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(nodes: list[int], members: list[np.ndarray]) -> pa.RecordBatch:
            made = verified(members, similarity)
            return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in made], pa.int64()), pa.array([nodes[j] for _, j in made], pa.int64())], ["a", "b"])

        key, nodes, members = None, [], []
        for batch in batches:
            values = batch.column(2)
            flat, ends = values.flatten().to_numpy(), np.cumsum(pc.list_value_length(values).to_numpy())
            for k, node, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), np.split(flat, ends[:-1]), strict=True):
                if k != key:
                    if len(nodes) > 1:
                        yield done(nodes, members)
                    key, nodes, members = k, [], []
                nodes.append(node)
                members.append(part)
        if len(nodes) > 1:
            yield done(nodes, members)

    return groups.repartition("key").sortWithinPartitions("key", "node").mapInArrow(compare, "a long, b long")


_BLOCK_NODES, _BLOCK_SHINGLES = 1500, 2_000_000  # of a block that one task compares


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, bucket_limit: int = 16384) -> DataFrame:
    """The rows of df, as they are, less all but one of each group of near copies: that with the smallest identifier.

    Near copies are joined by links of at least that Jaccard similarity over word shingles. Rows without words are near
    copies of nothing and stay; rows that agree in identifier and text share a verdict; a null identifier comes last.
    """
    found = components(materialize(near_links(df, id_col, text_col, shingle, similarity, bucket_limit), "near-links"))
    members = found.union(found.select(F.col("root").alias("node"), "root").distinct())
    rows = df.select(F.struct(*(F.col(c) for c in df.columns)).alias("row"), F.col(id_col).alias("id"), F.xxhash64(id_col, F.xxhash64(text_col)).alias("node"))
    bits = bitmaps.bits_for(2 * found.count())
    told = bitmaps.flagged(rows, F.xxhash64("node"), bitmaps.bitmap(members, F.xxhash64("node"), bits), bits, "held")
    names = told.where("held").select("node", "id").join(members, "node")
    first = names.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "node"))["node"].alias("node"))
    gone = materialize(members.select("node").join(first.select("node"), "node", "left_anti"), "near-copies")
    kept = told.where("held").join(gone, "node", "left_anti")
    return told.where("not held").select("row.*").unionByName(kept.select("row.*"))


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
