"""A filter for joins: one bit for each key's hash, in a bitmap whose size has a fixed bound, so that it can be broadcast.

It has no false negatives; when it fills up it only passes more rows on to the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_BITS, MAX_BITS = 1 << 18, 1 << 28  # at most 32 MB
BUCKET_BITS = 32768  # of one value of bitmap_construct_agg


def bits_for(n: int, per_key: int = 16) -> int:
    """Number of bits, a power of two, for n keys."""
    bits = MIN_BITS
    while bits < min(per_key * n, MAX_BITS):
        bits *= 2
    return bits


def _slot(key: Column, bits: int) -> Column:
    """The upper bits of a 64-bit hash, and 1 more: Spark's bitmap functions count from 1."""
    return F.shiftrightunsigned(key, 64 - (bits.bit_length() - 1)) + 1


def bitmap(keys: DataFrame, key: Column, bits: int) -> DataFrame:
    """(bucket, bits) for the hashes in column key."""
    slot = _slot(key, bits)
    slots = keys.select(F.bitmap_bucket_number(slot).alias("bucket"), F.bitmap_bit_position(slot).alias("at"))
    return slots.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits"))


def flagged(rows: DataFrame, key: Column, filter_: DataFrame, bits: int, name: str) -> DataFrame:
    """rows with a boolean column: whether key may be among the filter's keys."""
    slot = _slot(key, bits)
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0
    small = F.broadcast(filter_.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits")))
    joined = rows.withColumn("_bucket", F.bitmap_bucket_number(slot)).join(small, "_bucket", "left")
    return joined.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_bucket", "_bits")


def as_bytes(filter_: DataFrame, bits: int) -> bytes:
    """The whole bitmap on the driver: bits / 8 bytes, whatever the number of keys."""
    out = bytearray(bits // 8)
    for row in filter_.toLocalIterator():
        start = (row.bucket - 1) * (BUCKET_BITS // 8)
        part = bytes(row.bits)[: max(0, len(out) - start)]
        out[start : start + len(part)] = part
    return bytes(out)
