"""Bloom filters as broadcast bitmaps, in DataFrame functions only.

A key of 64 bits has two positions. A filter has 16 bits for each key that it is made of, at most ``max_bits``; its pages of
4 kB are a table that is broadcast, ``max_bits / 8`` bytes (32 MB) at most whatever the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.scratch import materialise

MAX_BITS = 1 << 28
PAGE_BITS = 32768  # of a bitmap of bitmap_construct_agg


def bits_for(keys: int, max_bits: int = MAX_BITS) -> int:
    bits = PAGE_BITS
    while bits < min(16 * keys, max_bits):
        bits *= 2
    return bits


def positions(key: Column, bits: int) -> Column:
    return F.array_distinct(F.array(key.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(key, 32).bitwiseAND(F.lit(bits - 1))))


def pages_of(slots: DataFrame) -> DataFrame:
    """page, bitmap of the positions in the column ``slot``."""
    return slots.groupBy(F.bitmap_bucket_number(F.col("slot") + 1).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("slot") + 1)).alias("bitmap"))


def _bit(bitmap: Column, slot: Column) -> Column:
    at = F.bitmap_bit_position(slot + 1)
    byte = F.conv(F.hex(F.substring(bitmap, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))


def unused(columns: list[str], count: int) -> list[str]:
    """Names that no column has, in any case."""
    taken, out, k = {c.lower() for c in columns}, [], 0
    while len(out) < count:
        if (name := f"_{k}") not in taken:
            out.append(name)
        k += 1
    return out


def held(rows: DataFrame, key: Column, pages: DataFrame, bits: int, name: str) -> DataFrame:
    """``rows`` with a column ``name``: whether the filter holds the key (surely, if it was made of it)."""
    slots, *own = unused([*rows.columns, name], 5)
    out, found = rows.withColumn(slots, positions(key, bits)), F.lit(True)
    for k in (0, 1):
        page, bitmap = own[2 * k : 2 * k + 2]
        slot = F.coalesce(F.try_element_at(F.col(slots), F.lit(k + 1)), F.col(slots)[0])
        side = F.broadcast(pages.select(F.col("page").alias(page), F.col("bitmap").alias(bitmap)))
        out = out.join(side, F.bitmap_bucket_number(slot + 1) == F.col(page), "left")
        found = found & _bit(F.col(bitmap), slot)
    return out.withColumn(name, found).select(*(F.col(f"`{c}`") for c in rows.columns), name)


def without(rows: DataFrame, keys: list[Column], gone: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``rows`` without those whose keys are a row of ``gone``, which has the keys as columns; all columns as they are.

    Rows that a filter of ``gone`` doesn't hold pass by; only the others are shuffled and joined. A null key stays.
    """
    fresh = unused(rows.columns, 2 * len(keys) + 2)
    own, other, (whole, flag) = fresh[: len(keys)], fresh[len(keys) : 2 * len(keys)], fresh[-2:]
    listed = materialise(gone.toDF(*other).distinct(), "gone-keys")
    bits = bits_for(listed.count(), max_bits)
    pages = materialise(pages_of(listed.select(F.explode(positions(F.xxhash64(*other), bits)).alias("slot"))), "gone-pages")
    keyed = rows.select("*", *(k.alias(name) for k, name in zip(keys, own, strict=True))).withColumn(whole, F.xxhash64(*own))
    probed = held(keyed, F.col(whole), pages, bits, flag)
    columns = [F.col(f"`{c}`") for c in rows.columns]
    same = [F.col(x) == F.col(y) for x, y in zip(own, other, strict=True)]
    return probed.filter(~F.col(flag)).select(*columns).unionByName(probed.filter(flag).join(listed, same, "left_anti").select(*columns))
