"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only.

Pass one lays the 64-bit keys of all text hashes on a counting Bloom filter of
two positions a key, saturated at two, and keeps as a bitmap the positions hit
more than once. Pass two probes it: a hash that misses at one of its positions is
unique, and its row passes straight through; only the other rows are shuffled and
grouped by the whole hash, so a false positive costs a shuffled row and never a
wrong result.

A filter is for at most ``max_bits / 16`` rows (16.8 million by default, in 32 MB). The hashes are written in folders by
ranges of a second hash, as many as it takes, and each range has its own filter and is probed on its own; so no filter
is fuller than with few rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm import probe
from lacuna.llm.scratch import materialise, release

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_sha256(text: Column) -> Column:
    """Binary SHA-256 of the text with A-Z in lower case; null counts as empty."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), 256))


def repeated_positions(hashed: DataFrame, bits: int) -> DataFrame:
    """Pages of the bitmap of positions that two rows or more hit."""
    slots = hashed.select(F.explode(probe.positions(F.xxhash64("h"), bits)).alias("slot"))
    return probe.pages_of(slots.groupBy("slot").agg(F.count("*").alias("c")).filter("c > 1"))


def ranges_for(rows: int, max_bits: int = probe.MAX_BITS) -> int:
    return max(1, -(-16 * rows // max_bits))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = probe.MAX_BITS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as
    empty, so null and empty texts are one group. Of equal texts the row with the
    largest id stays; an id repeated with the same text is the same document and all its
    rows say the same. Null ids never win against others; a group of null ids
    only has a null keep_id and keeps its rows. An empty table gives an empty
    result. Other columns are ignored.
    """
    rows = docs.count()
    ranges = ranges_for(rows, max_bits)
    bits = probe.bits_for(-(-rows // ranges), max_bits)
    hashes = docs.select(F.col(id_col).alias("doc_id"), text_sha256(F.col(text_col)).alias("h"))
    hashed = materialise(hashes.withColumn("range", F.pmod(F.xxhash64("h", F.lit(1)), F.lit(ranges)).cast("int")), "text-hashes", by="range")
    probed = []
    for k in range(ranges):
        own = hashed.filter(F.col("range") == k).select("doc_id", "h")
        pages = materialise(repeated_positions(own, bits), "bloom-pages")
        probed.append(materialise(probe.held(own, F.xxhash64("h"), pages, bits, "maybe"), "probed"))
        release(pages)
    release(hashed)
    probed = functools.reduce(DataFrame.unionByName, probed)
    again = probed.filter("maybe").select("doc_id", "h")
    groups = again.groupBy("h").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    groups = materialise(groups, "copy-groups")
    joined = again.join(groups, "h", "left").select("doc_id", F.when(F.col("group_size") > 1, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), "h")
    alone = probed.filter("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "h")
    out = alone.unionByName(joined)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("h")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`exact_dedup` drops, all columns as they are.

    A row goes by its id and text, so an id that has another text as well keeps that. Rows without id stay where
    :func:`exact_dedup` keeps them, and go as it says where a copy has an id. Only rows that a filter of the dropped ones holds are shuffled.
    """
    gone = exact_dedup(docs, id_col, text_col).filter("not kept").select(F.struct("doc_id").alias("id"), F.unhex("text_sha256").alias("sha"))
    return probe.without(docs, [F.struct(F.col(id_col).alias("doc_id")), text_sha256(F.col(text_col))], gone)
