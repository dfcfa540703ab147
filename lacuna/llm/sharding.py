"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Each source partition p with n_p rows sends exactly m[p][s] rows to shard s, the
matrix being drawn as n_p draws without replacement from the places left in the
shards. The rows of p take their shards from a random permutation of the row of
the matrix; after the exchange the rows of a shard are permuted again by a random
key, in ranges of the key so that no task holds a whole shard. Every draw is seeded by
(seed, p) and the rows' physical order in a written table, so a task that is run again
gives the same rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.scratch import materialise

MAX_SOURCES = 16384  # source partitions: bounds the matrix to MAX_SOURCES * shards cells
ROWS_PER_RANGE = 50_000


def communication_matrix(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """m[p][s]: row sums are ``counts``, column sums differ by one at most, drawn uniformly over all assignments."""
    total = int(counts.sum())
    room = np.full(shards, total // shards, np.int64)
    room[: total % shards] += 1
    rng = np.random.default_rng([seed, 0])
    room = rng.permutation(room)
    out = np.zeros((len(counts), shards), np.int64)
    for p, n in enumerate(counts.tolist()):
        out[p] = rng.multivariate_hypergeometric(room, n, method="marginals")
        room -= out[p]
    return out


def _deal(batches, matrix, shards: int, seed: int):
    held = {}
    for batch in batches:
        rid = np.asarray(batch.column(0)).astype(np.int64)
        part, at = rid >> 33, rid & ((1 << 33) - 1)
        shard, key = np.zeros(len(rid), np.int32), np.zeros(len(rid), np.int64)
        for p in np.unique(part).tolist():
            if p not in held:
                rng = np.random.default_rng([seed, 1, p])
                row = matrix.value[p]
                held = {p: (rng.permutation(np.repeat(np.arange(shards, dtype=np.int16), row)), rng.integers(0, 1 << 62, int(row.sum()), np.int64))}
            mine = part == p
            shard[mine], key[mine] = held[p][0][at[mine]], held[p][1][at[mine]]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard), pa.array(key)], names=[*batch.schema.names, "shard", "key"])


def shuffle_to_shards(docs: DataFrame, shards: int = 40, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``rows``: shard sizes differ by one row at most and each
    assignment is equally likely. ``slot`` is the row's place in its shard,
    gapless from 0, and the order within a shard is uniformly random. A null text has no
    bytes (size 16, crc of the empty string); null ids, repeated rows and equal
    texts are rows like any others, each with a slot of its own. An empty table gives
    an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = materialise(rows.coalesce(MAX_SOURCES).withColumn("rid", F.monotonically_increasing_id()), "shard-rows")
    found = rows.groupBy(F.shiftright("rid", 33).alias("p")).agg(F.count("*").alias("n")).collect()  # one row a source partition
    counts = np.zeros(1 + max((r["p"] for r in found), default=0), np.int64)
    for r in found:
        counts[r["p"]] = r["n"]
    total = int(counts.sum())
    matrix = spark.sparkContext.broadcast(communication_matrix(counts, shards, seed))  # MAX_SOURCES * shards * 8 bytes at most
    rows = rows.select("rid", "doc_id", "size", "text_crc32")
    dealt = rows.mapInArrow(functools.partial(_deal, matrix=matrix, shards=shards, seed=seed), "rid long, doc_id long, size long, text_crc32 long, shard int, key long")
    ranges = max(1, -(-total // (shards * ROWS_PER_RANGE)))
    dealt = dealt.withColumn("range", (F.shiftright("key", 30) * ranges / F.lit(float(1 << 32))).cast("int"))
    dealt = materialise(dealt, "shard-deal")
    sizes = dealt.groupBy("shard", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row a range, not a document
    within = Window.partitionBy("shard", "range").orderBy("key", "rid")
    out = dealt.withColumn("nth", F.row_number().over(within) - 1).join(sizes, ["shard", "range"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("base") + F.col("nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
