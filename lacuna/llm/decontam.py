"""Benchmark decontamination: an FM-index per shard of training text, searched for benchmark phrases.

A shard is some megabytes of text. Its words become symbols of the benchmark's
vocabulary; a run of benchmark words too short for any phrase can't hold one and is left out of the
index. Phrases (13 consecutive words of an item, or a shorter item as a whole) are
backward-searched through the ranks of a wavelet matrix, their occurrences located by
sampled suffix positions, and the spans merged.

The benchmark is the stated query set. Up to ``BENCHMARK_BYTES`` of it are shipped to the executors at a time, as
symbols and the ends of windows in them, in about three times as many bytes. A larger one is taken in parts, one after the
other, and the parts' spans are merged.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm import textbytes as tb
from lacuna.llm.fm_index import FMIndex
from lacuna.llm.probe import unused, without
from lacuna.llm.scratch import materialise

WINDOW = 13
BENCHMARK_BYTES = 16 << 20
SHARD_BYTES = 4 << 20


def word_spans(chunk: tb.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text in lower case, and starts and ends of its words."""
    low = tb.LOWER[chunk.data]
    return low, *tb.words(low, tb.ALNUM)


class Phrases:
    """The windows of some benchmark items: symbols by word, the items' symbols, where each distinct window ends in them, and the items of each."""

    def __init__(self, items: list[tuple[int, bytes]], window: int = WINDOW):
        chunk = tb.of_texts([t for _, t in items])
        low, starts, ends = word_spans(chunk)
        keys = tb.hash_spans(low, starts, ends - starts)
        self.keys, first, symbols = np.unique(keys, return_index=True, return_inverse=True)
        self.sizes = (ends - starts)[first].astype(np.int32)
        self.text = (symbols + 1).astype(np.int32)
        count = np.diff(tb.per_text(chunk, starts))
        end, length, owner = self._windows(count, window)
        rolled = length.astype(np.uint64)
        for k in range(window):
            rolled = np.where(k < length, tb.mix(rolled * np.uint64(0x9E3779B97F4A7C15) + self.text[end - 1 - np.minimum(k, length - 1)].astype(np.uint64)), rolled)
        ids = np.array([i for i, _ in items], np.int64)[owner]
        order = np.lexsort((ids, rolled))
        same = np.concatenate(([False], (rolled[order][1:] == rolled[order][:-1]) & (ids[order][1:] == ids[order][:-1]))) if len(order) else np.zeros(0, bool)
        order = order[~same]
        new = np.flatnonzero(np.concatenate(([True], rolled[order][1:] != rolled[order][:-1]))) if len(order) else np.zeros(0, np.int64)
        self.ends, self.lens = end[order[new]].astype(np.int32), length[order[new]].astype(np.int32)
        self.owners, self.owner_starts = ids[order], new.astype(np.int32)
        self.owner_counts = np.diff(np.append(new, len(order))).astype(np.int32)
        self.least = int(self.lens.min()) if len(new) else 0

    @staticmethod
    def _windows(count: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of items of so many words: each window's end, its words, and its item's place."""
        size = np.minimum(count, window)
        times = np.where(count > 0, count - size + 1, 0)
        owner = np.repeat(np.arange(len(count)), times)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(times) - times, times)
        return tb.offsets(count)[owner] + nth + size[owner], size[owner], owner

    def symbols(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The words' symbols; 0 for words that no item has."""
        if not len(self.keys):
            return np.zeros(len(starts), np.int64)
        keys = tb.hash_spans(low, starts, ends - starts)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (self.sizes[at] == ends - starts), at + 1, 0)

    def hits(self, chunk: tb.Chunk):
        """Per word: in an occurrence or not; word spans; words' bounds by text; (text, item) pairs in order."""
        low, starts, ends = word_spans(chunk)
        bounds = tb.per_text(chunk, starts)
        nothing = np.zeros((0, 2), np.int64)
        hit = np.zeros(len(starts), bool)
        if not len(self.lens) or not len(starts):
            return hit, starts, ends, bounds, nothing
        symbols = self.symbols(low, starts, ends)
        inside = symbols > 0
        edge = np.zeros(len(symbols) + 1, bool)  # a run starts or ends before this word
        edge[0] = edge[-1] = True
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[bounds] = True
        edges = np.flatnonzero(edge)
        a, size = edges[:-1], np.diff(edges)
        good = inside[a] & (size >= self.least)
        a, size = a[good], size[good]
        if not len(a):
            return hit, starts, ends, bounds, nothing
        at = tb.offsets(size + 1)
        text = np.zeros(int(at[-1]), np.int64)
        word = np.zeros(int(at[-1]), np.int64)
        body = np.ones(len(text), bool)
        body[at[1:] - 1] = False
        word[body] = tb.ragged(np.arange(len(symbols)), a, size)
        text[body] = symbols[word[body]]
        pattern, place = FMIndex(text, at[:-1]).occurrences(self.text, self.ends, self.lens)
        if not len(pattern):
            return hit, starts, ends, bounds, nothing
        cover = np.zeros(len(symbols) + 1, np.int64)
        np.add.at(cover, word[place], 1)
        np.add.at(cover, word[place] + self.lens[pattern], -1)
        hit = np.cumsum(cover)[:-1] > 0
        owner = np.searchsorted(bounds, word[place], "right") - 1
        pairs = np.stack((np.repeat(owner, self.owner_counts[pattern]), tb.ragged(self.owners, self.owner_starts[pattern], self.owner_counts[pattern])), axis=1)
        return hit, starts, ends, bounds, np.unique(pairs, axis=0)


SCHEMA = "doc_id long, text_key long, n_words long, n_hit long, items array<long>, word_starts array<long>, word_ends array<long>, span_starts array<long>, span_ends array<long>"


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.astype(np.int64)))


def _report(chunk: tb.Chunk, phrases: Phrases) -> pa.RecordBatch:
    hit, starts, ends, bounds, pairs = phrases.hits(chunk)
    n = len(chunk)
    before = np.concatenate(([False], hit[:-1]))
    before[bounds[:-1][bounds[:-1] < len(hit)]] = False  # a span ends with its text
    first = np.flatnonzero(hit & ~before)
    after = np.concatenate((hit[1:], [False]))
    after[bounds[1:][bounds[1:] > 0] - 1] = False
    last = np.flatnonzero(hit & ~after)
    owner = np.searchsorted(bounds, first, "right") - 1
    at = np.searchsorted(owner, np.arange(n + 1))
    base = chunk.starts[owner]
    return pa.RecordBatch.from_arrays(
        [
            chunk.id_array(),
            pa.array(tb.hash_spans(chunk.data, chunk.starts, chunk.ends - chunk.starts).view(np.int64)),
            pa.array(np.diff(bounds), pa.int64()),
            pa.array(tb.sums(hit, bounds), pa.int64()),
            _lists(pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(n + 1))),
            _lists(first - bounds[owner], at),
            _lists(last + 1 - bounds[owner], at),
            _lists(starts[first] - base, at),
            _lists(ends[last] - base, at),
        ],
        names=[f.split()[0] for f in SCHEMA.split(", ")],
    )


def _search(batches, phrases):
    for chunk in tb.chunks(batches, SHARD_BYTES):
        yield _report(chunk, phrases.value)


def _union(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    starts, ends = [], []
    for s, e in sorted(zip(a, b, strict=True)):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def _merge(table: pa.Table, parts: int) -> pa.Table:
    """One text's reports on the parts of the benchmark, as one; as often as the row was there."""
    rows = table.to_pylist()
    out = {k: rows[0][k] for k in ("doc_id", "text_key", "n_words")}
    out["items"] = sorted({x for r in rows for x in r["items"]})
    for kind in ("word", "span"):
        out[f"{kind}_starts"], out[f"{kind}_ends"] = _union([x for r in rows for x in r[f"{kind}_starts"]], [x for r in rows for x in r[f"{kind}_ends"]])
    out["n_hit"] = sum(out["word_ends"]) - sum(out["word_starts"])
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    schema = table.schema
    return pa.Table.from_pylist([{k: out[k] for k in names}] * (len(rows) // parts), pa.schema([schema.field(k) for k in names]))


def benchmark_parts(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> tuple[int, Iterator[Phrases]]:
    """The number of parts, and the parts one by one."""
    items = benchmark.filter(F.col(text_col).isNotNull() & F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("i"), F.col(text_col).cast("binary").alias("t"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    parts = max(1, -(-total // limit))
    part = F.pmod(F.xxhash64("t"), F.lit(parts))
    return parts, (Phrases([(r["i"], bytes(r["t"])) for r in items.filter(part == k).toLocalIterator()]) for k in range(parts))


def occurrences(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", limit: int = BENCHMARK_BYTES) -> DataFrame:
    """For each row of ``docs``: doc_id, text_key (a hash of the text), n_words, n_hit, items, and merged spans in words and in bytes.

    A word of a document is hit if it lies in an occurrence of a window. Null texts
    have no words, null items are left out; an item's repeated rows count once; null ids and repeated
    documents are answered row by row; empty tables give no rows or no hits.
    """
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    parts, phrases = benchmark_parts(benchmark, item_col, item_text_col, limit)
    found = []
    for part in phrases:
        shared = context.broadcast(part)  # of ``limit`` bytes of text
        reports = texts.mapInArrow(functools.partial(_search, phrases=shared), SCHEMA)
        if parts == 1:
            return reports
        found.append(materialise(reports, "benchmark-part"))
        shared.destroy()
    keyed = functools.reduce(DataFrame.unionByName, found)
    return keyed.groupBy("doc_id", "text_key").applyInArrow(lambda table: _merge(table, parts), SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **columns) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_spans, of each row of ``docs`` (see :func:`occurrences`).

    Contaminated: some word is hit, and at least one in twenty.
    """
    found = occurrences(docs, benchmark, **columns)
    items = F.concat_ws(",", F.array_sort(F.col("items").cast("array<string>")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), F.size("span_starts").cast("long").alias("n_spans"))


def _clean(chunk: tb.Chunk, phrases) -> np.ndarray:
    hit, _, _, bounds, _ = phrases.value.hits(chunk)
    hits = tb.sums(hit, bounds)
    return ~((hits > 0) & (20 * hits >= np.diff(bounds)))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", limit: int = BENCHMARK_BYTES) -> DataFrame:
    """``docs`` without contaminated rows (see :func:`decontaminate`), all columns as they are; rows without words stay, and an empty table stays empty."""
    parts, phrases = benchmark_parts(benchmark, item_col, item_text_col, limit)
    if parts == 1:
        shared = docs.sparkSession.sparkContext.broadcast(next(phrases))
        return tb.filter_rows(docs, text_col, functools.partial(_clean, phrases=shared))
    (row,) = unused(docs.columns, 1)
    rows = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "decontam-rows")
    bad = decontaminate(rows, benchmark, id_col=row, text_col=text_col, item_col=item_col, item_text_col=item_text_col, limit=limit).filter("contaminated")
    return without(rows, [F.col(row)], bad.select("doc_id")).drop(row)
