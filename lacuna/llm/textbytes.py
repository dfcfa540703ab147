"""Vectorised work on the UTF-8 bytes of many texts at once.

A :class:`Chunk` holds some texts in one byte array, each preceded by one space,
with padding behind, so that words, hashes and gathers need no Python loop over
characters. A chunk holds about ``CHUNK_BYTES``; a longer text is a chunk of its own.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

from lacuna.llm.scratch import small_batches

CHUNK_BYTES = 1 << 20
PAD = 16

#: ASCII upper case to lower case, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: True for the bytes of words that white space (0x20, 0x09-0x0D) ends.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: True for the bytes of words of digits, letters and everything outside ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


@dataclass
class Chunk:
    ids: np.ndarray  # int64; 0 where ``id_null``
    id_null: np.ndarray  # bool
    null: np.ndarray  # bool: the text is null
    data: np.ndarray  # uint8: a space before each text, spaces at the end
    starts: np.ndarray  # int64: where each text starts in ``data``
    ends: np.ndarray  # int64

    def __len__(self) -> int:
        return len(self.ids)

    def text(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()

    def id_array(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=self.id_null)


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
    wide = pa.types.is_large_binary(column.type)
    null = np.asarray(column.is_null())
    _, offsets, values = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    return data, at, null


def make_chunk(ids: np.ndarray, id_null: np.ndarray, null: np.ndarray, data: np.ndarray, at: np.ndarray) -> Chunk:
    """``at``: len + 1 offsets of the texts in ``data``."""
    n = len(ids)
    lens = np.where(null, 0, np.diff(at))
    starts = np.arange(1, n + 1) + np.concatenate(([0], np.cumsum(lens)[:-1])) if n else np.zeros(0, np.int64)
    out = np.full(int(lens.sum()) + n + PAD, 0x20, np.uint8)
    for s, a, m in zip(starts.tolist(), at.tolist(), lens.tolist(), strict=False):
        out[s : s + m] = data[a : a + m]
    return Chunk(ids, id_null, null, out, starts.astype(np.int64), (starts + lens).astype(np.int64))


def give_back() -> None:
    """Return freed memory to the system: workers that wait for a task count against their executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def keep_freed() -> None:
    """From now on freed memory stays with this process until :func:`give_back`: steps that need as much again and again don't ask the system for the same pages each time."""
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD, the most it takes
        libc.mallopt(-1, 1 << 30)  # M_TRIM_THRESHOLD


def chunks(batches: Iterable[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Columns 0 and 1 of the batches: id and text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0)
        id_null = np.asarray(ids.is_null())
        ids = np.asarray(ids.fill_null(0)).astype(np.int64)
        data, at, null = _binary(batch.column(1))
        low = 0
        while low < len(ids):
            high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
            yield make_chunk(ids[low:high], id_null[low:high], null[low:high], data, at[low : high + 1])
            low = high
        del batch, data, ids
        give_back()


def _filter(batches, at: int, decide):
    for batch in batches:
        count = pa.array(np.arange(batch.num_rows), pa.int64())
        pair = pa.RecordBatch.from_arrays([count, batch.column(at)], names=["i", "t"])
        keep = [decide(chunk) for chunk in chunks([pair])]
        if keep:
            yield batch.filter(pa.array(np.concatenate(keep)))


def filter_rows(docs: DataFrame, text_col: str, decide) -> DataFrame:
    """The rows of ``docs`` for whose texts ``decide(chunk)`` is true, with all columns; nothing is joined or shuffled."""
    small_batches(docs.sparkSession)
    fields = [StructField(f"c{k}", f.dataType) for k, f in enumerate(docs.schema)]  # Arrow functions can't take every name
    plain = docs.toDF(*(f.name for f in fields))
    return plain.mapInArrow(functools.partial(_filter, at=docs.columns.index(text_col), decide=decide), StructType(fields)).toDF(*docs.columns)


def of_texts(texts: list[bytes | None]) -> Chunk:
    """A chunk of these texts, with their positions as ids."""
    null = np.array([t is None for t in texts], dtype=bool)
    at = np.concatenate(([0], np.cumsum([len(t or b"") for t in texts]))).astype(np.int64)
    ids = np.arange(len(texts), dtype=np.int64)
    return make_chunk(ids, np.zeros(len(texts), bool), null, np.frombuffer(b"".join(t or b"" for t in texts), np.uint8), at)


def words(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes for which the table ``inside`` holds; ``data`` starts and ends outside."""
    flags = inside[data]
    edges = np.flatnonzero(flags[1:] != flags[:-1]) + 1
    return edges[0::2], edges[1::2]


def per_text(chunk: Chunk, positions: np.ndarray) -> np.ndarray:
    """len + 1 offsets into sorted ``positions``: those of text k are ``[out[k], out[k + 1])``."""
    return np.append(np.searchsorted(positions, chunk.starts), len(positions)).astype(np.int64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    return _mix(h.astype(np.uint64, copy=False))


def hash_spans(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal for equal bytes, whatever lies around them. ``data`` has PAD bytes behind the last span."""
    eight = np.ndarray((len(data) - 7,), "<u8", data.data if data.flags.c_contiguous else np.ascontiguousarray(data).data, strides=(1,))
    out = _mix(lens.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    act = np.flatnonzero((lens > 0) & (lens <= 64))
    at, left = starts[act], lens[act]
    while len(act):
        out[act] = _mix(out[act] ^ (eight[at] & _LOW_BYTES[np.minimum(left, 8)]))
        more = left > 8
        act, at, left = act[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(lens > 64).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : starts[k] + lens[k]].tobytes())
    return out


def order_of(keys: np.ndarray) -> np.ndarray:
    """The order that sorts unsigned 64-bit keys, equal ones as they stand: by their leading bits with places in the others, which sorts values and not places."""
    bits = np.uint64(max(1, (len(keys) - 1).bit_length()))
    packed = np.sort((keys >> bits << bits) | np.arange(len(keys), dtype=np.uint64))
    order = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    ordered = keys[order]
    if (ordered[1:] < ordered[:-1]).any():  # different keys with the same leading bits
        order = np.argsort(keys, kind="stable")
    return order


def span_keys(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Keys of byte spans that are equal only for equal bytes: their hashes, if spans of one hash have the same bytes, else numbers."""
    keys = hash_spans(data, starts, lens)
    if not len(keys):
        return keys
    order = order_of(keys)
    new = np.concatenate(([True], keys[order][1:] != keys[order][:-1]))
    first = order[np.flatnonzero(new)][np.cumsum(new) - 1]  # of each span, in order, the first that has its hash
    other = ~new
    a, b = order[other], first[other]
    if (lens[a] == lens[b]).all() and np.array_equal(ragged(data, starts[a], lens[a]), ragged(data, starts[b], lens[b])):
        return keys
    number: dict[bytes, int] = {}
    return np.array([number.setdefault(data[s : s + n].tobytes(), len(number)) for s, n in zip(starts.tolist(), lens.tolist(), strict=True)], np.uint64)


def ragged(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """``flat[s : s + n]`` for each s, n, concatenated."""
    lens = lens.astype(np.int64)
    total = int(lens.sum())
    if not total:
        return flat[:0]
    shift = starts.astype(np.int64) - (np.cumsum(lens) - lens)
    return flat[np.repeat(shift, lens) + np.arange(total)]


def offsets(lens: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lens))).astype(np.int64)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring ``bounds``; 0 for empty ranges."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[bounds[1:]] - total[bounds[:-1]]


class SpanCache:
    """Integer sequences of byte spans by the spans' hashes, in a direct-mapped table of fixed size."""

    def __init__(self, encode, slots_log2: int = 21, most: int = 1_000_000):
        self.encode, self.shift, self.most = encode, np.uint64(64 - slots_log2), most
        self.keys = np.zeros(1 << slots_log2, np.uint64)
        self.vals = np.full(1 << slots_log2, -1, np.int32)
        self.start, self.size = np.zeros(most + 1, np.int32), np.zeros(most + 1, np.int32)
        self.flat, self.used, self.n = np.zeros(1 << 16, np.int32), 0, 0

    def _add(self, sequences: list) -> np.ndarray:
        sizes = np.array([len(s) for s in sequences], np.int64)
        if self.n + len(sizes) > len(self.start):
            grown = self.n + len(sizes)
            self.start, self.size = np.resize(self.start, grown), np.resize(self.size, grown)
        total = int(sizes.sum())
        while self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + total] = [x for s in sequences for x in s]
        at = np.arange(self.n, self.n + len(sizes))
        self.start[at], self.size[at] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += total
        self.n += len(sizes)
        return at

    def __call__(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequences of all spans, concatenated, and each span's length in it."""
        hashes = hash_spans(data, starts, lens)
        if self.n > self.most or self.used > 8 * self.most:
            self.vals[:] = -1
            self.used = self.n = 0
        slot = (hashes >> self.shift).astype(np.int64)
        at = self.vals[slot]
        miss = np.flatnonzero((at < 0) | (self.keys[slot] != hashes))
        if len(miss):
            _, first, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
            where = miss[first]
            spans = [data[s : s + n].tobytes() for s, n in zip(starts[where].tolist(), lens[where].tolist(), strict=True)]
            at[miss] = self._add(self.encode(spans))[back]
            self.keys[slot[miss]], self.vals[slot[miss]] = hashes[miss], at[miss]
        size = self.size[at]
        return ragged(self.flat, self.start[at], size), size
