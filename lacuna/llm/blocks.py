"""Statistics that texts need from the whole corpus, gathered and returned by blocks of documents.

A block holds some megabytes of documents as one compressed row. Blocks send
entries, each a 64-bit key with some numbers, to ranges of the keys; a range
combines the entries of all blocks and answers each block for the keys that it
sent. A key is sent once a block however often it occurs in it, so a key that a third of
all rows hold still costs one entry a block, and nothing is broadcast.

Entries of a block for one range travel as one packed row, sorted by key, and the
answer is a number for each of them in the same order; the answers of all ranges,
in the order of the ranges, stand beside the block's sorted keys.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from lacuna.llm import textbytes as tb
from lacuna.llm.scratch import materialise

BLOCK_BYTES = 4 << 20
BLOCK_SCHEMA = "block long, n_docs long, doc_ids binary, offsets binary, data binary"
SENT_SCHEMA = "part int, block long, entries binary"
ANSWER_SCHEMA = "part int, block long, answers binary"


def packed(block: int, *chunks: tb.Chunk, only: np.ndarray | None = None) -> dict:
    """A row of BLOCK_SCHEMA with these texts, or ``only`` some of them."""
    only = np.ones(sum(map(len, chunks)), bool) if only is None else only
    ids = np.concatenate([c.ids for c in chunks])[only]
    null = np.concatenate([c.id_null for c in chunks])[only]
    lens = np.concatenate([np.where(c.null, -1, c.ends - c.starts) for c in chunks])[only]
    texts = ((c, k) for c in chunks for k in range(len(c)))
    data = b"".join(c.text(k) for (c, k), own in zip(texts, only.tolist(), strict=True) if own)
    return {"block": block, "n_docs": len(ids), "doc_ids": ids.astype("<i8").tobytes() + null.tobytes(), "offsets": lens.astype("<i8").tobytes(), "data": zip_bytes(data)}


def _pack(batches, limit: int):
    task, seq = TaskContext.get().partitionId(), 0
    held: list[tb.Chunk] = []

    def flush():
        nonlocal seq
        row = pa.RecordBatch.from_pylist([packed((task << 32) | seq, *held)])
        held.clear()
        seq += 1
        return row

    size = 0
    for chunk in tb.chunks(batches):
        held.append(chunk)
        size += len(chunk.data)
        if size >= limit:
            yield flush()
            size = 0
    if held:
        yield flush()
    tb.give_back()


def pack_blocks(docs: DataFrame, id_col: str, text_col: str, limit: int = BLOCK_BYTES) -> DataFrame:
    """A written table of blocks. Their numbers are those of the tasks that wrote them, fixed once written."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return materialise(texts.mapInArrow(functools.partial(_pack, limit=limit), BLOCK_SCHEMA), "blocks")


def unpack(doc_ids: bytes, lens: bytes, data: bytes) -> tb.Chunk:
    lens = np.frombuffer(lens, "<i8")
    n = len(lens)
    text = np.frombuffer(unzip_bytes(data, int(np.maximum(lens, 0).sum())), np.uint8)
    null = np.frombuffer(doc_ids[8 * n :], bool)
    return tb.make_chunk(np.frombuffer(doc_ids[: 8 * n], "<i8"), null, lens < 0, text, tb.offsets(np.maximum(lens, 0)))


def read(batches) -> Iterator[tuple[int, tb.Chunk, list]]:
    """Blocks with the further columns of their rows."""
    for batch in batches:
        for k in range(batch.num_rows):
            block, _, ids, lens, data = (batch.column(j)[k] for j in range(5))
            yield block.as_py(), unpack(ids.as_py(), lens.as_py(), data.as_py()), [batch.column(j)[k] for j in range(5, batch.num_columns)]


def one_at_a_time(read, keep: bool = False):
    """A step on what ``read`` yields of the batches, made of a function that gives the rows of one block: nothing of a block is held while the next is read, nor when the task is over.

    ``keep``: the memory of a block is used for the next, and returned to the system when the task is over.
    """

    def step(rows):
        @functools.wraps(rows)
        def run(batches, **settings):
            if keep:
                tb.keep_freed()
            for found in read(batches):
                out = rows(*found, **settings)
                del found
                if not keep:
                    tb.give_back()
                yield out
                del out
            tb.give_back()

        return run

    return step


def lean(combine):
    """A range's function that returns its memory to the system."""

    @functools.wraps(combine)
    def run(table: pa.Table) -> pa.Table:
        out = combine(table)
        tb.give_back()
        return out

    return run


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Parts are ranges of the 64-bit keys."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _planes(values: np.ndarray) -> list[np.ndarray]:
    """The bytes of 64-bit numbers, lowest first, each contiguous; those that are 0 in all numbers are left out at the top."""
    values = np.ascontiguousarray(np.asarray(values).astype(values.dtype if values.dtype == np.uint64 else "<i8", copy=False)).view("<u8")
    bits = int(np.bitwise_or.reduce(values)).bit_length() if len(values) else 0
    return [(values >> np.uint64(8 * k)).astype(np.uint8) for k in range((bits + 7) // 8)]


def _from_planes(planes: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    for k, plane in enumerate(planes):
        out[:, k] = plane
    return out.view("<i8").reshape(-1)


def squeeze(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Sorted 64-bit keys, as differences, and 64-bit numbers beside them, byte planes together, compressed."""
    planes = [_planes(c) for c in (np.diff(keys.astype(np.uint64), prepend=np.uint64(0)), *columns)]
    return len(keys).to_bytes(8, "little") + bytes(map(len, planes)) + zip_bytes(b"".join(x.data for own in planes for x in own))


def expand(packed: bytes, columns: int) -> list[np.ndarray]:
    """What :func:`squeeze` took: keys and ``columns`` columns."""
    n = int.from_bytes(packed[:8], "little")
    used = list(packed[8 : 9 + columns])
    planes = np.frombuffer(unzip_bytes(packed[9 + columns :], n * sum(used)), np.uint8).reshape(sum(used), n)
    at = np.cumsum([0, *used]).tolist()
    found = [_from_planes(planes[a:b], n) for a, b in zip(at[:-1], at[1:], strict=True)]
    return [np.cumsum(found[0].view("<u8")), *found[1:]]


def squeeze_hashes(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """As :func:`squeeze`, for keys that are hashes: the first stands alone, and of the differences the planes below the mean difference are noise, which isn't compressed."""
    keys = keys.astype(np.uint64, copy=False)
    first, last = (int(keys[0]), int(keys[-1])) if len(keys) else (0, 0)
    own = _planes(np.diff(keys, prepend=keys[:1]))
    noise = min(len(own), ((last - first) // max(1, len(keys))).bit_length() // 8)
    planes = [_planes(c) for c in columns]
    rest = zip_bytes(b"".join(x.data for some in (own[noise:], *planes) for x in some))
    return b"".join((len(keys).to_bytes(8, "little"), first.to_bytes(8, "little"), bytes((noise, len(own), *map(len, planes))), *(x.data for x in own[:noise]), rest))


def expand_hashes(packed: bytes, columns: int) -> list[np.ndarray]:
    """What :func:`squeeze_hashes` took: keys and ``columns`` columns."""
    n, first = (int.from_bytes(packed[k : k + 8], "little") for k in (0, 8))
    noise, *used = packed[16 : 18 + columns]
    head = 18 + columns
    rest = np.frombuffer(unzip_bytes(packed[head + n * noise :], n * (sum(used) - noise)), np.uint8)
    planes = [*np.frombuffer(packed, np.uint8, n * noise, head).reshape(noise, n), *rest.reshape(sum(used) - noise, n)]
    at = np.cumsum([0, *used]).tolist()
    found = [_from_planes(planes[a:b], n) for a, b in zip(at[:-1], at[1:], strict=True)]
    return [np.cumsum(found[0].view("<u8"), dtype=np.uint64) + np.uint64(first), *found[1:]]


def zip_bytes(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unzip_bytes(data: bytes, size: int) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, size))


def numbers_out(values: np.ndarray) -> bytes:
    """64-bit numbers, byte planes together, compressed."""
    planes = _planes(values)
    return len(values).to_bytes(8, "little") + bytes([len(planes)]) + zip_bytes(b"".join(x.data for x in planes))


def numbers_in(packed: bytes) -> np.ndarray:
    """What :func:`numbers_out` took."""
    n = int.from_bytes(packed[:8], "little")
    return _from_planes(np.frombuffer(unzip_bytes(packed[9:], packed[8] * n), np.uint8).reshape(packed[8], n), n)


def sent(block: int, parts: np.ndarray, entries: list[bytes]) -> pa.RecordBatch:
    """Rows of SENT_SCHEMA: what a block sends to each of these parts."""
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(np.full(len(parts), block), pa.int64()), pa.array(entries, pa.binary())], names=["part", "block", "entries"])


def cut(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts that sorted ``keys`` fall in, and parts + 1 bounds."""
    bounds = np.searchsorted(part_of(keys, parts), np.arange(parts + 1))
    return np.flatnonzero(np.diff(bounds)), bounds


def answers(part: int, blocks: list, packed: list[bytes]) -> pa.Table:
    """Rows of ANSWER_SCHEMA."""
    return pa.table({"part": pa.array([part] * len(blocks), pa.int32()), "block": pa.array(blocks, pa.int64()), "answers": pa.array(packed, pa.binary())})


def totals(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts the keys, starts of equal ones in it, and for each key its place among the distinct ones."""
    order = tb.order_of(keys)
    ordered = keys[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(keys) else np.zeros(0, bool)
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), place


def gathered(answers: DataFrame) -> DataFrame:
    """A row for each block: its answers, in the order of the parts."""
    return answers.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "answers"))), lambda x: x["answers"]).alias("answers"))


def beside(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """The blocks with their answers, joined in the order of the parts, as a last column."""
    return blocks.join(gathered(answers), "block", "left").select(*blocks.columns, "answers")


def parts_for(blocks: DataFrame) -> int:
    """Ranges of the keys: one for four blocks, so a range gets as much however many blocks there are."""
    return max(12, blocks.count() // 4)
