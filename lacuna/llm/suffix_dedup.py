"""Removal of byte strings that an earlier document has, by suffix sorting and bounded interval expansion.

1. Every ``LENGTH``-byte string has a minimizer, the least hash of its ``GRAM``-byte strings; equal
   strings have equal minimizers at the same place. Blocks of documents send their distinct minimizers with the least and
   the greatest document; those of one document only can't lie in a repeat.
2. For the others, blocks send the context of each minimizer: the stretch of text whose
   ``LENGTH``-byte strings have it, equal contexts once. Equal strings meet in one part of the minimizers' hashes.
3. A part sorts the suffixes of its distinct contexts and expands intervals of the
   Burrows-Wheeler transform backwards, breadth first: an interval of a string w with a symbol c before it gives that of cw,
   whose right border has a common prefix of length |w| if no shorter one was found before.
   Borders of classes by the sort's last round but one (32 symbols for 50) have a value from the start, and the expansion begins with those classes.
   Values come in increasing order and the expansion stops at ``LENGTH``: borders without a value
   then join suffixes that share at least that much. The least document of each class goes back to the blocks.
4. A string is removed in a document with a larger id than the least of its class.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lacuna.llm import blocks as bl
from lacuna.llm import textbytes as tb
from lacuna.llm.fm_index import suffix_classes
from lacuna.llm.scratch import materialise, release

LENGTH = 50
GRAM = 21
PIECE = 1 << 16  # bytes that are hashed at once: arrays that stay in the cache
MIXER = np.uint64(0x9FB21C651E98DF25)
FACTOR = 0xC2B2AE3D27D4EB4F
BYTES = tb.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
PLACE_BITS = np.uint64(20)  # of a position in a piece


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Polynomial hashes of all strings of ``size`` bytes, by doubling."""
    out, covered = None, 0
    power, width = BYTES[data], 1
    while True:
        if size & width:  # widths in binary, smallest at the right end
            if out is None:
                out, covered = power[size - width :], width
            else:
                at = size - covered - width
                factor = np.uint64(pow(FACTOR, covered, 1 << 64))
                out = power[at : at + len(out)] * factor + out
                covered += width
        if covered == size:
            return out
        power = power[: len(power) - width] * np.uint64(pow(FACTOR, width, 1 << 64)) + power[width:]
        width *= 2


def minimizers(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For each start of a ``length``-byte string the place of its minimizer (the leftmost of equal ones), and all gram hashes."""
    strings = len(data) - length + 1
    if strings <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    window = length - gram + 1
    places, hashes = np.empty(strings, np.int64), np.empty(len(data) - gram + 1, np.uint64)
    for a in range(0, strings, PIECE):
        b = min(strings, a + PIECE)
        own = gram_hashes(data[a : b + length - 1], gram)
        hashes[a : a + len(own)] = own
        least = ((own * MIXER) >> PLACE_BITS << PLACE_BITS) | np.arange(len(own), dtype=np.uint64)
        width = 1
        while 2 * width <= window:
            least = np.minimum(least[: len(least) - width], least[width:])
            width *= 2
        if width < window:
            rest = window - width
            least = np.minimum(least[: len(least) - rest], least[rest:])
        places[a:b] = (least & np.uint64((1 << int(PLACE_BITS)) - 1)).astype(np.int64) + a
    return places, hashes


def _runs(chunk: tb.Chunk, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of neighbouring strings of one document with one minimizer: hash, first string, strings, document (place in the chunk)."""
    places, hashes = minimizers(chunk.data, length)
    inside = np.zeros(len(places), bool)
    some = (chunk.ends - chunk.starts >= length) & ~chunk.id_null
    for a, b in zip(chunk.starts[some].tolist(), chunk.ends[some].tolist(), strict=True):
        inside[a : b - length + 1] = True
    change = np.concatenate(([True], (places[1:] != places[:-1]) | (inside[1:] != inside[:-1]))) if len(places) else np.zeros(0, bool)
    first = np.flatnonzero(change)
    count = np.diff(np.append(first, len(places)))
    keep = inside[first] if len(first) else np.zeros(0, bool)
    first, count = first[keep], count[keep]
    return hashes[places[first]], first, count, np.searchsorted(chunk.starts, first, "right") - 1


@bl.one_at_a_time(bl.read)
def _send_minimizers(block: int, chunk: tb.Chunk, _: list, length: int, parts: int) -> pa.RecordBatch:
    keys, _, _, doc = _runs(chunk, length)
    order, first, _ = bl.totals(keys)
    if not len(first):
        return bl.sent(block, first, [])
    ids = chunk.ids[doc][order]
    least, most = np.minimum.reduceat(ids, first), np.maximum.reduceat(ids, first)
    distinct = keys[order][first]
    full, at = bl.cut(distinct, parts)
    return bl.sent(block, full, [bl.squeeze(distinct[a:b], least[a:b], most[a:b] - least[a:b]) for a, b in ((at[p], at[p + 1]) for p in full.tolist())])


@bl.lean
def _answer_minimizers(table: pa.Table) -> pa.Table:
    """For each block which of its minimizers two documents have."""
    found = [bl.expand(p.as_py(), 2) for p in table.column("entries")]
    keys, least, span = (np.concatenate([f[k] for f in found]) for k in range(3))
    order, first, place = bl.totals(keys)
    repeated = (np.minimum.reduceat(least[order], first) < np.maximum.reduceat((least + span)[order], first))[place]
    at = tb.offsets(np.array([len(f[0]) for f in found], np.int64))
    packed = [bl.squeeze(f[0][own], f[1][own]) for f, own in ((f, repeated[a:b]) for f, a, b in zip(found, at[:-1], at[1:], strict=True))]
    return bl.answers(table.column("part")[0].as_py(), table.column("block").to_pylist(), packed)


class _Contexts:
    """The distinct contexts of a block's repeated minimizers, in an order that the block can find again."""

    def __init__(self, chunk: tb.Chunk, answers: pa.Scalar, length: int):
        keys, first, count, doc = _runs(chunk, length)
        wanted = np.concatenate([bl.expand(a.as_py(), 1)[0] for a in answers.values]) if answers.is_valid else np.zeros(0, np.uint64)
        at = np.searchsorted(wanted, keys)
        own = np.flatnonzero((at < len(wanted)) & (wanted[np.minimum(at, len(wanted) - 1)] == keys)) if len(wanted) else np.zeros(0, np.int64)
        keys, self.first, self.count, doc = keys[own], first[own], count[own], doc[own]
        self.ids = chunk.ids[doc]
        size = self.count + length - 1
        content = tb.span_keys(chunk.data, self.first, size)
        order = np.lexsort((content, keys))
        new = np.concatenate(([True], (keys[order][1:] != keys[order][:-1]) | (content[order][1:] != content[order][:-1]))) if len(order) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.cumsum(new) - 1
        pick = order[starts]
        self.keys, self.sizes, self.counts = keys[pick], size[pick], self.count[pick]
        self.least = np.minimum.reduceat(self.ids[order], starts) if len(starts) else np.zeros(0, np.int64)
        self.at = self.first[pick]


@bl.one_at_a_time(bl.read)
def _send_contexts(block: int, chunk: tb.Chunk, further: list, length: int, parts: int) -> pa.RecordBatch:
    own = _Contexts(chunk, further[0], length)
    full, at = bl.cut(own.keys, parts)
    rows = []
    for a, b in ((at[p], at[p + 1]) for p in full.tolist()):
        head = bl.squeeze(own.keys[a:b], own.sizes[a:b], own.least[a:b])
        text = tb.ragged(chunk.data, own.at[a:b], own.sizes[a:b]).tobytes()
        rows.append(len(head).to_bytes(8, "little") + head + bl.zip_bytes(text))
    return bl.sent(block, full, rows)


def expand_intervals(text: np.ndarray, length: int) -> np.ndarray:
    """Class of each position: equal for positions whose next ``length`` symbols are equal and hold no 0.

    ``text`` starts and ends with 0; 0 also parts its pieces.
    """
    n = len(text)
    begun = max(1, 1 << (length - 1).bit_length() >> 1)  # symbols of the sort's last round but one, so borders with a lesser value are those of its classes
    classes, order = suffix_classes(text, begun)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    back = np.where(order > 0, rank[order - 1], -1)  # the suffix one symbol longer; its first symbol is the transform's
    symbol = text[order]
    value = np.full(n + 1, -1, np.int16)
    value[n] = 0
    classes = classes[order]
    low = np.flatnonzero(np.concatenate(([True], classes[1:] != classes[:-1])))
    value[low] = begun - 1  # at most
    high = np.append(low[1:], n)
    places = np.arange(n)
    for depth in range(begun, length):
        size = high - low
        rows = tb.ragged(places, low, size)
        longer = back[rows]
        owner = np.repeat(np.arange(len(low)), size)
        open_ = (longer >= 0) & ((value[longer] < 0) | (value[longer + 1] < 0))  # a suffix with both borders is a class by itself
        packed = np.sort(longer[open_] << 32 | owner[open_])
        longer, owner = packed >> 32, packed & 0xFFFFFFFF
        if not len(longer):
            break
        last = np.concatenate(((owner[1:] != owner[:-1]) | (longer[1:] != longer[:-1] + 1) | (symbol[longer[1:]] != symbol[longer[:-1]]), [True]))
        right = np.flatnonzero(last)
        left = np.concatenate(([0], right[:-1] + 1))
        low, high = longer[left], longer[right] + 1
        new = value[high] < 0
        low, high = low[new], high[new]
        value[high] = depth
    border = value[:n] >= 0
    border[0] = True
    return np.cumsum(border)[rank]


def _answer_contexts(table: pa.Table, length: int) -> pa.Table:
    """For each block and each string of its contexts, the least document that has it."""
    heads, texts = [], []
    for p in table.column("entries"):
        p = p.as_py()
        size = int.from_bytes(p[:8], "little")
        heads.append(bl.expand(p[8 : 8 + size], 2))
        texts.append(np.frombuffer(bl.unzip_bytes(p[8 + size :], int(heads[-1][1].sum())), np.uint8))
    sizes, least = (np.concatenate([h[k] for h in heads]) for k in (1, 2))
    data = np.concatenate([*texts, np.full(tb.PAD, 0x20, np.uint8)])
    at = tb.offsets(sizes)[:-1]
    order, first, place = bl.totals(tb.span_keys(data, at, sizes))
    pick = order[first]
    doc = np.minimum.reduceat(least[order], first)
    size = sizes[pick]
    start = 1 + tb.offsets(size + 1)[:-1]
    text = np.zeros(int((size + 1).sum()) + 1, np.int64)
    body = np.ones(len(text), bool)
    body[0] = False
    body[start + size] = False
    text[body] = tb.ragged(data, at[pick], size).astype(np.int64) + 1
    classes = expand_intervals(text, length)
    strings = size - length + 1
    where = tb.ragged(np.arange(len(text)), start, strings)
    own = classes[where]
    lowest = np.full(int(classes.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(lowest, own, np.repeat(doc, strings))
    answer = lowest[own]
    from_ = tb.offsets(strings)[:-1]
    packed = []
    bounds = tb.offsets(np.array([len(h[0]) for h in heads], np.int64))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        mine = place[a:b]
        flat = tb.ragged(answer, from_[mine], strings[mine])
        packed.append(bl.numbers_out(flat))
    return bl.answers(table.column("part")[0].as_py(), table.column("block").to_pylist(), packed)


def _least(answers: pa.Scalar) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(bl.numbers_in(a.as_py()) for a in (answers.values if answers.is_valid else ()))])


def removed(chunk: tb.Chunk, contexts: _Contexts, least: np.ndarray, length: int) -> np.ndarray:
    """For each byte of the chunk, whether it goes."""
    strings = tb.offsets(contexts.counts)[:-1]
    count = contexts.count
    earlier = tb.ragged(least, strings[contexts.place], count) < np.repeat(contexts.ids, count)
    start = tb.ragged(np.arange(len(chunk.data)), contexts.first, count)[earlier]
    cover = np.zeros(len(chunk.data) + 1, np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + length, -1)
    return np.cumsum(cover)[:-1] > 0


@bl.one_at_a_time(bl.read)
def _report(_: int, chunk: tb.Chunk, further: list, length: int) -> pa.RecordBatch:
    answers, least = further
    gone = removed(chunk, _Contexts(chunk, answers, length), _least(least), length)
    kept = ~gone
    edge = gone & ~np.concatenate(([False], gone[:-1]))
    starts, ends = chunk.starts.tolist(), chunk.ends.tolist()
    digest = [hashlib.sha256(chunk.data[a:b][kept[a:b]].tobytes()).hexdigest() for a, b in zip(starts, ends, strict=True)]
    count = [[int(x[a:b].sum()) for a, b in zip(starts, ends, strict=True)] for x in (gone, edge)]
    return pa.RecordBatch.from_arrays([chunk.id_array(), pa.array(chunk.ends - chunk.starts, pa.int64()), pa.array(count[0], pa.int64()), pa.array(count[1], pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


@bl.one_at_a_time(bl.read)
def _clean(_: int, chunk: tb.Chunk, further: list, length: int) -> pa.RecordBatch:
    answers, least = further
    kept = ~removed(chunk, _Contexts(chunk, answers, length), _least(least), length)
    texts = [None if null else chunk.data[a:b][kept[a:b]].tobytes() for a, b, null in zip(chunk.starts.tolist(), chunk.ends.tolist(), chunk.null.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([chunk.id_array(), pa.array(texts, pa.binary())], names=["doc_id", "kept"])


def _answered(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    blocks = bl.pack_blocks(docs, id_col, text_col)
    parts = max(12, blocks.count())
    sent = blocks.mapInArrow(functools.partial(_send_minimizers, length=length, parts=parts), bl.SENT_SCHEMA)
    repeated = materialise(bl.beside(blocks, sent.groupBy("part").applyInArrow(_answer_minimizers, bl.ANSWER_SCHEMA)), "repeated")
    release(blocks)
    sent = repeated.mapInArrow(functools.partial(_send_contexts, length=length, parts=parts), bl.SENT_SCHEMA)
    classes = sent.groupBy("part").applyInArrow(bl.lean(lambda table: _answer_contexts(table, length)), bl.ANSWER_SCHEMA)
    return bl.beside(repeated.withColumnRenamed("answers", "repeats"), classes)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes; a null text counts as empty. Each byte goes that lies in a ``length``-byte string that also
    starts in a document with a smaller id; strings are judged on the input. Rows of one id are one document, so
    they remove nothing of each other; rows without id keep all and remove nothing. An empty
    table gives an empty result. Other columns are ignored.
    """
    answered = _answered(docs, id_col, text_col, length)
    return answered.mapInArrow(functools.partial(_report, length=length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id and kept, one row for each row of ``docs``: the remaining bytes of each text, which may cut a character (null for a null text).

    Null ids, repeated rows and empty tables as in :func:`substring_dedup`.
    """
    return _answered(docs, id_col, text_col, length).mapInArrow(functools.partial(_clean, length=length), "doc_id long, kept binary")
