"""SentencePiece encoding with byte offsets, and decoding.

Encoding normalises a text by the longest prefixes that the model's compiled
character map knows and keeps for each normalised byte the place in the source that it
comes from; the normalised text is segmented, and the pieces are projected to byte spans of
the original text. The segmentation alone is the library's: of a copy of the model whose own normalisation is switched off.

Where no piece of the model holds the mark of a space behind another character (or a line feed), merges on either side
of such a place never meet, so the units between them are segmented once and kept.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm import textbytes as tb
from lacuna.llm.scratch import small_batches

CHUNK_BYTES = 1 << 18  # at a time: the source of each byte takes eight
META = "▁".encode()  # what a space becomes
#: Fields of a normalizer specification that leaves texts as they are: its name, and no prefix, no removal of spaces, no marks for them.
IDENTITY = b"\x0a\x08identity\x18\x00\x20\x00\x28\x00"


def _fields(data: bytes):
    """Field numbers and values of a protocol buffer message, by its public wire format; numbers are given as their bytes."""
    for number, start, end in _places(data):
        yield number, data[start:end]


def without_normalisation(model: bytes) -> bytes:
    """The model with its normalizer specification (field 3) replaced."""
    out, at = bytearray(), 0
    for number, start, end in _places(model):
        if number != 3:
            out += model[at:end]
        at = end
    return bytes(out) + b"\x1a" + bytes([len(IDENTITY)]) + IDENTITY


def _places(data: bytes):
    """Field numbers with where their values start and end; a field starts where the one before it ends."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        key = varint()
        size = varint() if key & 7 == 2 else {0: 0, 1: 8, 5: 4}[key & 7]
        start = at
        if key & 7 == 0:
            varint()
        at += size
        yield key >> 3, start, at


@dataclass
class Normal:
    """Normalised texts, one after the other, and the source of each byte: the entries of a text, one for its end, are one more than its bytes."""

    data: np.ndarray  # uint8, PAD zeros behind
    at: np.ndarray  # len + 1 offsets
    source: np.ndarray  # int64


class CharacterMap:
    """The compiled map of a model: a double-array trie from byte strings to places in a pool of replacements."""

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little") if compiled else 0
        self.units = np.frombuffer(compiled[4 : 4 + size], "<u4").tolist()
        self.pool = compiled[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known string at ``at``, and its replacement."""
        if not self.units:
            return None
        found = None
        node = self._child(0)
        for k in range(at, len(text)):
            node ^= text[k]
            unit = self.units[node]
            if unit & 0x800000FF != text[k]:
                break
            node ^= self._child_of(unit)
            if unit >> 8 & 1:
                value = self.units[node] & 0x7FFFFFFF
                found = k + 1 - at, self.pool[value : self.pool.index(0, value)]
        return found

    def _child(self, node: int) -> int:
        return node ^ self._child_of(self.units[node])

    @staticmethod
    def _child_of(unit: int) -> int:
        return unit >> 10 << ((unit & 0x200) >> 6)


class PieceCodec:
    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            model = f.read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.core = sentencepiece.SentencePieceProcessor(model_proto=without_normalisation(model))
        norm = dict(_fields(next((v for k, v in _fields(model) if k == 3), b"")))
        self.map = CharacterMap(norm.get(2, b""))
        self.dummy, self.strip, self.escape = (norm.get(k, b"\1") != b"\0" for k in (3, 4, 5))
        n = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(k) for k in range(n)]
        self.is_byte = np.array([self.library.is_byte(k) for k in range(n)])
        shown = [bytes([int(p[3:5], 16)]) if b else b"" if self.library.is_control(k) else p.encode() for k, (p, b) in enumerate(zip(pieces, self.is_byte.tolist(), strict=True))]
        surface = [s if b else s.replace(META, b" ") for s, b in zip(shown, self.is_byte.tolist(), strict=True)]
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_size = np.array([len(s) for s in surface], np.int64)
        self.surface_start = np.cumsum(self.surface_size) - self.surface_size
        said = [f"{k},".encode() for k in range(n)]
        self.digits = np.frombuffer(b"".join(said), np.uint8)
        self.digits_size = np.array([len(s) for s in said], np.int64)
        self.digits_start = np.cumsum(self.digits_size) - self.digits_size
        self.by_word = all("▁" not in p.lstrip("▁") for p in pieces)
        self.by_line = all("\n" not in p for p in pieces)
        self.cache = tb.SpanCache(self._segment)

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text, and for each of its bytes, and its end, the byte of ``text`` that it comes from."""
        out, source = bytearray(), []

        def put(piece: bytes, at: int) -> None:
            out.extend(piece)
            source.extend([at] * len(piece))

        space = META if self.escape else b" "
        at = 0
        while at < len(text):
            found = self.map.longest(text, at)
            if found:
                size, piece = found
            else:
                size = next((k for k in range(1, 5) if at + k >= len(text) or text[at + k] & 0xC0 != 0x80), 1)
                piece = text[at : at + size]
            for k in range(len(piece)):
                if piece[k : k + 1] != b" ":
                    put(piece[k : k + 1], at)
                elif not (self.strip and (not out or out.endswith(space))):
                    put(space, at)
            at += size
        while self.strip and out.endswith(space):
            del out[-len(space) :]
            del source[-len(space) :]
        if self.dummy and out:
            out[:0] = space
            source[:0] = [source[0] if source else 0] * len(space)
        return bytes(out), np.array([*source, len(text)], np.int64)

    def normal(self, chunk: tb.Chunk) -> Normal:
        if self.map.units or self.strip or not self.escape:
            found = [self.normalise(chunk.text(k)) for k in range(len(chunk))]
            data = np.frombuffer(b"".join([t for t, _ in found]) + bytes(tb.PAD), np.uint8)
            return Normal(data, tb.offsets(np.array([len(t) for t, _ in found], np.int64)), np.concatenate([np.zeros(0, np.int64), *(p for _, p in found)]))
        lens = chunk.ends - chunk.starts  # each byte maps to itself, a space to the three of the mark, for all texts at once
        own = tb.ragged(np.arange(len(chunk.data)), chunk.starts, lens)
        text = np.repeat(np.arange(len(chunk)), lens)
        times = np.where(chunk.data[own] == 0x20, 3, 1)
        head = np.where((lens > 0) & self.dummy, len(META), 0)
        size = tb.sums(times, tb.offsets(lens)) + head
        at = tb.offsets(size)
        start = at[:-1][text] + head[text] + (np.cumsum(times) - times) - tb.offsets(tb.sums(times, tb.offsets(lens)))[text]
        data, source = np.zeros(int(at[-1]) + tb.PAD, np.uint8), np.zeros(int(at[-1]) + len(chunk), np.int64)
        data[start] = chunk.data[own]
        spaces = start[times == 3]
        heads = at[:-1][head > 0]
        for k, byte in enumerate(META):
            data[spaces + k] = data[heads + k] = byte
        place = own - chunk.starts[text]
        for k in range(3):
            some = times > k
            source[(start + text)[some] + k] = place[some]
        source[at[1:] + np.arange(len(chunk))] = lens
        return Normal(data, at, source)

    def _segment(self, spans: list[bytes]) -> list[list[int]]:
        """Ids of stretches of normalised text, and how many of its bytes each piece covers, by turns."""
        texts = [span.decode("utf-8", "replace") for span in spans]
        ids = self.core.encode(texts, num_threads=1)
        shown = self.core.encode(texts, out_type=str, num_threads=1)
        return [[x for i, p in zip(own, pieces, strict=True) for x in (i, 1 if self.is_byte[i] else len(p.encode()))] for own, pieces in zip(ids, shown, strict=True)]

    def encode(self, chunk: tb.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, concatenated, the number of each text's, and each piece's start and end in the bytes of its text.

        Pieces of the prefix alone are empty; pieces within what a character became share its place.
        """
        normal = self.normal(chunk)
        data, n = normal.data, int(normal.at[-1])
        first = np.zeros(n + 1, bool)
        if self.by_word:
            mark = np.zeros(n + 1, bool)
            mark[: max(0, n - 2)] = (data[: max(0, n - 2)] == META[0]) & (data[1 : max(1, n - 1)] == META[1]) & (data[2 : max(2, n)] == META[2])
            first |= mark
            first[3:] &= ~mark[:-3]
        if self.by_line:
            feed = data[:n] == 0x0A
            first[:-1] |= feed
            first[1:] |= feed
        first[normal.at] = True
        first[-1] = False
        starts = np.flatnonzero(first)
        found, size = self.cache(data, starts, np.diff(np.append(starts, n)))
        ids, covered = found[0::2], found[1::2]
        counts = tb.sums(size // 2, np.searchsorted(starts, normal.at))
        ends = np.cumsum(covered.astype(np.int64))
        text = np.repeat(np.arange(len(chunk)), counts)
        return ids, counts, np.stack((normal.source[ends - covered + text], normal.source[ends + text]), axis=1)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The texts' bytes as the library's decode gives them."""
        size = self.surface_size[ids]
        flat = tb.ragged(self.surface, self.surface_start[ids], size).tobytes()
        at = tb.offsets(tb.sums(size, tb.offsets(counts))).tolist()
        out = []
        for a, b in zip(at[:-1], at[1:], strict=True):
            piece = flat[a:b]
            if self.dummy and piece[:1] == b" ":
                piece = piece[1:]
            out.append(piece)
        return out

    def digests(self, chunk: tb.Chunk):
        """For each text: number of ids, SHA-256 of the joined ids and of the decoded text, CRC-32 of the spans."""
        ids, counts, spans = self.encode(chunk)
        size = self.digits_size[ids]
        flat = tb.ragged(self.digits, self.digits_start[ids], size).tobytes()
        at = tb.offsets(counts)
        said = tb.offsets(tb.sums(size, at)).tolist()
        decoded = self.decode(ids, counts)
        for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            ids_sha = hashlib.sha256(flat[said[k] : max(said[k], said[k + 1] - 1)]).hexdigest()
            text = decoded[k]
            if not _valid(text):
                text = self.library.decode(ids[a:b].tolist()).encode()
            yield b - a, ids_sha, hashlib.sha256(text).hexdigest(), zlib.crc32(spans[a:b].astype("<i8"))


def _valid(text: bytes) -> bool:
    try:
        text.decode()
    except UnicodeDecodeError:
        return False
    return True


@functools.lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def _digest(batches, path: str):
    own = codec(path)
    for chunk in tb.chunks(batches, CHUNK_BYTES):
        columns = list(zip(*own.digests(chunk), strict=True))
        yield pa.RecordBatch.from_arrays([chunk.id_array(), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"])


def _pieces(batches, path: str):
    own = codec(path)
    for chunk in tb.chunks(batches, CHUNK_BYTES):
        ids, counts, flat = own.encode(chunk)
        at = tb.offsets(counts)
        lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v)) for v in (ids.astype(np.int32), np.ascontiguousarray(flat[:, 0]), np.ascontiguousarray(flat[:, 1]))]
        yield pa.RecordBatch.from_arrays([chunk.id_array(), *lists], names=["doc_id", "ids", "span_starts", "span_ends"])


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, span_starts, span_ends: the pieces of each text and their spans in the text's UTF-8 bytes.

    One row for each row of ``docs``; a null text has no pieces, an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return texts.mapInArrow(functools.partial(_pieces, path=model_path), "doc_id long, ids array<int>, span_starts array<long>, span_ends array<long>")


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256, spans_crc32.

    A null text counts as empty and has no pieces; null ids and repeated rows are answered row
    by row; an empty table gives an empty result. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return texts.mapInArrow(functools.partial(_digest, path=model_path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long")
