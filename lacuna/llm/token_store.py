"""Token ids in binary files with Elias-Fano encoded document boundaries.

A file holds the ids of consecutive documents as one array of little-endian
unsigned integers (16 bits where the vocabulary allows, else 32) and the documents'
start offsets as an Elias-Fano sequence: the low bits packed, the high bits in
unary, and the position of every ``SAMPLE``-th one, so that the start of any
document is found by one select without a table of 64-bit offsets.

Layout, all integers little-endian: 8 bytes magic; 8 unsigned 64-bit numbers
(documents, of which without id, ids, bytes an id, low bits, bytes of low bits, bytes of
high bits, samples); low bits; high bits; samples (64 bits each); document ids (64 bits
each, ascending, those without id first); token ids.
"""

from __future__ import annotations

import functools
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm import textbytes as tb
from lacuna.llm.scratch import filesystem, made_folder, materialise

MAGIC = b"LACTOK01"
SAMPLE = 256
END_ID = 1
FILE_BYTES = 16 << 20  # of text, about, that a file's documents hold
FILE_IDS = 1 << 24  # ids after which a file ends, but for one longer document
LEAST_ERROR = 1e-5  # of the quantiles where files are cut, so what the driver holds for them is bounded


class EliasFano:
    """A non-decreasing sequence of non-negative integers, in about 2 + log2(largest / length) bits each."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        most = int(values[-1]) if n else 0
        low_bits = max(0, (most // n).bit_length() - 1) if n else 0
        low = np.packbits(((values[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8).reshape(-1), bitorder="little").tobytes()
        ones = (values >> low_bits) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little").tobytes(), ones[::SAMPLE].astype(np.uint64))

    def select(self, k: int) -> int:
        """Value k, by the sampled position before it and a scan of at most SAMPLE ones."""
        if not 0 <= k < self.n:
            raise IndexError(k)
        at, left = int(self.samples[k // SAMPLE]), k % SAMPLE
        byte = at // 8
        bits = self.high[byte] >> (at % 8) << (at % 8)
        while (ones := bits.bit_count()) <= left:
            left -= ones
            byte += 1
            bits = self.high[byte]
        for _ in range(left):
            bits &= bits - 1
        one = 8 * byte + (bits & -bits).bit_length() - 1
        start, low = k * self.low_bits, 0
        if self.low_bits:
            piece = int.from_bytes(self.low[start // 8 : (start + self.low_bits + 7) // 8], "little")
            low = (piece >> (start % 8)) & ((1 << self.low_bits) - 1)
        return ((one - k) << self.low_bits) | low

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        low = np.unpackbits(np.frombuffer(self.low, np.uint8), count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits)
        return ((ones - np.arange(self.n)) << self.low_bits) + low.astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))


def pack_file(doc_ids: np.ndarray, n_null: int, lens: np.ndarray, ids: bytes, width: int) -> bytes:
    starts = EliasFano.encode(tb.offsets(lens)[:-1])
    head = struct.pack("<8Q", len(lens), n_null, len(ids) // width, width, starts.low_bits, len(starts.low), len(starts.high), len(starts.samples))
    return b"".join((MAGIC, head, starts.low, starts.high, starts.samples.astype("<u8").tobytes(), doc_ids.astype("<i8").tobytes(), ids))


class TokenFile:
    """Reads the content of a file; token arrays are views on it."""

    def __init__(self, content: bytes):
        if content[:8] != MAGIC:
            raise ValueError("not a token file")
        n, self.n_null, n_ids, width, low_bits, low, high, samples = struct.unpack_from("<8Q", content, 8)
        at = 72
        parts = []
        for size in (low, high, 8 * samples, 8 * n, width * n_ids):
            parts.append(content[at : at + size])
            at += size
        if at != len(content):
            raise ValueError("a token file of another length than its header says")
        self.starts = EliasFano(n, low_bits, parts[0], parts[1], np.frombuffer(parts[2], "<u8"))
        self.doc_ids = np.frombuffer(parts[3], "<i8")
        self.ids = np.frombuffer(parts[4], f"<u{width}")

    def __len__(self) -> int:
        return self.starts.n

    def tokens(self, k: int) -> np.ndarray:
        return self.ids[self.starts.select(k) : self.starts.select(k + 1) if k + 1 < len(self) else len(self.ids)]


# --- encoding -----------------------------------------------------------------------------------------------------------

_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASS[0x61:0x7B] = _CLASS[0x41:0x5B] = _CLASS[0x80:] = _LETTER
_CLASS[0x30:0x3A] = _DIGIT


class WordEncoder:
    """Ids of whole texts, from the library's ids of their units.

    The tokenizer drops white space and splits texts into runs of letters, single digits and runs of
    other characters, so no token spans two units. A text with characters for which bytes don't
    tell that (an apostrophe, ``<|``, or anything but ASCII and the letters of U+00C0 to
    U+00FF) has the runs between ASCII white space as units, as they stand; other units are encoded in lower case.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.cache = tb.SpanCache(self._encode)

    def _encode(self, spans: list[bytes]) -> list[list[int]]:
        out = [None] * len(spans)
        rest = []
        for k, span in enumerate(spans):
            if span.isalpha() and span.islower():  # ASCII letters only: one word, which goes to the merges as it is
                out[k] = [t.id for t in self.model.tokenize(span.decode())]
            else:
                rest.append(k)
        got = self.tokenizer.encode_batch_fast([spans[k].decode("utf-8", "replace") for k in rest], add_special_tokens=False)
        for k, e in zip(rest, got, strict=True):
            out[k] = e.ids
        return out

    def __call__(self, chunk: tb.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, concatenated, and the number of each text's."""
        data = chunk.data
        before = np.concatenate(([0], data[:-1]))
        strange = (data == 0x27) | (data == 0x7C) & (before == 0x3C) | (data >= 0x80) & (data != 0xC3) & (before != 0xC3)
        strange |= (before == 0xC3) & ((data == 0x97) | (data == 0xB7))
        odd = np.unique(np.searchsorted(chunk.starts, np.flatnonzero(strange), "right") - 1)
        kind = _CLASS[data]
        low = tb.LOWER[data]
        for k in odd.tolist():
            own = slice(chunk.starts[k], chunk.ends[k])
            kind[own] = np.where(kind[own] == _SPACE, _SPACE, _LETTER)
            low[own] = data[own]
        first = np.concatenate(([True], kind[1:] != kind[:-1])) | (kind == _DIGIT)
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(data))
        solid = kind[starts] != _SPACE
        starts, ends = starts[solid], ends[solid]
        ids, size = self.cache(low, starts, ends - starts)
        return ids, tb.sums(size, tb.per_text(chunk, starts))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _tokenize(batches, path: str, bounds, end_id: int, width: int):
    encode = encoder(path)
    for chunk in tb.chunks(batches):
        ids, counts = encode(chunk)
        at = tb.offsets(counts + 1)
        out = np.full(int(at[-1]), end_id, f"<u{width}")
        body = np.ones(len(out), bool)
        body[at[1:] - 1] = False
        out[body] = ids
        column = pa.Array.from_buffers(pa.binary(), len(chunk), [None, pa.py_buffer((at * width).astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])
        bucket = np.where(chunk.id_null, -1, np.searchsorted(bounds.value, chunk.ids, "right"))
        yield pa.RecordBatch.from_arrays([chunk.id_array(), pa.array(bucket, pa.int64()), column], names=["doc_id", "bucket", "ids"])


# --- files --------------------------------------------------------------------------------------------------------------


def _write(batches, folder: str, width: int):
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    held: list = []
    state = {"bucket": None, "seq": 0, "ids": 0}

    def flush():
        doc_ids = np.concatenate([h[0] for h in held])
        lens = np.concatenate([h[2] for h in held])
        content = pack_file(doc_ids, int(sum(h[1] for h in held)), lens, b"".join(h[3] for h in held), width)
        name = f"part-{state['bucket'] + 1:09d}-{state['seq']:05d}.tok"
        import uuid

        with fs.open_output_stream(part := f"{path}/.{name}.{uuid.uuid4().hex}") as out:
            out.write(content)
        fs.move(part, f"{path}/{name}")  # a task that is run again writes the same file
        row = pa.RecordBatch.from_pydict({"file": [name], "n_docs": [len(lens)], "n_ids": [int(lens.sum())]})
        held.clear()
        state["seq"] += 1
        state["ids"] = 0
        return row

    for batch in batches:
        buckets = np.asarray(batch.column(1))
        edges = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            if held and (state["bucket"] != buckets[a] or state["ids"] >= FILE_IDS):
                yield flush()
            if state["bucket"] != buckets[a]:
                state |= {"bucket": int(buckets[a]), "seq": 0}
            data, at, _ = tb._binary(batch.column(2).slice(a, b - a))
            ids = batch.column(0).slice(a, b - a)
            held.append((np.asarray(ids.fill_null(0)).astype(np.int64), ids.null_count, np.diff(at) // width, data[at[0] : at[-1]].tobytes()))
            state["ids"] += int(at[-1] - at[0]) // width
    if held:
        yield flush()


def id_width(tokenizer_path: str, end_id: int = END_ID) -> int:
    """Bytes of an id."""
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(tokenizer_path).get_vocab(with_added_tokens=True)
    return 2 if max(end_id, *vocabulary.values()) < 1 << 16 else 4


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode the texts and write files to ``folder`` in ascending order of ids; returns file, n_docs, n_ids, base.

    ``base`` is the number of ids in all files before. The ids' range is cut at
    quantiles, so that a file's documents hold about ``FILE_BYTES`` of text. A null text is the end id alone; rows without id come first,
    rows of the same id in the order of their token ids; an empty table gives no file. The ids have 16 bits if the vocabulary
    and ``end_id`` allow it, else 32.
    """
    spark = docs.sparkSession
    width = id_width(tokenizer_path, end_id)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-total // FILE_BYTES))
    bounds = sorted(set(rows.stat.approxQuantile("doc_id", [k / parts for k in range(1, parts)], max(0.1 / parts, LEAST_ERROR)))) if parts > 1 else []
    shared = spark.sparkContext.broadcast(np.array(bounds, np.int64))  # 8 bytes for FILE_BYTES of text
    texts = rows.select("doc_id", F.col("text").cast("binary").alias("text"))
    coded = texts.mapInArrow(functools.partial(_tokenize, path=tokenizer_path, bounds=shared, end_id=end_id, width=width), "doc_id long, bucket long, ids binary")
    dealt = coded.repartition(max(parts, spark.sparkContext.defaultParallelism), "bucket").sortWithinPartitions("bucket", F.asc_nulls_first("doc_id"), "ids")
    files = materialise(dealt.mapInArrow(functools.partial(_write, folder=folder, width=width), "file string, n_docs long, n_ids long"), "token-files")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row a file, not a document
    return files.select("*", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))


def _read(batches):
    for batch in batches:
        for content, base in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            tokens = TokenFile(content.as_buffer().to_pybytes())
            starts = np.append(tokens.starts.all(), len(tokens.ids))
            wide = tokens.ids.astype("<u4")
            crc = [zlib.crc32(wide[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            null = np.arange(len(tokens)) < tokens.n_null
            yield pa.RecordBatch.from_arrays([pa.array(tokens.doc_ids, pa.int64(), mask=null), pa.array(starts[:-1] + base, pa.int64()), pa.array(np.diff(starts), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents of the files that :func:`write_token_files` returned; a null id is read as null, no file gives no row."""
    spark = files.sparkSession
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder)
    content = content.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return files.join(content, "file").select("content", "base").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_store(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the token files to the scratch folder and returns what they hold: one row for each row of ``docs``.

    A null or empty text is the end id alone. Rows without id come first; rows of
    the same id are in the order of their token ids. An empty table gives an empty result.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    folder = made_folder(spark, "tokens")
    files = write_token_files(docs, folder, tokenizer_path, end_id, id_col, text_col)
    return read_token_files(files, folder)
