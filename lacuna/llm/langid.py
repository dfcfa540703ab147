"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of labelled text accepts
exactly the sample's substrings. A text is parsed greedily into the longest
phrases that occur in the sample; phrases times log2 of the sample's length is the
code length of the text given the language, and the shortest code wins. The
automaton is completed to a table of next states and phrase ends, so texts are
parsed in step, many at once, by array gathers.

Long texts are cut into blocks that are parsed at once, as if a phrase started with each. Then, block by block, the parse
goes on from where the block before truly ended until it meets the other, which is after some symbols; so phrases are those of the whole text.
"""

from __future__ import annotations

import functools
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm import textbytes as tb
from lacuna.llm.scratch import small_batches

BLOCK = 1024  # symbols
SAMPLE_DOCS = 400  # labelled rows a language, about
SAMPLE_PIECE = 600  # code points taken from each, at a random place
SAMPLE_SYMBOLS = 24_000  # a language
UNKNOWN = "und"


class Symbols:
    """Code points to classes: 0 for what is no letter, then the letters of the samples in lower case, last the other letters."""

    def __init__(self, samples: list[str]):
        seen = sorted({c for s in samples for c in s.lower() if c.isalpha() and len(c) == 1})
        self.size = len(seen) + 2
        of = {c: k + 1 for k, c in enumerate(seen)}
        other = self.size - 1
        self.table = np.zeros(sys.maxunicode + 1, np.uint16)
        for k in range(sys.maxunicode + 1):
            c = chr(k)
            if c.isalpha():
                self.table[k] = of.get(c.lower(), other)

    def __call__(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes of the code points with runs of 0 collapsed; for each byte, the number of classes and of letters before it."""
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        classes = self.table[points]
        keep = classes > 0
        letters = np.concatenate(([0], np.cumsum(keep)))
        keep[1:] |= keep[:-1]
        kept = np.concatenate(([0], np.cumsum(keep)))
        point = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        return classes[keep], kept[point], letters[point]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the minimal automaton of all substrings; state 0 is the start."""
    step, link, size, last = [{}], [-1], [0], 0
    for c in symbols:
        step.append({})
        size.append(size[last] + 1)
        link.append(0)
        new, p = len(step) - 1, last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                step.append(dict(step[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                copy = len(step) - 1
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


def parser_table(symbols: list[int], width: int, base: int) -> np.ndarray:
    """For state * width + symbol: 4 * (next state + base) * width + phrases ended. An unseen symbol is a phrase of its own."""
    step = suffix_automaton(symbols)
    root = np.zeros(width, np.int64)
    known = np.zeros(width, bool)
    for c, s in step[0].items():
        root[c], known[c] = s, True
    fresh = 4 * (root + base) * width + np.where(known, 1, 2)
    out = np.tile(fresh, (len(step), 1))
    out[0] = 4 * (root + base) * width + np.where(known, 0, 1)
    at = np.repeat(np.arange(len(step)), [len(s) for s in step])
    out[at, [c for s in step for c in s]] = 4 * (np.array([t for s in step for t in s.values()], np.int64) + base) * width
    return out.reshape(-1)


class Model:
    """Parsers of all languages in one table; ``langs`` in ascending order."""

    def __init__(self, samples: dict[str, list[str]], most: int = SAMPLE_SYMBOLS):
        self.langs = sorted(samples)
        self.symbols = Symbols([s for texts in samples.values() for s in texts])
        tables, self.samples, self.roots, self.bits, base = [], [], [], [], 0
        width = self.symbols.size
        for lang in self.langs:
            chunk = tb.of_texts([s.encode() for s in samples[lang]])
            sample = self.symbols(chunk.data)[0][:most]
            self.samples.append(sample)
            table = parser_table(sample.tolist(), width, base)
            tables.append(table)
            self.roots.append(base * width)
            self.bits.append(np.log2(max(2, len(sample))))
            base += len(table) // width
        joined = np.concatenate(tables) if tables else np.zeros(0, np.int64)
        self.table = joined.astype(np.int32 if 4 * len(joined) < 2**31 else np.int64)
        self.roots = np.array(self.roots, self.table.dtype)

    def phrases(self, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Phrases of each text (rows) for each language (columns)."""
        lens = np.diff(bounds)
        blocks = -(-lens // BLOCK)
        owner = np.repeat(np.arange(len(lens)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = bounds[owner] + nth * BLOCK
        size = np.minimum(BLOCK, bounds[owner + 1] - start)
        symbols = symbols.astype(self.table.dtype)
        count, state = self._from_roots(symbols, start, size)
        by_nth = np.argsort(nth, kind="stable")
        first = np.searchsorted(nth[by_nth], np.arange(int(blocks.max()) + 1 if len(blocks) else 0))
        for a, b in zip(first[1:].tolist(), [*first[2:].tolist(), len(by_nth)], strict=False):
            self._go_on(symbols, start, size, by_nth[a:b], count, state)
        out = np.zeros((len(lens), len(self.langs)), np.int64)
        np.add.at(out, owner, count)
        some = np.flatnonzero(blocks)
        out[some] += state[np.cumsum(blocks)[some] - 1] != self.roots
        return out

    def _from_roots(self, symbols: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that end in each block if one starts with it, and the states behind it."""
        order = np.argsort(-size, kind="stable")
        at, long = start[order], size[order]
        state = np.tile(self.roots, (len(order), 1))
        count = np.zeros_like(state)
        active = np.searchsorted(-long, -np.arange(1, int(long[0]) + 1 if len(long) else 1), "right")
        for i, k in enumerate(active.tolist()):
            got = self.table[state[:k] + symbols[at[:k] + i, None]]
            count[:k] += got & 3
            state[:k] = got >> 2
        counts, states = np.empty_like(count), np.empty_like(state)
        counts[order], states[order] = count, state
        return counts, states

    def _go_on(self, symbols: np.ndarray, start: np.ndarray, size: np.ndarray, own: np.ndarray, count: np.ndarray, state: np.ndarray) -> None:
        """Put right the blocks ``own``, whose texts' blocks before are right: from the state behind that block and from the root, until both parses meet; from there on they are one."""
        true, guess = state[own - 1], np.tile(self.roots, (len(own), 1))
        left, i = np.arange(len(own)), 0
        while len(left):
            apart = (true[left] != guess[left]).any(axis=1) & (size[own[left]] > i)
            left = left[apart]
            read = symbols[start[own[left]] + i, None]
            a, b = self.table[true[left] + read], self.table[guess[left] + read]
            count[own[left]] += (a & 3) - (b & 3)
            true[left], guess[left] = a >> 2, b >> 2
            i += 1
        state[own] = np.where(true == guess, state[own], true)

    def predict(self, chunk: tb.Chunk) -> tuple[list[str], np.ndarray]:
        symbols, kept, letters = self.symbols(chunk.data)
        bounds = np.append(kept[chunk.starts], len(symbols))
        some = letters[chunk.ends] > letters[chunk.starts]
        if not self.langs:
            return [UNKNOWN] * len(chunk), np.zeros(len(chunk))
        cost = self.phrases(symbols, bounds) * np.array(self.bits)
        best = np.argmin(cost, axis=1)
        ranked = np.sort(cost, axis=1)
        score = 1 - ranked[:, 0] / np.maximum(ranked[:, 1], 1e-9) if len(self.langs) > 1 else np.ones(len(chunk))
        return [self.langs[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist(), strict=True)], np.where(some, score, 0.0)


def learnable(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 4


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_symbols: int = SAMPLE_SYMBOLS) -> Model:
    """A model of labelled rows whose crc32(id as text) mod 4 is not 2 (rows without id have none).

    Bounded sample, at every size of input: of each label about ``sample_docs`` rows, chosen by a hash of the id, and of each a
    piece of ``SAMPLE_PIECE`` code points at a place chosen by the same hash; equal
    pieces count once. Every label is learned: the model has a table for each of them, of ``sample_symbols`` symbols.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (learnable(id_col) != 2)).select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"), F.col(text_col).alias("t"))
    counts = {r["l"]: r["c"] for r in rows.groupBy("l").agg(F.count("*").alias("c")).collect()}  # a row a language
    if not counts:
        return Model({})
    share = F.create_map(*[F.lit(x) for lang, c in counts.items() for x in (lang, min(1.0, sample_docs / c))])
    dice = F.pmod(F.xxhash64("i", F.lit(11)), F.lit(1 << 30))
    picked = rows.filter(dice < F.try_element_at(share, F.col("l")) * float(1 << 30))
    place = (F.pmod(F.xxhash64("i", F.lit(12)), F.greatest(F.length("t") - SAMPLE_PIECE, F.lit(1))) + 1).cast("int")
    pieces = picked.select("l", F.xxhash64("i", F.lit(13)).alias("o"), F.substring(F.col("t"), place, F.lit(SAMPLE_PIECE)).alias("p")).limit(2 * sample_docs * len(counts))
    samples: dict[str, list[str]] = {}
    for r in sorted(pieces.collect(), key=lambda r: (r["o"], r["p"])):
        if r["p"] not in (got := samples.setdefault(r["l"], [])):
            got.append(r["p"])
    return Model({lang: samples.get(lang, []) for lang in counts if samples.get(lang)}, sample_symbols)


def _predict(batches, model):
    for chunk in tb.chunks(batches, 4 * tb.CHUNK_BYTES):
        langs, score = model.value.predict(chunk)
        yield pa.RecordBatch.from_arrays([chunk.id_array(), pa.array(langs, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, lang_pred, score.

    ``lang_pred`` is a learned label, or ``und`` (score 0) if the text is null, has no
    letter, or nothing could be learned. ``score`` is 1 minus the ratio of the best code
    length to the second best; ties go to the first label in order. held_out
    (crc32(id as text) mod 4 = 2) is false for null ids, which are never learned from.
    Repeated rows are answered alike; an empty table gives an empty result.
    Only the text decides a prediction.
    """
    model = model or fit(docs, id_col, text_col, lang_col)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SAMPLE_SYMBOLS for each language
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    out = texts.mapInArrow(functools.partial(_predict, model=shared), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(learnable("doc_id") == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def _identified(chunk: tb.Chunk, model) -> np.ndarray:
    if not model.value.langs:
        letters = model.value.symbols(chunk.data)[2]
        return letters[chunk.ends] > letters[chunk.starts]
    return np.array([lang != UNKNOWN for lang in model.value.predict(chunk)[0]], bool)


def drop_unidentified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None) -> DataFrame:
    """``docs`` without the rows that :func:`identify` answers with ``und``; all columns as they are.

    Where no language could be learned, only those without a letter go. Rows without id and repeated rows stay or go by their texts; an empty table stays empty.
    """
    model = model or fit(docs, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return tb.filter_rows(docs, text_col, functools.partial(_identified, model=shared))
