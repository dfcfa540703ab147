"""Scoring by a probabilistic suffix tree over words, beside an add-one unigram base.

The symbols are the tokens themselves: the words in lower case and an end after each text; a start stands before
it, so contexts never leave their text. The root of the tree is the base's distribution. Contexts of
``lengths()`` symbols (1, 2, 3, 4, 8, 16, ... without an end) are tested, shorter ones first. A context that n training symbols
follow is retained if what follows it repeatedly diverges from the distribution of its longest retained proper
suffix, q: the sum over symbols x that follow it c >= 2 times of c ln((c - 1 + STRENGTH q(x)) / ((n - 1 + STRENGTH) q(x))), and of
ln(STRENGTH / (n - 1 + STRENGTH)) for each symbol that follows once, is at least ``DIVERGENCE``. This is n times the
Kullback-Leibler divergence, each symbol being judged by the others (left out itself), so that chance repeats don't pass.
A retained context has the smoothed distribution (c' + (n1 + STRENGTH) q) / (n + STRENGTH) with c' = c from 2 on, else 0, and
n1 the number of symbols that follow once: their share is left to the suffix. The longest retained suffix of what was read is
the state that scores the next symbol; log probabilities are kept in steps of 2**-20.

No context that would pass is left out: as c ln((c - 1 + S q) / ((c - 1 + S) q)) grows with c, its sum over the repeated
symbols bounds what any longer context can reach against q, and the search goes on behind a context while that bound is at least
DIVERGENCE. (For a context that was retained just now, q is at least c / (n + S), and the sum of c ln((n + S) / c) is the bound.)
Where one symbol only follows, as within copied passages, the bound is below it, so the search ends there.

The tree is nowhere in one place. Each round (a length) is two exchanges between blocks of documents and ranges of 64-bit
keys. A block sends its distinct n-grams that occurred twice when they were one round shorter, and learns their counts. One
block for each n-gram then adds its term to the context's sums, and all learn from the context's range whether it is retained
and whether to go on. Texts without anything to go on for are done and leave the rounds.
What a block knows stays in a file of the shared folder, its tokens first and then its state; only its path goes through the exchanges.
A round has as many tasks and ranges as its states fill, and its counts stay beside the states, so contexts are sorted once a round.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm import blocks as bl
from lacuna.llm import textbytes as tb
from lacuna.llm.scratch import fetch, made_folder, materialise, parts_of, put, release, remove, small_batches

DIVERGENCE = 6.0  # nats
STRENGTH = 2.0  # weight of the suffix's distribution, in counts
STEPS = 1 << 20  # of log10 probabilities, to one
FINE = 1 << 10  # of the terms of sums, to a nat: whole numbers, so sums don't depend on their order
START, END, RARE = np.uint64(0x5851F42D4C957F2D), np.uint64(0x1F3D5B79A1C3E5F7), np.uint64(0x2545F4914F6CDD1D)  # beside the words' hashes; RARE: of all that occur once at most
ODD = 0x9E3779B97F4A7C15

ROUND_BYTES = 8 << 20  # of states for a task and for a range of keys
ROWS = "kind string, block long, size long, data binary"  # size: of a state


def lengths() -> Iterator[int]:
    """Of the contexts that are tested, in order."""
    yield from (1, 2, 3)
    size = 4
    while True:
        yield size
        size *= 2


def held_out(ids: Column) -> Column:
    return F.coalesce(F.crc32(ids.cast("string")) % 7 == 2, F.lit(False))


def _held_out(chunk: tb.Chunk) -> np.ndarray:
    return np.array([not null and zlib.crc32(str(i).encode()) % 7 == 2 for i, null in zip(chunk.ids.tolist(), chunk.id_null.tolist(), strict=True)], bool)


def _pack(*columns: np.ndarray) -> bytes:
    """Numbers (64 bits) and flags, one after the other."""
    own = [np.array([x.dtype == bool, len(x)], "<u4").tobytes() + (bl.zip_bytes(np.packbits(x).tobytes()) if x.dtype == bool else bl.numbers_out(x)) for x in columns]
    return b"".join(len(x).to_bytes(8, "little") + x for x in own)


def _unpack(packed: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(packed):
        size = int.from_bytes(packed[at : at + 8], "little")
        flags, n = np.frombuffer(packed, "<u4", 2, at + 8).tolist()
        own = packed[at + 16 : at + 8 + size]
        out.append(np.unpackbits(np.frombuffer(bl.unzip_bytes(own, (n + 7) // 8), np.uint8))[:n].astype(bool) if flags else bl.numbers_in(own))
        at += 8 + size
    return out


@functools.lru_cache(1)
def _table(n: int) -> dict[int, np.ndarray]:
    return {x: np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, x, np.uint64)))) for x in (ODD, pow(ODD, -1, 1 << 64))}


def _powers(x: int, n: int) -> np.ndarray:
    """The powers of ODD or of its inverse, to the n-th at least; blocks are about as large, so they are made once a task."""
    return _table(1 << max(20, n.bit_length()))[x]


class Tokens:
    """The tokens of a block's texts, each text's start, words and end, as places among its distinct keys; and keys of the stretches before any of them.

    ``base``: the codes of the distinct keys at the root; ``counts``: the tokens of each text; ``held``: how many of them are still here.
    """

    def __init__(self, ids: np.ndarray, null: np.ndarray, train: np.ndarray, counts: np.ndarray, distinct: np.ndarray, of: np.ndarray, base: np.ndarray | None = None, held: np.ndarray | None = None):
        self.ids, self.null, self.train, self.counts, self.distinct, self.of, self.base = ids, null, train, counts, distinct, of, base
        self.held = counts if held is None else held
        self.bounds = tb.offsets(self.held)
        self.keys = distinct[of]
        self.scored = np.ones(len(of), bool)
        self.scored[self.bounds[:-1]] = False
        self.text = np.repeat(np.arange(len(ids), dtype=np.int32), self.held)

    @classmethod
    def read(cls, chunk: tb.Chunk) -> Tokens:
        low = tb.LOWER[chunk.data]
        starts, ends = tb.words(low, tb.NOT_SPACE)
        counts = np.diff(tb.per_text(chunk, starts)) + 2
        bounds = tb.offsets(counts)
        keys = np.full(int(bounds[-1]), END, np.uint64)
        body = np.ones(len(keys), bool)
        body[bounds[:-1]] = body[bounds[1:] - 1] = False
        keys[body] = tb.hash_spans(low, starts, ends - starts)
        keys[bounds[:-1]] = START
        order, first, of = bl.totals(keys)
        return cls(chunk.ids, chunk.id_null, ~_held_out(chunk), counts, keys[order[first]], of)

    def dump(self) -> bytes:
        """All but what follows from a model."""
        return _pack(self.ids, self.null, self.train, self.counts, self.distinct.view(np.int64), self.of)

    @classmethod
    def load(cls, packed: bytes) -> Tokens:
        ids, null, train, counts, distinct, of = _unpack(packed)
        return cls(ids, null, train, counts, distinct.view(np.uint64), of)

    def some(self, texts: np.ndarray, inside: np.ndarray) -> Tokens:
        """These texts, and of their tokens only those ``inside``."""
        of = self.of[inside]
        used = np.zeros(len(self.distinct), bool)
        used[of] = True
        held = np.bincount(self.text[inside], minlength=len(texts))[texts]
        return Tokens(self.ids[texts], self.null[texts], self.train[texts], self.counts[texts], self.distinct[used], (np.cumsum(used) - 1)[of], self.base[used], held)

    def merge(self, rare: np.ndarray) -> None:
        """These distinct keys become RARE, but for the start: one entry for each code, that is for a count of 0 and of 1."""
        rare = rare & (self.distinct != START)
        codes, of = np.unique(self.base[rare], return_inverse=True)
        place = np.cumsum(~rare) - 1
        place[rare] = int((~rare).sum()) + of
        distinct, base, of = np.concatenate((self.distinct[~rare], np.full(len(codes), RARE))), np.concatenate((self.base[~rare], codes)), place[self.of]
        frequent = np.argsort(-np.bincount(of, minlength=len(distinct)), kind="stable")  # small numbers for most tokens
        rank = np.empty(len(frequent), np.int64)
        rank[frequent] = np.arange(len(frequent))
        self.distinct, self.base, self.of = distinct[frequent], base[frequent], rank[of]
        self.keys = self.distinct[self.of]

    def columns(self) -> list[np.ndarray]:
        return [self.ids, self.null, self.train, self.counts, self.held, self.distinct.view(np.int64), self.of, self.base]

    @functools.cached_property
    def _sums(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.keys)
        power, back = (_powers(x, n) for x in (ODD, pow(ODD, -1, 1 << 64)))
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(tb.mix(self.distinct)[self.of] * power[:n], out=out[1:])
        return out, back

    def before(self, places: np.ndarray, size: int) -> np.ndarray:
        """Keys of the ``size`` tokens before these places: polynomial hashes, as differences of prefix sums."""
        sums, back = self._sums
        return tb.mix((sums[places] - sums[places - size]) * back[places - size] + np.uint64(size))

    def room(self, size: int) -> np.ndarray:
        """Whether ``size`` tokens of the text, its start included, stand before each token."""
        return np.arange(len(self.keys)) - self.bounds[self.text] >= size


class State:
    """What a block knows between rounds: its tokens; of each text the totals; of each token whether its last n-gram is repeated; which are open, as their probability can still change, and their codes."""

    def __init__(self, tokens: Tokens, totals: np.ndarray, known: np.ndarray, base: np.ndarray, repeated: np.ndarray, open_: np.ndarray, codes: np.ndarray):
        self.tokens, self.totals, self.known, self.base, self.repeated, self.open, self.codes = tokens, totals, known, base, repeated, open_, codes

    def dump(self) -> bytes:
        moved = self.codes != self.tokens.base[self.tokens.of[self.open]]
        return _pack(*self.tokens.columns(), self.totals, self.known, self.base.view(np.int64), self.repeated, self.open, moved, self.codes[moved])

    @classmethod
    def load(cls, packed: bytes) -> State:
        ids, null, train, counts, held, distinct, of, root, totals, known, base, repeated, open_, moved, codes = _unpack(packed)
        tokens = Tokens(ids, null, train, counts, distinct.view(np.uint64), of, root, held)
        every = root[of[open_]]
        every[moved] = codes
        return cls(tokens, totals, known, base.view(np.float64), repeated, open_, every)

    def asked(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of the open tokens, the keys of their contexts, which have n-grams that may be repeated, and the keys of these."""
        places = np.flatnonzero(self.open)
        contexts, repeated = self.tokens.before(places, size), self.repeated[places]
        return places, contexts, repeated, tb.mix(contexts[repeated] ^ tb.mix(self.tokens.keys[places[repeated]] + np.uint64(ODD)))

    def rows(self, block: int, still: np.ndarray, size: int, last: int) -> pa.RecordBatch:
        """After a round of contexts of ``last`` tokens: the answers of texts without tokens in ``still``, and the others' state before contexts of ``size`` tokens.

        A token goes on if its context can occur twice: no n-gram within it, of up to ``last`` + 1 tokens, is known not to, and no word of it is rare.
        Of the texts that go on, only stretches are held that contexts of the tokens that go on can reach: back to the rare word or into the n-gram that stops them.
        """
        tokens, places = self.tokens, np.flatnonzero(self.open)
        here, none = np.arange(len(tokens.keys), dtype=np.int32), np.array([-1], np.int32)
        known, rare = (np.concatenate((none, np.maximum.accumulate(np.where(flags, here, none))[:-1])) for flags in (~self.repeated, tokens.keys == RARE))
        twice = (known < here - size + last) & (rare < here - size)
        self.repeated = self.repeated & (twice | ~tokens.scored)
        still = still & twice & tokens.room(size)
        gone = ~still[places]
        totals = self.totals + np.bincount(tokens.text[places[gone]], self.codes[gone], minlength=len(self.totals)).astype(np.int64)
        live = np.zeros(len(totals), bool)
        live[tokens.text[still]] = True
        rows = []
        if not live.all():
            rows.append({"kind": "done", "block": block, "data": _pack(*(c[~live] for c in (tokens.ids, tokens.null, tokens.counts - 1, self.known, self.base.view(np.int64), totals)))})
        if live.any():
            ends = np.flatnonzero(still)
            reach = np.bincount(np.maximum(np.maximum(known[ends] - last + 1, rare[ends]), tokens.bounds[tokens.text[ends]]), minlength=len(still))
            reach[1:] -= still[:-1]
            inside = np.cumsum(reach) > 0
            left = State(tokens.some(live, inside), totals[live], self.known[live], self.base[live], self.repeated[inside], still[inside], self.codes[~gone])
            rows.append({"kind": "live", "block": block, "data": left.dump()})
        return _rows(rows)


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, pa.schema([("kind", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("data", pa.binary())]))


def _count(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the first place and the sum of the weights of each, and for each key its place among them."""
    order, starts, of = bl.totals(keys)
    first = order[starts]
    return keys[first], first, np.bincount(of, weights, minlength=len(first)).astype(np.int64), of


def smoothed(c: np.ndarray, n: np.ndarray, once: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Probability of a symbol that follows a context c of n times, ``once`` of which are symbols that follow once; q: in the suffix."""
    return (np.where(c > 1, c, 0) + (once + STRENGTH) * q) / (n + STRENGTH)


def _kept(rows: pa.RecordBatch, folder: str) -> pa.RecordBatch:
    """States go to files of the folder, and the rows hold their paths: a state stays where it is while answers come to its block."""
    own = rows.to_pylist()
    for row in own:
        if row["kind"] == "live":
            put(folder, name := str(row["block"]), row["data"])
            row["size"] = len(row["data"])
            row["data"] = f"{folder}/{name}".encode()
    return _rows(own)


def _reader(load):
    """Block, what ``load`` makes of its file, and the further columns; the file's path is in column 1."""

    def read(batches) -> Iterator[tuple]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield batch.column(0)[k].as_py(), load(fetch(batch.column(1)[k].as_py().decode())), *(batch.column(j)[k] for j in range(2, batch.num_columns))

    return read


_read = _reader(State.load)


@bl.one_at_a_time(bl.read, keep=True)
def _send_words(block: int, chunk: tb.Chunk, _: list, parts: int, folder: str | None = None) -> pa.RecordBatch:
    """Tokens of a block with their training counts; the tokens stay in a file of the folder."""
    tokens = Tokens.read(chunk)
    if folder:
        put(folder, str(block), tokens.dump())
    counts = np.bincount(tokens.of, tokens.scored & tokens.train[tokens.text], minlength=len(tokens.distinct)).astype(np.int64)
    full, at = bl.cut(tokens.distinct, parts)
    return bl.sent(block, full, [bl.squeeze_hashes(tokens.distinct[at[p] : at[p + 1]], counts[at[p] : at[p + 1]]) for p in full.tolist()])


@bl.lean
def _combine_words(table: pa.Table) -> pa.Table:
    """Each block's answer, and a row (block -1) with the part's tokens and distinct words."""
    part = table.column("part")[0].as_py()
    found = [bl.expand_hashes(p.as_py(), 1) for p in table.column("entries")]
    keys, counts = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    order, first, place = bl.totals(keys)
    total = np.add.reduceat(counts[order], first)
    at = tb.offsets(np.array([len(f[0]) for f in found], np.int64))
    rows = [bl.numbers_out(total[place[a:b]]) for a, b in zip(at[:-1], at[1:], strict=True)]
    return bl.answers(part, [*table.column("block").to_pylist(), -1], [*rows, bl.numbers_out(np.array([total.sum(), (total > 0).sum()]))])


def _numbers(answers: pa.Scalar) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(bl.numbers_in(a.as_py()) for a in (answers.values if answers.is_valid else ()))])


@bl.one_at_a_time(_reader(Tokens.load), keep=True)
def _begin(block: int, tokens: Tokens, answers: pa.Scalar, tokens_in_all: int, distinct: int, size: int, folder: str) -> pa.RecordBatch:
    """Base figures of a block, and its state before contexts of ``size`` tokens."""
    counts = _numbers(answers)
    logs, share = np.log10(counts + 1.0), np.log10(tokens_in_all + distinct + 1.0)
    tokens.base = np.rint((share - logs) * STEPS).astype(np.int64)
    own, bounds = tokens.of[tokens.scored], tokens.bounds - np.arange(len(tokens.bounds))
    repeated = (counts > 1)[tokens.of] | ~tokens.scored
    base = tb.sums(logs[own], bounds) - np.diff(bounds) * share
    tokens.merge(counts < 2)
    state = State(tokens, np.zeros(len(tokens.ids), np.int64), tb.sums((counts > 0)[own], bounds), base, repeated, tokens.scored, tokens.base[tokens.of[tokens.scored]])
    return _kept(state.rows(block, tokens.scored, size, 0), folder)


@bl.one_at_a_time(_read, keep=True)
def _send_grams(block: int, state: State, size: int, parts: int) -> pa.RecordBatch:
    """Distinct n-grams of a block that may be repeated, with their training counts."""
    places, _, repeated, keys = state.asked(size)
    keys, _, counts, _ = _count(keys, state.tokens.train[state.tokens.text[places[repeated]]])
    full, at = bl.cut(keys, parts)
    return bl.sent(block, full, [bl.squeeze_hashes(keys[at[p] : at[p + 1]], counts[at[p] : at[p + 1]]) for p in full.tolist()])


@bl.lean
def _combine_grams(table: pa.Table) -> pa.Table:
    """For each block and n-gram twice its count, one more for the first block that has it."""
    table = table.sort_by("block")
    found = [bl.expand_hashes(p.as_py(), 1) for p in table.column("entries")]
    keys, counts = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    at = tb.offsets(np.array([len(f[0]) for f in found], np.int64))
    order, first, place = bl.totals(keys)
    reply = 2 * np.add.reduceat(counts[order], first)[place] if len(keys) else counts
    reply[order[first]] += 1
    return bl.answers(table.column("part")[0].as_py(), table.column("block").to_pylist(), [bl.numbers_out(reply[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)])


def _alone(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What one n-gram of each count puts between the first two sums of terms, and in the last."""
    return tuple(np.rint(c * np.log(x) * FINE).astype(np.int64) for x in (np.maximum(c - 1, 0) + STRENGTH, np.maximum(c, 1)))


def _apart(sums: np.ndarray) -> np.ndarray:
    """The sums as they travel: two of them as what sets them apart from one n-gram of the whole count, nearly always 0, signs in the lowest bit."""
    c, seen, fresh, spread = sums
    between, last = _alone(c)
    return np.stack((c, seen, *((x << 1) ^ (x >> 63) for x in (seen - fresh - between, spread - last))))


def _together(c: np.ndarray, seen: np.ndarray, *apart: np.ndarray) -> tuple[np.ndarray, ...]:
    """Undoes :func:`_apart`."""
    (between, last), (x, y) = _alone(c), ((v >> 1) ^ -(v & 1) for v in apart)
    return c, seen, seen - between - x, last + y


@bl.one_at_a_time(_read, keep=True)
def _send_contexts(block: int, state: State, answers: pa.Scalar, size: int, parts: int, folder: str) -> pa.RecordBatch:
    """A block's contexts with the training symbols behind them, and the sums over the n-grams that it answers for.

    For each open token the count of its n-gram (0 if it can't be repeated) and its context's place among the block's contexts stay in a file beside the state.
    """
    places, contexts, repeated, grams = state.asked(size)
    _, first, _, of = _count(grams, np.zeros(len(grams)))
    reply = _numbers(answers)
    count, mine = reply >> 1, (reply & 1).astype(bool) & (reply > 3)
    at = np.flatnonzero(repeated)[first[mine]]  # of the n-grams that the block answers for
    c = np.zeros(len(places), np.int64)
    c[repeated] = count[of]
    keys, _, follow, context = _count(contexts, state.tokens.train[state.tokens.text[places]])
    put(folder, f"{block}.counts", _pack(c, context))
    c = count[mine]
    q = 10.0 ** (-state.codes[at] / STEPS)
    seen = np.log((c - 1 + STRENGTH * q) / q)
    terms = (c, *(np.rint(c * x * FINE).astype(np.int64) for x in (seen, seen - np.log(c - 1 + STRENGTH), np.log(c))))
    sums = np.stack([np.bincount(context[at], x, minlength=len(keys)).astype(np.int64) for x in terms])  # whole numbers below 2**53
    sums = _apart(sums)
    full, cut = bl.cut(keys, parts)
    slices = [slice(cut[p], cut[p + 1]) for p in full.tolist()]
    return bl.sent(block, full, [bl.squeeze_hashes(keys[own], follow[own], *sums[:, own]) for own in slices])


def judged(n: np.ndarray, repeated: np.ndarray, seen: np.ndarray, fresh: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether contexts are retained, and whether longer ones can be, by the number of symbols behind them, of repeated ones, and the terms' sums."""
    once = n - repeated
    gain = seen / FINE - n * np.log(np.maximum(n - 1, 0) + STRENGTH) + once * np.log(STRENGTH)
    passed = (gain >= DIVERGENCE) & (repeated > 1)
    bound = np.where(passed, repeated * np.log(n + STRENGTH) - spread / FINE, fresh / FINE)
    return passed, (bound >= DIVERGENCE) & (repeated > 1)


@bl.lean
def _combine_contexts(table: pa.Table) -> pa.Table:
    """For each block and context: 4 n + 2 (retained) + 1 (go on), then the number of symbols that follow once; n and this only if retained."""
    found = [bl.expand_hashes(p.as_py(), 5) for p in table.column("entries")]
    keys, *columns = (np.concatenate([f[k] for f in found]) for k in range(6))
    at = tb.offsets(np.array([len(f[0]) for f in found], np.int64))
    order, first, place = bl.totals(keys)
    n, repeated, *sums = (np.add.reduceat(c[order], first) for c in (columns[0], *_together(*columns[1:])))
    passed, on = judged(n, repeated, *sums)
    reply = np.stack((np.where(passed, 4 * n + 2, 0) + on, np.where(passed, n - repeated, 0)))[:, place]
    return bl.answers(table.column("part")[0].as_py(), table.column("block").to_pylist(), [bl.numbers_out(reply[:, a:b].reshape(-1)) for a, b in zip(at[:-1], at[1:], strict=True)])


@bl.one_at_a_time(_read, keep=True)
def _go_on(block: int, state: State, answers: pa.Scalar, size: int, longer: int, before: str, folder: str) -> pa.RecordBatch:
    """The block after a round, before contexts of ``longer`` tokens; ``before``: the folder of the states and counts that it reads."""
    places, (c, context) = np.flatnonzero(state.open), _unpack(fetch(f"{before}/{block}.counts"))
    told = [bl.numbers_in(a.as_py()).reshape(2, -1) for a in answers.values]
    reply, once = (np.concatenate([t[k] for t in told])[context] for k in (0, 1))
    passed = (reply & 2).astype(bool)
    q = 10.0 ** (-state.codes[passed] / STEPS)
    state.codes[passed] = np.rint(-np.log10(smoothed(c[passed], (reply >> 2)[passed], once[passed], q)) * STEPS).astype(np.int64)
    state.repeated[places] = c > 1
    still = np.zeros(len(state.open), bool)
    still[places] = reply & 1
    return _kept(state.rows(block, still, longer, size), folder)


def _results(batches):
    for batch in batches:
        for packed in batch.column(0):
            ids, null, tokens, known, base, total = _unpack(packed.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=null), pa.array(tokens), pa.array(known), pa.array(base.view(np.float64)), pa.array(-total / STEPS)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])


def parts_of_round(held: int, parts: int) -> int:
    """Tasks and ranges of a round, by the bytes of its states; ``parts``: the most."""
    return max(1, min(parts, -(-held // ROUND_BYTES)))


def _round(table: DataFrame, folder: str, size: int, longer: int, parts: int) -> tuple[DataFrame, str]:
    """The blocks (and the texts that are done) after contexts of ``size`` tokens were tested, and the folder of their states; deletes what it took."""
    live = table.select("block", "data").repartition(parts, "block")  # small rows, but tasks that are long: as many as there are ranges
    after = made_folder(table.sparkSession, "states")

    def answered(blocks: DataFrame, send, combine, name: str, **settings) -> DataFrame:
        sent = blocks.mapInArrow(functools.partial(send, size=size, parts=parts, **settings), bl.SENT_SCHEMA)
        return materialise(sent.groupBy("part").applyInArrow(combine, bl.ANSWER_SCHEMA), name)

    def dealt(answers: DataFrame) -> DataFrame:
        return answers.repartition(parts, "block")

    grams = answered(live, _send_grams, _combine_grams, "grams")
    contexts = answered(bl.beside(live, dealt(grams)), _send_contexts, _combine_contexts, "contexts", folder=folder)
    release(grams)
    told = bl.beside(live, dealt(contexts))
    out = materialise(told.mapInArrow(functools.partial(_go_on, size=size, longer=longer, before=folder, folder=after), ROWS), "round", by="kind")
    release(table, contexts)
    remove(table.sparkSession, folder)
    return out, after


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words (runs of other characters than 0x20 and 0x09-0x0D, A-Z in lower case) and one
    end. Training texts are those whose crc32(id as text) mod 7 is not 2; rows without id
    train too. A null text counts as empty and is the end alone. Repeated rows count each time. An
    empty table gives an empty result. Other columns are ignored. Words and contexts are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    blocks = bl.pack_blocks(docs, id_col, text_col)
    parts = bl.parts_for(blocks)
    read = made_folder(spark, "tokens")
    sent = blocks.mapInArrow(functools.partial(_send_words, parts=parts, folder=read), bl.SENT_SCHEMA)
    got = materialise(sent.groupBy("part").applyInArrow(_combine_words, bl.ANSWER_SCHEMA), "counts")
    sums = [bl.numbers_in(bytes(r["answers"])) for r in got.filter("block = -1").select("answers").toLocalIterator()]  # two numbers a part
    tokens, distinct = (int(sum(s[k] for s in sums)) for k in (0, 1))
    steps = lengths()
    size = next(steps)
    folder = made_folder(spark, "states")
    told = bl.gathered(got.filter("block >= 0").repartition(parts, "block")).select("block", F.concat(F.lit(f"{read}/"), F.col("block").cast("string")).cast("binary").alias("data"), "answers")
    release(blocks)
    table = materialise(told.mapInArrow(functools.partial(_begin, tokens_in_all=tokens, distinct=distinct, size=size, folder=folder), ROWS), "round", by="kind")
    release(got)
    remove(spark, read)
    done = []
    while True:
        done.append(parts_of(table, "done").select("data"))
        live = parts_of(table, "live")
        held = live.agg(F.sum("size")).first()[0]
        if held is None:
            remove(spark, folder)
            break
        longer = next(steps)
        table, folder = _round(live, folder, size, longer, parts_of_round(held, parts))
        size = longer
    out = functools.reduce(DataFrame.unionByName, done).mapInArrow(_results, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
