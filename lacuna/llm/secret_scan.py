"""Secret scans: fixed patterns, and a guess-cost model for values in credential contexts.

A value that follows a credential word is segmented at the least total cost, in
log10 guesses, into dictionary words, dates, repeats, keyboard walks and
brute-force spans (dynamic programming over the value). A value that costs at
least ``MIN_COST`` is reported as a span of kind ``guess`` beside the base kinds.

The dictionary ranks words by how often they occur in all texts outside credential values (so a secret that
many copies repeat is no word), the ``DICTIONARY`` most frequent of 3 to ``LONGEST_WORD`` ASCII letters; a few common password words come first.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm import textbytes as tb

KINDS = ("assign", "access", "hex", "guess")
MIN_COST = 12.0

# The base patterns. All classes are ASCII, so they are applied to bytes; ASSIGN and CONTEXT to bytes in lower case.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
HEX = np.zeros(256, dtype=bool)
HEX[[*range(0x30, 0x3A), *range(0x61, 0x67)]] = True

#: Where a value is a credential: the words, and a value of eight or more characters that aren't white space or quotes, however long.
CONTEXT = re.compile(rb"""(?<![a-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|credentials?|auth|bearer|(?:access|secret|private|api|client)[_-]?(?:key|secret|token)|secret|token|apikey)["']?\x20*(?:=>|[:=])\x20*["']?([!#-&(-~]{8,})""")

#: Common words of passwords, most common first; the position is the number of guesses.
WORDS = """password qwerty dragon monkey letmein football iloveyou admin welcome login master sunshine princess shadow
superman michael baseball trustno hello freedom whatever charlie secret summer winter spring autumn monday love
the and for you with that this from have not test user root guest change default example sample token access key
server system data pass word demo temp temporary none null true false name value string number enabled disabled""".split()

#: Rows that keyboard walks follow, either way.
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz", "qazwsxedcrfvtgbyhnujm")
DATES = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")
DATE_SIZES = (4, 8, 9, 10)
WALK = (3, 64)  # characters of a keyboard walk; a longer one is several
UNIT = 32  # characters of a repeated unit, at most
DICTIONARY = 50_000
LONGEST_WORD = 20
LETTERS = np.zeros(256, dtype=bool)
LETTERS[0x61:0x7B] = True


def _classes() -> np.ndarray:
    cost = np.full(256, math.log10(95))
    cost[0x30:0x3A] = 1.0
    cost[0x41:0x5B] = cost[0x61:0x7B] = math.log10(26)
    return cost


BRUTE = _classes()
RANK = {w: k + 1 for k, w in enumerate(WORDS)}
STEPS = {a + b for row in ROWS for a, b in [*zip(row, row[1:], strict=False), *zip(row[1:], row, strict=False)]}


def _repeats(low: str, brute: np.ndarray) -> dict[int, list[tuple[int, float]]]:
    """(start, cost) of the repeats by where they end: of each unit's size the longest that ends there."""
    points, total, out = np.array([ord(c) for c in low]), np.concatenate(([0.0], np.cumsum(brute))), {}
    for unit in range(1, min(UNIT, len(low) // 2) + 1):
        same = points[unit:] == points[:-unit]
        places = np.arange(1, len(same) + 1)
        run = places - np.maximum.accumulate(np.where(same, 0, places))  # symbols in a row that equal those a unit before
        for k in np.flatnonzero(run >= max(unit, 3 - unit)).tolist():
            end, times = k + 1 + unit, 1 + int(run[k]) // unit
            if times * unit >= 3:
                start = end - times * unit
                out.setdefault(end, []).append((start, float(total[start + unit] - total[start]) + math.log10(times)))
    return out


def guess_cost(value: str, ranks: dict[str, int] = RANK) -> float:
    """log10 of the guesses that the cheapest segmentation needs; 0 for an empty value."""
    low, n = "".join(c.lower() if c.isascii() else c for c in value), len(value)
    brute = np.array([_char(c) for c in value])
    spans = _repeats(low, brute) if n > 2 else {}
    best, costs = [0.0] * (n + 1), brute.tolist()
    walk = word = 0  # where the keyboard walk, and the letters, that end here start
    for j in range(1, n + 1):
        c = low[j - 1]
        least = best[j - 1] + costs[j - 1]
        for i, cost in spans.pop(j, ()):
            least = min(least, best[i] + cost)
        if not "a" <= c <= "z":
            word = j
        for i in range(max(word, j - LONGEST_WORD), j - 2):
            if rank := ranks.get(low[i:j]):
                least = min(least, best[i] + math.log10(rank) + (0 if value[i:j] == low[i:j] else math.log10(2 * (j - i))))
        if "0" <= c <= "9":
            for size in DATE_SIZES:
                if j >= size and DATES.fullmatch(low, j - size, j):
                    least = min(least, best[j - size] + math.log10(130 if size == 4 else 130 * 372))
        if j > 1 and low[j - 2 : j] not in STEPS:
            walk = j - 1
        for i in range(max(walk, j - WALK[1]), j - WALK[0] + 1):
            least = min(least, best[i] + math.log10(60 * (j - i)))
        best[j] = least
    return best[n]


def _char(c: str) -> float:
    return float(BRUTE[ord(c)]) if ord(c) < 256 else 2.0


def _count_words(batches):
    for chunk in tb.chunks(batches):
        low = tb.LOWER[chunk.data]
        low[chunk.starts - 1] = 0x0A  # no value goes on in the next text
        for m in [*ASSIGN.finditer(low.tobytes()), *CONTEXT.finditer(low.tobytes())]:
            low[slice(*m.span(m.lastindex))] = 0x0A
        starts, ends = tb.words(low, LETTERS)
        own = (ends - starts >= 3) & (ends - starts <= LONGEST_WORD)
        starts, ends = starts[own], ends[own]
        _, first, counts = np.unique(tb.hash_spans(low, starts, ends - starts), return_index=True, return_counts=True)
        flat = low.tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([flat[starts[k] : ends[k]].decode() for k in first.tolist()], pa.string()), pa.array(counts.astype(np.int64))], names=["word", "n"])


def learn_words(docs: DataFrame, text_col: str = "text", most: int = DICTIONARY) -> dict[str, int]:
    """Ranks of the dictionary's words, from counts over all texts; words of the same count in alphabetical order."""
    texts = docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    counts = texts.mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    ranks = {r["word"]: k + 1 for k, r in enumerate(counts.orderBy(F.desc("n"), "word").limit(most).collect())}
    return ranks | {w: min(k, ranks.get(w, k)) for w, k in RANK.items()}


def scan_text(text: bytes, hex_spans: list[tuple[int, int]] | None = None, min_cost: float = MIN_COST, ranks: dict[str, int] = RANK) -> list[tuple[int, str, int]]:
    """(start, kind, end) in bytes, by start, then kind as listed."""
    low = text.lower()
    if hex_spans is None:
        hex_spans = [m.span() for m in re.finditer(rb"[0-9a-f]+", text)]
    found = [(a, "hex", b) for a, b in hex_spans if b - a >= LEAST["hex"]]
    values: dict[int, int] = {}
    for m in ASSIGN.finditer(low):
        if m.end(2) - m.start(2) >= LEAST["assign"]:
            found.append((m.start(), "assign", m.end()))
            values[m.start(2)] = m.end(2)
    found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    for m in CONTEXT.finditer(low):
        a, b = m.span(1)
        values[a] = max(values.get(a, 0), b)  # ASSIGN stops at the first byte outside its class
    for a, b in values.items():
        if guess_cost(text[a:b].decode("utf-8", "replace"), ranks) >= min_cost:
            found.append((a, "guess", b))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[1]), x[2]))


def _points(text: bytes, found: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    if text.isascii():
        return found
    point = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return [(int(point[a]), kind, int(point[b])) for a, kind, b in found]


def _scan(batches, min_cost: float, ranks):
    for chunk in tb.chunks(batches):
        runs, ends = tb.words(chunk.data, HEX)
        long = ends - runs >= LEAST["hex"]
        runs, ends = runs[long], ends[long]
        bounds = tb.per_text(chunk, runs)
        rows = []
        for k in range(len(chunk)):
            text, at = chunk.text(k), int(chunk.starts[k])
            mine = slice(bounds[k], bounds[k + 1])
            found = scan_text(text, [(a - at, b - at) for a, b in zip(runs[mine].tolist(), ends[mine].tolist(), strict=True)], min_cost, ranks.value)
            if found:
                found = _points(text, found)
            base = [x for x in found if x[1] != "guess"]
            said = ",".join(f"{kind}:{a}:{b}" for a, kind, b in base)
            rows.append([sum(x[1] == kind for x in base) for kind in KINDS[:3]] + [hashlib.sha256(said.encode()).hexdigest(), ",".join(f"{kind}:{a}:{b}" for a, kind, b in found)])
        columns = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([chunk.id_array(), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_cost: float = MIN_COST, dictionary: int = DICTIONARY) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are ``kind:start:end`` in code points, end exclusive, by start, then kind
    (assign, access, hex, guess), comma-joined; a span of the base kinds is the whole match. A null
    or empty text has none; null ids and repeated rows are answered row by row; an empty
    table gives an empty result. Other columns are ignored.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(learn_words(docs, text_col, dictionary))  # ``dictionary`` words of LONGEST_WORD letters at most
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return texts.mapInArrow(functools.partial(_scan, min_cost=min_cost, ranks=ranks), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
