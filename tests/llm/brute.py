"""Plain versions of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def low(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def exact_dedup(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[low(t)] if x is not None]
        keep = max(ids) if ids and len(groups[low(t)]) > 1 else i
        out.append((i, keep, len(groups[low(t)]), i == keep, sha(low(t))))
    return out


def substring_dedup(rows, length=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1) if i is not None else ():
            s = b[k : k + length]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1) if i is not None else ():
            if first[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


SECRETS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)


def base_secrets(text):
    found = [(m.start(), k, name, m.end()) for k, (name, pattern, good) in enumerate(SECRETS) for m in pattern.finditer(text or "") if good(m)]
    return ",".join(f"{name}:{a}:{b}" for a, _, name, b in sorted(found))


def guess_cost(value, ranks, steps, dates, char):
    """Least cost over all segmentations, span by span."""
    import functools
    import math

    fold = value.translate({c: c + 32 for c in range(65, 91)})

    def spans(i, j):
        own, size = fold[i:j], j - i
        yield sum(map(char, value[i:j])) if size == 1 else math.inf
        if 3 <= size <= 20 and own in ranks and re.fullmatch("[a-z]+", own):
            yield math.log10(ranks[own]) + (0 if own == value[i:j] else math.log10(2 * size))
        if dates.fullmatch(own):
            yield math.log10(130 if size == 4 else 130 * 372)
        if 3 <= size <= 64 and all(own[k : k + 2] in steps for k in range(size - 1)):
            yield math.log10(60 * size)
        for unit in range(1, min(32, size // 2) + 1):
            if size % unit == 0 and size >= 3 and own == own[:unit] * (size // unit) and not (i >= unit and fold[i - unit : i] == own[:unit]):
                yield sum(map(char, value[i : i + unit])) + math.log10(size // unit)

    @functools.lru_cache(None)
    def best(j):
        return min(best(i) + c for i in range(j) for c in spans(i, j)) if j else 0.0

    return best(len(value))


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def windows(items, size=13):
    out = defaultdict(set)
    for i, t in items:
        w = WORD.findall(low(t))
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            out[tuple(w[k : k + n])].add(i)
    return out


def decontaminate(rows, items):
    found = windows(items)
    sizes = {len(k) for k in found}
    out = []
    for i, t in rows:
        w = WORD.findall(low(t))
        hit, own = [False] * len(w), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if x := found.get(tuple(w[k : k + n])):
                    hit[k : k + n] = [True] * n
                    own |= x
        h = sum(hit)
        out.append((i, len(w), h, len(own), sha(",".join(sorted(map(str, own)))), h > 0 and 20 * h >= len(w)))
    return out


SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def unigrams(rows):
    import math

    train = [i is None or zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
    tokens = [[*SPACE.findall(low(t)), None] for _, t in rows]
    counts = Counter(w for ok, own in zip(train, tokens, strict=True) if ok for w in own)
    n, v = sum(counts.values()), len(counts)
    return [(i, not ok, len(own), sum(counts[w] > 0 for w in own), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)) for (i, _), ok, own in zip(rows, train, tokens, strict=True)]


def suffix_tree(rows, lengths, strength, divergence):
    """log10 probability of each text by contexts of these lengths, all that occur being tested, and the longest retained length."""
    import math

    train = [i is None or zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
    tokens = [["<", *SPACE.findall(low(t)), None] for _, t in rows]
    counts = Counter(w for ok, own in zip(train, tokens, strict=True) if ok for w in own[1:])
    n, v = sum(counts.values()), len(counts)
    p = [[(counts[w] + 1) / (n + v + 1) for w in own] for own in tokens]
    longest = 0
    for size in lengths:
        if size >= max(map(len, tokens)):
            break
        follow, places = defaultdict(Counter), defaultdict(list)
        for t, own in enumerate(tokens):
            for k in range(size, len(own)):
                context = tuple(own[k - size : k])
                places[context].append((t, k))
                if train[t]:
                    follow[context][own[k]] += 1
        for context, own in follow.items():
            m = own.total()
            if m == len(own):
                continue
            q = {tokens[t][k]: p[t][k] for t, k in places[context]}
            gain = sum(c * math.log((c - 1 + strength * q[x]) / ((m - 1 + strength) * q[x])) for x, c in own.items())
            if gain >= divergence:
                longest = size
                once = sum(c == 1 for c in own.values())
                for t, k in places[context]:
                    c = own[tokens[t][k]]
                    p[t][k] = ((c if c > 1 else 0) + (once + strength) * p[t][k]) / (m + strength)
    return [sum(math.log10(x) for x in own[1:]) for own in p], longest


def shingles(text, size):
    w = SPACE.findall(low(text))
    if len(w) >= size:
        return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def near_dedup(rows, size=4, threshold=80):
    sets = [shingles(t, size) for _, t in rows]
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None or not sets[a]:
                continue
            common = len(sets[a] & sets[b])
            if 100 * common >= threshold * (len(sets[a]) + len(sets[b]) - common):
                up[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return [(i, len(s), None if i is None else least[root(k)], i is None or i == least[root(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]


def ordered(rows):
    return sorted(rows, key=repr)
