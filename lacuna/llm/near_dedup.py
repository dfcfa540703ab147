"""Near-duplicate documents by HyperMinHash.

A document's distinct word shingles are hashed to 64 bits and sketched by 128 compressed registers of 16
bits: the leading zeros of a least hash and ``MANTISSA`` bits behind the leading one. In sets of more than
``LARGE`` shingles the leading bits of a hash choose one of 128 buckets, a register holds its
bucket's least hash, and empty buckets borrow from the next filled one. Sets of up to ``SMALL`` would fill
too few buckets and have a register for each of 128 hash functions instead; sizes between have both,
and sets so unlike in size that they share neither kind can't be linked. Documents with equal shingle sets are one class
with one representative.

Keys are bands of ``ROWS`` registers, and classes that share a key are candidates. A collision-corrected Jaccard
estimate drops pairs far below the threshold (by ``SIGMAS`` standard deviations), and the rest
are verified on full shingle sets. With 24 bands of 4 a pair at similarity 0.8 shares no key with a chance of 3e-6.

Within a key no all-pairs list is made. Each class is first compared with two leaders of its key, and keys whose
classes are then one component are done. In the others only pairs across components are left: a key of up to
``FEW`` classes lists them; a larger one is cut into blocks, and a task compares the full sets of two blocks by products
of their incidence matrices. What it finds is exact, so one link of each two components is enough.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm import textbytes as tb
from lacuna.llm.components import components
from lacuna.llm.probe import without
from lacuna.llm.scratch import materialise, release, small_batches

SHINGLE = 5
THRESHOLD = 80  # per cent
REGISTERS = 128
BUCKET_BITS = 7
SMALL, LARGE = 128, 102  # sets of up to SMALL and of more than LARGE; 102 / 128 < 0.8
ROWS, BANDS = 4, 24
MANTISSA = 10
SIGMAS = 6.0
FEW = 32
TOP_BLOCK, REST_BLOCK = 256, 128
COLUMNS = 4096  # of an incidence matrix at a time

_EDGES = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)
_SEEDS = tb.mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_SALTS = tb.mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BAND_REGISTERS = np.arange(ROWS * BANDS) * 37 % REGISTERS  # neighbours borrow from one another: bands take registers far apart


def shingle_hashes(chunk: tb.Chunk, size: int):
    """For each text its sorted distinct shingle hashes."""
    low = tb.LOWER[chunk.data]
    starts, ends = tb.words(low, tb.NOT_SPACE)
    bounds = tb.per_text(chunk, starts)
    word = tb.hash_spans(low, starts, ends - starts)
    many = max(0, len(word) - size + 1)
    rolled = np.full(many, size, np.uint64)
    for k in range(size):
        rolled = tb.mix(rolled * np.uint64(0x9E3779B97F4A7C15) + word[k : k + many])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            own = np.sort(rolled[a : b - size + 1])
            keep = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            yield own[keep]
        elif b > a:
            yield np.array([xxhash.xxh3_64_intdigest(word[a:b].tobytes())], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def compress(hashes: np.ndarray) -> np.ndarray:
    """16 bits of each 64-bit hash: leading zeros (to 52), then the MANTISSA bits behind the leading one."""
    rest = hashes >> np.uint64(12)  # 52 bits, exact in a double
    length = np.frexp(rest.astype(np.float64))[1]
    zeros = 52 - length
    mantissa = (rest << (zeros + 12).clip(0, 63).astype(np.uint64) << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    return (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | np.where(length > 0, mantissa, 0).astype(np.uint16)


def small_registers(hashes: np.ndarray) -> np.ndarray:
    """One register a hash function, of a non-empty set."""
    return compress(tb.mix(hashes[:, None] ^ _SEEDS).min(axis=0))


def large_registers(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One register a bucket, of a non-empty sorted set, and which buckets it fills itself."""
    at = np.searchsorted(hashes, _EDGES)
    least = hashes[np.minimum(at, len(hashes) - 1)]
    filled = (at < len(hashes)) & (least >> np.uint64(64 - BUCKET_BITS) == np.arange(REGISTERS, dtype=np.uint64))
    own = compress(least << np.uint64(BUCKET_BITS))
    places = np.flatnonzero(filled)
    source = places[np.searchsorted(places, np.arange(REGISTERS)) % len(places)]
    apart = (source - np.arange(REGISTERS)) % REGISTERS
    borrowed = own[source] ^ (apart * 40503 & 0xFFFF).astype(np.uint16)
    return np.where(apart == 0, own[source], borrowed), filled


def estimate(ra: np.ndarray, fa: np.ndarray, rb: np.ndarray, fb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates (by rows) over the registers that either set fills, less chance collisions, and the number of registers.

    Two different least hashes have equal leading zeros with a chance of 1/3, and equal mantissas with 2**-MANTISSA.
    """
    chance = 2.0**-MANTISSA / 3
    used = np.maximum((fa | fb).sum(axis=1), 1)
    share = ((ra == rb) & fa & fb).sum(axis=1) / used
    return (share - chance) / (1 - chance), used


def _class_id(hashes: np.ndarray) -> int:
    """64 bits that stand for a set."""
    return int.from_bytes(xxhash.xxh3_64_digest(hashes.tobytes()), "little", signed=True)


def _sketch(batches, size: int):
    for batch in batches:
        at = 0
        for chunk in tb.chunks([batch]):
            yield pa.RecordBatch.from_arrays([*_sketches(chunk, size), batch.column(2).slice(at, len(chunk))], names=SKETCH_NAMES)
            at += len(chunk)


SKETCH = "doc_id long, n_shingles long, cid long, set_key binary, small binary, large binary, text_key long"
SKETCH_NAMES = [f.split()[0] for f in SKETCH.split(", ")]


def _sketches(chunk: tb.Chunk, size: int) -> list[pa.Array]:
    counts, keys, cids, small, large = [], [], [], [], []
    for own in shingle_hashes(chunk, size):
        n = len(own)
        counts.append(n)
        keys.append(xxhash.xxh3_128_digest(own.tobytes()) if n else None)
        cids.append(_class_id(own) if n else None)
        small.append(small_registers(own).astype("<u2").tobytes() if 0 < n <= SMALL else None)
        if n > LARGE:
            regs, filled = large_registers(own)
            large.append(regs.astype("<u2").tobytes() + np.packbits(filled).tobytes())
        else:
            large.append(None)
    return [chunk.id_array(), pa.array(counts, pa.int64()), pa.array(cids, pa.int64()), *(pa.array(v, pa.binary()) for v in (keys, small, large))]


def _unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Registers and filled flags, by rows; small ones are all filled."""
    rows = column.to_pylist()
    width = 2 * REGISTERS
    regs = np.frombuffer(b"".join(r[:width] for r in rows), "<u2").reshape(len(rows), REGISTERS)
    flags = np.frombuffer(b"".join(r[width:].ljust(REGISTERS // 8, b"\xff") for r in rows), np.uint8).reshape(len(rows), -1)
    return regs, np.unpackbits(flags, axis=1).astype(bool)


def _bands(batches):
    for batch in batches:
        cids = np.asarray(batch.column(0))
        for kind in (0, 1):
            column = batch.column(1 + kind)
            some = np.flatnonzero(np.asarray(column.is_valid()))
            if len(some):
                regs, _ = _unpack(column.take(pa.array(some)))
                packed = np.ascontiguousarray(regs[:, _BAND_REGISTERS]).view("<u8")
                keys = tb.mix(packed ^ _SALTS ^ np.uint64(kind)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(cids[some], BANDS), pa.int64())], names=["key", "cid"])


def _promising(batches, threshold: int):
    """Pairs (a, b, and the small and large registers of each) whose estimate isn't far below the threshold."""
    goal = threshold / 100
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for k in (2, 4):
            x, y = batch.column(k), batch.column(k + 1)
            both = np.flatnonzero(np.asarray(x.is_valid()) & np.asarray(y.is_valid()))
            if len(both):
                rows = pa.array(both)
                guess, used = estimate(*_unpack(x.take(rows)), *_unpack(y.take(rows)))
                keep[both] |= guess >= goal - SIGMAS * np.sqrt(goal * (1 - goal) / used)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))


def _sets(batches, size: int):
    for chunk in tb.chunks(batches):
        sets = [own.astype("<u8") for own in shingle_hashes(chunk, size) if len(own)]
        yield pa.RecordBatch.from_arrays([pa.array([_class_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cid", "items"])


def _verify(batches, threshold: int):
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            a, b = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
            both = np.sort(np.concatenate((a, b)))
            common = int((both[1:] == both[:-1]).sum())
            keep.append(100 * common >= threshold * (len(a) + len(b) - common))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that are linked."""
    for side in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("cid").alias(side), F.col("small").alias(f"small_{side}"), F.col("large").alias(f"large_{side}"), F.col("n").alias(f"n_{side}")), side)
    sized = pairs.filter(100 * F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))
    near = sized.select("a", "b", "small_a", "small_b", "large_a", "large_b").mapInArrow(functools.partial(_promising, threshold=threshold), "a long, b long")
    for side in ("a", "b"):
        near = near.join(sets.select(F.col("cid").alias(side), F.col("items").alias(f"items_{side}")), side)
    return near.select("a", "b", "items_a", "items_b").mapInArrow(functools.partial(_verify, threshold=threshold), "a long, b long")


def _incidence(items: list[np.ndarray], shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns (places among the shared hashes), in order, and rows of a 0-1 matrix's ones."""
    hashes = np.concatenate(items)
    row = np.repeat(np.arange(len(items)), [len(x) for x in items])
    at = np.minimum(np.searchsorted(shared, hashes), len(shared) - 1)
    own = shared[at] == hashes
    order = np.argsort(at[own], kind="stable")
    return at[own][order], row[own][order]


def common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of a with each of b."""
    out = np.zeros((len(a), len(b)), np.float32)
    shared = np.intersect1d(np.concatenate(a), np.concatenate(b))
    if not len(shared):
        return out
    sides = [_incidence(x, shared) for x in (a, b)]
    for low in range(0, len(shared), COLUMNS):
        blocks = []
        for (column, row), n in zip(sides, (len(a), len(b)), strict=True):
            first, last = np.searchsorted(column, (low, low + COLUMNS))
            m = np.zeros((n, min(COLUMNS, len(shared) - low)), np.float32)
            m[row[first:last], column[first:last] - low] = 1
            blocks.append(m)
        out += blocks[0] @ blocks[1].T
    return out


def _across(table: pa.Table, threshold: int) -> pa.Table:
    """Links across components, between two blocks of a key's classes (side 0 and 1; 2 for both): one of each two components that have any."""
    side, cid, comp = (np.asarray(table.column(c)) for c in ("side", "cid", "comp"))
    items = [np.frombuffer(x.as_buffer(), "<u8") for x in table.column("items")]
    n = np.array([len(x) for x in items])
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    links: dict[tuple, tuple] = {}
    if len(left) and len(right):
        both = common([items[k] for k in left], [items[k] for k in right])
        linked = 100 * both >= threshold * (n[left][:, None] + n[right] - both)
        for x, y in zip(*np.nonzero(linked & (comp[left][:, None] != comp[right])), strict=True):
            p, q = left[x], right[y]
            links.setdefault((min(comp[p], comp[q]), max(comp[p], comp[q])), (min(cid[p], cid[q]), max(cid[p], cid[q])))
    return pa.table({"a": pa.array([x for x, _ in links.values()], pa.int64()), "b": pa.array([y for _, y in links.values()], pa.int64())})


def _crowded(rows: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links across components in the keys of many classes (key, cid, comp), one at least of each two components that have any.

    A key's largest component is cut into blocks, and the rest into others; each block of the rest meets
    all blocks, and those of the largest don't meet each other.
    """
    counts = rows.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("top"), F.max("n").alias("n_top"), F.sum("n").alias("n"))
    tops, rests = F.ceil(F.col("n_top") / TOP_BLOCK), F.ceil((F.col("n") - F.col("n_top")) / REST_BLOCK)
    dealt = rows.join(materialise(counts, "crowded-keys"), "key").withColumns({"tops": tops, "rests": rests})
    dealt = dealt.withColumn("i", F.when(F.col("comp") == F.col("top"), F.pmod(F.xxhash64("cid", F.lit(5)), "tops")).otherwise(F.pmod(F.xxhash64("cid", F.lit(6)), "rests")))
    is_top = F.col("comp") == F.col("top")
    one = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.cast("long").alias("i"), j.cast("long").alias("j"), side.alias("side"))
    with_rest = F.transform(F.sequence(F.lit(0).cast("long"), F.col("rests") - 1), lambda j: F.when(is_top, one(0, j, F.col("i"), F.lit(1))).otherwise(one(1, F.least(F.col("i"), j), F.greatest(F.col("i"), j), F.when(F.col("i") == j, 2).when(F.col("i") < j, 0).otherwise(1))))
    with_top = F.when(~is_top, F.transform(F.sequence(F.lit(0).cast("long"), F.col("tops") - 1), lambda j: one(0, F.col("i"), j, F.lit(0)))).otherwise(F.array().cast("array<struct<kind:int,i:bigint,j:bigint,side:int>>"))
    met = dealt.select("key", "cid", "comp", F.explode(F.concat(with_rest, with_top)).alias("m")).select("key", "cid", "comp", "m.*")
    full = met.join(sets, "cid").select("key", "kind", "i", "j", "side", "cid", "comp", "items")
    return full.groupBy("key", "kind", "i", "j").applyInArrow(lambda table: _across(table, threshold), "a long, b long")


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    Words are runs of other characters than 0x20 and 0x09-0x0D, A-Z in lower case;
    shingles are of ``size`` words, a shorter text is one shingle, and a text without words has
    none and is linked with nothing. Documents are linked when 100 * intersection >=
    ``threshold`` * union of their distinct shingles. component_id is the least id that can be
    reached. Rows of one id are answered one by one; with the same text they are one document, with different
    texts they are linked only as other documents are. A null id is linked with nothing: its component_id is null and the row is kept. An
    empty table gives an empty result. Other columns are ignored.
    """
    return _labelled(docs, id_col, text_col, size, threshold).drop("text_key")


def _labelled(docs: DataFrame, id_col: str, text_col: str, size: int, threshold: int) -> DataFrame:
    """The rows of :func:`near_dedup` with a hash of the text."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.xxhash64(text_col).alias("text_key"))
    sketches = materialise(texts.mapInArrow(functools.partial(_sketch, size=size), SKETCH), "sketches")
    filled = sketches.filter("set_key is not null and doc_id is not null")
    classes = materialise(filled.groupBy("set_key").agg(F.min("cid").alias("cid"), F.min("doc_id").alias("rep"), F.min("small").alias("small"), F.min("large").alias("large"), F.min("n_shingles").alias("n")), "classes")
    labels = _components(texts, classes, size, threshold)
    linked = classes.select("set_key", "cid", "rep").join(labels, "cid")
    least = linked.groupBy("comp").agg(F.min("rep").alias("component_id"))
    found = linked.join(least, "comp").select("set_key", "component_id")
    found = materialise(found.unionByName(classes.join(labels, "cid", "left_anti").select("set_key", F.col("rep").alias("component_id"))), "class-components")
    release(classes, labels)
    out = sketches.select("doc_id", "n_shingles", "set_key", "text_key").join(found, "set_key", "left")
    own = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"), "text_key")


def _components(texts: DataFrame, classes: DataFrame, size: int, threshold: int) -> DataFrame:
    """cid, comp of the classes that have links."""
    bands = materialise(classes.select("cid", "small", "large").mapInArrow(_bands, "key long, cid long"), "bands")
    leads = F.array_distinct(F.array(F.min("cid"), F.max_by("cid", F.xxhash64("cid", "key"))))
    shared = materialise(bands.groupBy("key").agg(F.count("*").alias("c"), leads.alias("leads")).filter("c > 1"), "shared-keys")
    left = materialise(bands.join(shared, "key"), "shared-bands")
    release(bands, shared)
    wanted = classes.select("cid", "rep").join(left.select("cid").distinct(), "cid", "left_semi").select("rep")
    chosen = texts.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("rep"), "left_semi")
    sets = materialise(chosen.mapInArrow(functools.partial(_sets, size=size), "cid long, items binary").dropDuplicates(["cid"]), "sets")
    pairs = materialise(left.select("cid", F.explode("leads").alias("lead")).filter("cid <> lead").select(*_pair("cid", "lead")).distinct(), "pairs")
    links = materialise(_verified(pairs, classes, sets, threshold), "links")
    labels = components(links)
    rows = materialise(left.select("key", "cid", "c").join(labels, "cid", "left").select("key", "cid", "c", F.coalesce("comp", "cid").alias("comp")), "band-components")
    release(left)
    mixed = materialise(rows.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("key"), "mixed-keys")
    if not mixed.isEmpty():
        some = materialise(rows.join(mixed, "key", "left_semi"), "mixed")
        few = some.filter(F.col("c") <= FEW)
        other = few.select("key", F.col("cid").alias("other"), F.col("comp").alias("comp2"))
        across = few.join(other, "key").filter("comp < comp2").select(*_pair("cid", "other")).distinct().join(pairs, ["a", "b"], "left_anti")
        more = materialise(_verified(across, classes, sets, threshold), "few-links")
        crowded = materialise(_crowded(some.filter(F.col("c") > FEW), sets, threshold).distinct(), "crowded-links")
        release(labels, some)
        labels = components(links.unionByName(more).unionByName(crowded))
        release(more, crowded)
    release(rows, mixed, sets, pairs, links)
    return labels


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each component, the one with the least id; all columns as they are.

    A row goes by its id and text, so an id that has another text as well keeps that; repeated rows of the
    document that stays all stay. An empty table stays empty. Only rows whose key a filter holds are shuffled (see :func:`probe.without`).
    """
    gone = _labelled(docs, id_col, text_col, size, threshold).filter("not kept").select("doc_id", "text_key")
    return without(docs, [F.col(id_col).cast("long"), F.xxhash64(text_col)], gone)
