"""Each operator against a plain version, on odd rows and on the smallest table."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lacuna.llm import decontam, exact_dedup, langid, lm_score, near_dedup, piece_codec, secret_scan, sharding, suffix_dedup, token_store
from lacuna.llm import textbytes as tb

from . import brute
from .conftest import ODD

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def same(got, want):
    assert brute.ordered(got) == brute.ordered(want)


@pytest.fixture(params=["odd", "table"])
def case(request, odd, docs, texts):
    return (odd, ODD) if request.param == "odd" else (docs, list(texts.items()))


def test_exact_dedup(case):
    df, plain = case
    got = rows(exact_dedup.exact_dedup(df), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    same(got, brute.exact_dedup(plain))


def test_exact_dedup_with_a_full_filter(docs, texts):
    """A filter far too small sends every row through the shuffle and changes nothing."""
    got = rows(exact_dedup.exact_dedup(docs, max_bits=1 << 15), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    same(got, brute.exact_dedup(list(texts.items())))


def test_exact_dedup_passes_unique_rows_by(spark):
    """Groups spread over partitions, one of a third of all rows."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 1500).cast("string"))).alias("text")).repartition(7)
    plain = [(r["doc_id"], r["text"]) for r in df.collect()]
    same(rows(exact_dedup.exact_dedup(df), "doc_id", "keep_id", "group_size", "kept", "text_sha256"), brute.exact_dedup(plain))


def test_drop_copies_keeps_columns(odd):
    out = exact_dedup.drop_copies(odd)
    assert out.columns == odd.columns
    assert 0 not in [r["doc_id"] for r in out.collect()]


def test_drop_copies_goes_by_id_and_text(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "A")], "doc_id long, text string")
    assert sorted(rows(exact_dedup.drop_copies(df), "doc_id", "text")) == [(1, "b"), (2, "A")]


def test_suffix_dedup(case):
    df, plain = case
    got = rows(suffix_dedup.substring_dedup(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    same(got, brute.substring_dedup(plain))


def test_suffix_dedup_of_shared_passages(spark):
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefgh é"))
    shared = ["".join(rng.choice(letters, n)) for n in (49, 50, 51, 80, 400)]
    plain = []
    for i in range(60):
        own = ["".join(rng.choice(letters, int(rng.integers(0, 60)))) for _ in range(3)]
        plain.append((int(rng.integers(0, 40)), own[0] + shared[i % 5] + own[1] + shared[(i // 5) % 5] + own[2]))
    plain += [(100, "q" * 500), (101, "q" * 60), (102, "q" * 49), (50, "pq" * 40), (51, "qp" * 45)]
    df = spark.createDataFrame(plain, "doc_id long, text string").repartition(4)
    same(rows(suffix_dedup.substring_dedup(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), brute.substring_dedup(plain))


def test_equal_hashes_of_different_spans(monkeypatch):
    """Spans are told apart by their bytes where hashes don't."""
    data = np.frombuffer(b"abcabdabc" + bytes(tb.PAD), np.uint8)
    starts, lens = np.array([0, 3, 6]), np.array([3, 3, 3])
    for f in (tb.hash_spans, lambda d, s, n: np.full(len(s), 7, np.uint64)):
        monkeypatch.setattr(tb, "hash_spans", f)
        keys = tb.span_keys(data, starts, lens)
        assert keys[0] == keys[2] != keys[1]


def test_order_of_keys():
    rng = np.random.default_rng(2)
    for keys in (rng.integers(0, 2**64 - 1, 1000, np.uint64), np.repeat(rng.integers(0, 50, 300, np.uint64), 3), np.arange(100, 0, -1).astype(np.uint64), np.zeros(0, np.uint64), np.full(1, 2**64 - 1, np.uint64)):
        assert np.array_equal(tb.order_of(keys), np.argsort(keys, kind="stable"))


def test_cleaned_bytes(spark):
    """What is left is the digest's text."""
    shared = "a passage of more than fifty bytes that two documents share, byte by byte. "
    df = spark.createDataFrame([(1, shared + "one"), (2, "x " + shared + "two"), (3, None), (3, "short"), (None, shared)], "doc_id long, text string")
    kept = {(r["doc_id"], bytes(r["kept"] or b"")) for r in suffix_dedup.cleaned(df).collect()}
    assert kept == {(1, (shared + "one").encode()), (2, b"x two"), (3, b""), (3, b"short"), (None, shared.encode())}
    want = {(i, brute.sha(k)) for i, k in kept}
    assert set(rows(suffix_dedup.substring_dedup(df), "doc_id", "kept_sha256")) == want


def test_very_long_texts(spark):
    """Longer than a chunk, a shard and a block: each operator reads it whole."""
    rng = np.random.default_rng(15)
    words = np.array([f"w{k}" for k in range(3000)])
    long = " ".join(rng.choice(words, 950_000))
    assert len(long) > 5_000_000
    tail = " ".join(long.split(" ")[-80:])
    plain = [(1, long), (2, tail), (3, long + " x"), (4, "password = " + long[:200].replace(" ", "q"))]
    df = spark.createDataFrame(plain, "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in exact_dedup.exact_dedup(df).collect()} == {1: True, 2: True, 3: True, 4: True}
    gone = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.substring_dedup(df).collect()}
    assert gone[1] == 0 and gone[2] == len(tail) and gone[3] == len(long)
    hit = {r["doc_id"]: r["n_hit"] for r in decontam.decontaminate(df, spark.createDataFrame([(1, tail)], "item_id long, text string")).collect()}
    n = len(brute.WORD.findall(tail))
    assert hit[1] == hit[2] == hit[3] == n
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(df).collect()} == {1: 1, 2: 2, 3: 1, 4: 4}
    from tokenizers import Tokenizer

    assert {r["doc_id"]: r["n_tokens"] for r in token_store.token_store(df, WORDS).collect()}[1] == len(Tokenizer.from_file(WORDS).encode(long, add_special_tokens=False).ids) + 1
    base = {r["doc_id"]: r["n_tokens"] for r in lm_score.lm_score(df).collect()}
    assert base[1] == 950_001
    assert "assign" in {r["doc_id"]: r["spans"] for r in secret_scan.scan(df).collect()}[4]


def test_suffix_classes():
    rng = np.random.default_rng(1)
    for length in (1, 2, 5, 8):
        text = np.concatenate(([0], rng.integers(0, 3, 400), [0]))
        got = suffix_dedup.expand_intervals(text, length)
        places = {}
        for k in range(len(text) - length + 1):
            s = tuple(text[k : k + length])
            if 0 not in s:
                assert places.setdefault(s, got[k]) == got[k]
        assert len(set(places.values())) == len(places)


def test_language_id(docs, texts, odd):
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i in got if got[i]["held_out"]} == set(held)
    assert np.mean([got[i]["lang_pred"] == lang[i] for i in held if lang[i]]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())
    model = langid.fit(docs)
    plain = {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd, model=model).collect()}
    assert [plain[i] for i in (1, 2, 9)] == ["und"] * 3 and plain[0] == "en"
    assert langid.drop_unidentified(odd, model=model).count() == len(ODD) - 3


def _parsed(text, sample):
    """Phrases of the text, each the longest that occurs in the sample."""
    n = at = 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at : at + k + 1] in sample:
            k += 1
        at, n = at + k, n + 1
    return n


def _letters(text):
    """Letters in lower case, other runs as one space; texts end with one and start without."""
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in re.sub(r"[\W\d_]+", " ", text) if c.isalpha() or c == " ").lstrip() + (" " if text and text[-1].isalpha() else "")


def test_cross_parsing():
    """Phrases are counted over whole texts, however long."""
    model = langid.Model({"x": ["abcabd"], "y": ["zzz"]})
    plain = ["abdabc", "zzzzz", "q", "abcab" * 3000, "zz abc " * 900]
    chunk = tb.of_texts([t.encode() for t in plain])
    symbols, kept, _ = model.symbols(chunk.data)
    got = model.phrases(symbols, np.append(kept[chunk.starts], len(symbols)))
    assert got.tolist() == [[_parsed(_letters(t), "abcabd "), _parsed(_letters(t), "zzz ")] for t in plain]


def test_languages_are_those_of_a_plain_parse(docs, texts):
    """The label of the least code length, in every language that is labelled."""
    rows = docs.withColumn("lang", F.when(F.col("lang").isNotNull(), F.concat("lang", (F.col("doc_id") % 40).cast("string"))))  # up to 160 labels
    model = langid.fit(rows, sample_docs=30, sample_symbols=1200)
    learnt = {r["lang"] for r in rows.filter(langid.learnable("doc_id") != 2).select("lang").distinct().collect()} - {None}
    assert set(model.langs) == learnt and len(learnt) > 64
    plain = [t[:300] for t in texts.values() if t and all(c.isascii() for c in t[:300])][:12]
    chunk = tb.of_texts([t.encode() for t in plain])
    symbols, kept, _ = model.symbols(chunk.data)
    bounds = np.append(kept[chunk.starts], len(symbols))
    text = "".join(chr(33 + x) for x in symbols.tolist())
    got, _ = model.predict(chunk)
    for n in range(len(plain)):
        own = text[bounds[n] : bounds[n + 1]]
        cost = [_parsed(own, "".join(chr(33 + x) for x in sample.tolist())) * bits for sample, bits in zip(model.samples, model.bits, strict=True)]
        assert got[n] == (model.langs[int(np.argmin(cost))] if any(c.isalpha() for c in plain[n]) else "und")


def test_nothing_to_learn(odd):
    assert {r["lang_pred"] for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_nothing_to_learn_drops_only_texts_without_letters(odd):
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert langid.drop_unidentified(unlabelled).count() == len(ODD) - 3


def test_token_store(case):
    from tokenizers import Tokenizer

    df, plain = case
    library = Tokenizer.from_file(WORDS)
    got = sorted(token_store.token_store(df, WORDS).collect(), key=lambda r: r["start"])
    ids = [-(10**9) if r["doc_id"] is None else r["doc_id"] for r in got]
    assert ids == sorted(ids) and len(got) == len(plain)
    at = 0
    want = Counter()
    for i, t in plain:
        own = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[(i, len(own), zlib.crc32(own))] += 1
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert want == Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got)


def test_ids_have_the_vocabularys_width(spark, monkeypatch):
    assert token_store.id_width(WORDS) == 2 and token_store.id_width(WORDS, end_id=70_000) == 4
    df = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    narrow, wide = (sorted(rows(token_store.token_store(df, WORDS, end_id=e), "doc_id", "n_tokens", "ids_crc32")) for e in (1, 70_000))
    assert [r[1] for r in narrow] == [r[1] for r in wide] and wide[1][2] == zlib.crc32(np.array([70_000], "<u4"))


def test_elias_fano():
    rng = np.random.default_rng(2)
    for n, most in ((0, 1), (1, 1), (1, 10**9), (1000, 10), (700, 10**6), (5000, 10**12)):
        values = np.sort(rng.integers(0, most, n))
        code = token_store.EliasFano.encode(values)
        assert np.array_equal(code.all(), values)
        assert [code.select(k) for k in range(0, n, 7)] == values[::7].tolist()
        with pytest.raises(IndexError):
            code.select(n)
        if n >= 700:
            assert 8 * (len(code.low) + len(code.high)) <= n * (3 + max(0, int(values[-1]) // n).bit_length())


def test_token_file_round_trip():
    lens = np.array([3, 0, 2])
    ids = np.arange(5, dtype="<u2")
    f = token_store.TokenFile(token_store.pack_file(np.array([7, 8, 9]), 0, lens, ids.tobytes(), 2))
    assert [f.tokens(k).tolist() for k in range(3)] == [[0, 1, 2], [], [3, 4]] and f.doc_ids.tolist() == [7, 8, 9]
    with pytest.raises(ValueError, match="token file"):
        token_store.TokenFile(b"x" * 100)


def test_pieces(case):
    import sentencepiece

    df, plain = case
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = []
    for i, t in plain:
        ids = library.encode(t or "")
        want.append((i, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(library.decode(ids))))
    same(rows(piece_codec.encode_decode(df, PIECES), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), want)


def test_piece_spans(odd):
    """Spans are in order, without gaps, and hold what the pieces show."""
    own = piece_codec.codec(PIECES)
    by_id = {i: (t or "").encode() for i, t in ODD}
    for r in piece_codec.encode(odd, PIECES).collect():
        text, at = by_id[r["doc_id"]], 0
        for piece, a, b in zip(r["ids"], r["span_starts"], r["span_ends"], strict=True):
            assert a == at or a == b
            shown = own.surface[own.surface_start[piece] : own.surface_start[piece] + own.surface_size[piece]].tobytes()
            assert text[a:b] in (shown, shown[1:]) or "▁".encode() in text
            at = b
        assert at == len(text)


def compiled_map():
    """A map compiled by hand: a double array for "ab" -> "X" and "a" -> "y"."""
    units = [0] * 1024
    pool = b"X\0y\0"

    def put(at, label, base, leaf):
        units[at] = label | (base ^ at) << 10 | (0x100 if leaf else 0)

    root = 256
    units[0] = root << 10
    a = root ^ ord("a")
    put(a, ord("a"), 512, True)
    units[512] = 0x80000000 | 2
    ab = 512 ^ ord("b")
    put(ab, ord("b"), 768, True)
    units[768] = 0x80000000 | 0
    compiled = np.array(units, "<u4").tobytes()
    return len(compiled).to_bytes(4, "little") + compiled + pool


def test_character_map():
    own = piece_codec.CharacterMap(compiled_map())
    assert own.longest(b"abc", 0) == (2, b"X") and own.longest(b"ac", 0) == (1, b"y") and own.longest(b"c", 0) is None


@pytest.mark.parametrize("prefix", [0, 1])
@pytest.mark.parametrize("strip", [0, 1])
def test_models_with_a_character_map(tmp_path, texts, prefix, strip):
    """Ids come from the normalised text as in the library, and spans point to what was normalised."""
    import sentencepiece

    with open(PIECES, "rb") as f:
        bare = piece_codec.without_normalisation(f.read())[: -2 - len(piece_codec.IDENTITY)]
    chars = compiled_map()
    size = len(chars)
    spec = b"\x0a\x01m\x12" + bytes([size & 0x7F | 0x80, size >> 7]) + chars + bytes([0x18, prefix, 0x20, strip, 0x28, 1])
    size = len(spec)
    path = tmp_path / "mapped.model"
    path.write_bytes(bare + b"\x1a" + bytes([size & 0x7F | 0x80, size >> 7]) + spec)
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    assert library.encode("ab") == library.encode("X") != library.encode("yb")
    own = piece_codec.PieceCodec(str(path))
    plain = [*(t or "" for _, t in ODD), *((t or "")[:500] for t in list(texts.values())[:60]), "", " ", "ab", " ab  aab a\n b ", "a", "cab", "é ab ▁a"]
    ids, counts, spans = own.encode(tb.of_texts([t.encode() for t in plain]))
    at = tb.offsets(counts)
    for k, t in enumerate(plain):
        assert ids[at[k] : at[k + 1]].tolist() == library.encode(t)
    k = plain.index("cab")
    covered = [(int(a), int(b)) for a, b in spans[at[k] : at[k + 1]]]
    assert covered[-1][1] == 3 and all(b in (0, 1, 3) for _, b in covered)


def test_secret_scan(case):
    df, plain = case
    want = [(i, brute.sha(brute.base_secrets(t))) for i, t in plain]
    got = secret_scan.scan(df).collect()
    same([(r["doc_id"], r["base_sha256"]) for r in got], want)
    text = dict(plain)
    for r in got:
        spans = r["spans"].split(",") if r["spans"] else []
        assert ",".join(s for s in spans if not s.startswith("guess")) == brute.base_secrets(text[r["doc_id"]])


def test_guess_cost():
    cost = secret_scan.guess_cost
    assert cost("") == 0 and cost("password") < 1 and cost("Password") < 2
    assert cost("qwertyuiop") < 4 and cost("aaaaaaaaaaaa") < 4 and cost("abcabcabcabc") < 6 and cost("20240131") < 5
    assert cost("dragon2019") < cost("xkqzpv7w3m")
    assert cost("9f86d081884c7d659a2feaa0c55ad015") > 20


def test_guess_cost_is_the_least():
    """Over all segmentations, for values made of everything that spans are for."""
    rng = np.random.default_rng(6)
    parts = ["password", "Dragon", "2019", "20240131", "31-12-1999", "qwert", "poiuy", "aaaa", "abcabcabc", "x9K", "!", "hello", "7", "Zz", "é", "123", "xyxyxy"]
    for _ in range(300):
        value = "".join(rng.choice(parts, int(rng.integers(1, 6))))
        want = brute.guess_cost(value, secret_scan.RANK, secret_scan.STEPS, secret_scan.DATES, secret_scan._char)
        assert secret_scan.guess_cost(value) == pytest.approx(want, abs=1e-9), value


def test_secret_words_are_ranked_by_all_texts(spark):
    """Words of the corpus are cheap, values in credential contexts are not learned from, however often they are copied."""
    secret = "password: qzvxkjwpfhgbmt!T4"
    plain = [(k, "international cooperation of the corporation " * 3) for k in range(50)] + [(100 + k, secret) for k in range(500)]
    df = spark.createDataFrame([*plain, (1000, "token: internationalcooperation")], "doc_id long, text string").repartition(3)
    ranks = secret_scan.learn_words(df)
    assert ranks["international"] <= 10 and "qzvxkjwpfhgbmt" not in ranks
    got = {r["doc_id"]: r["spans"] for r in secret_scan.scan(df).collect()}
    assert "guess" not in got[1000] and all("guess:10:27" in got[100 + k] for k in range(500))


def test_secret_precision_and_recall(spark, docs):
    """Random values are found, passwords of words and dates are left alone."""
    rng = np.random.default_rng(8)
    letters = np.array(list("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789+/"))
    strong = ["".join(rng.choice(letters, int(rng.integers(16, 48)))) for _ in range(200)]
    words = [w for w in secret_scan.learn_words(docs) if len(w) > 4][:300]
    weak = [f"{rng.choice(words)}{rng.integers(1950, 2024)}" for _ in range(100)] + [f"{rng.choice(words)}_{rng.choice(words)}" for _ in range(100)]
    planted = [(10**6 + k, f"some text password = {v} and more") for k, v in enumerate([*strong, *weak])]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    got = {r["doc_id"]: "guess" in r["spans"] for r in secret_scan.scan(df).filter("doc_id >= 1000000").collect()}
    found = [got[i] for i, _ in planted]
    assert np.mean(found[:200]) > 0.98 and np.mean(found[200:]) < 0.02


def test_secret_values_with_punctuation():
    """A value is whole where the pattern of assignments ends within it."""
    for value in (b"sunshine!Xk9@vQ2z", b"x8Kq2Lw9ZpT4!Xk9@vQ2z"):
        text = b"password: " + value
        assert (10, "guess", len(text)) in secret_scan.scan_text(text)


def test_secret_values_are_whole():
    """However long a value is, its span ends where it ends."""
    key = "".join(hashlib.sha512(bytes([k])).hexdigest() for k in range(4))[:420].encode()
    text = b'private_key="' + key + b'"'
    assert (13, "guess", 433) in secret_scan.scan_text(text)


def test_sharding(case):
    df, plain = case
    got = sharding.shuffle_to_shards(df, 5).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in plain)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(k, [])) for k in range(5)]
    assert max(sizes) - min(sizes) <= 1


def test_communication_matrix():
    counts = np.array([10, 0, 500, 33])
    m = sharding.communication_matrix(counts, 7, 1)
    assert (m.sum(axis=1) == counts).all() and np.ptp(m.sum(axis=0)) <= 1
    mean = np.mean([sharding.communication_matrix(counts, 7, s)[2] for s in range(200)], axis=0)
    assert np.allclose(mean, 500 / 7, atol=2.0)


@pytest.fixture(scope="session")
def items():
    return [(1, "the quick brown fox jumps over the lazy dog and runs far away from here"), (2, "One"), (3, None), (4, ""), (5, "x2y"), (6, "a a a"), (1, "lazy dog"), (12, "nothing like this anywhere")]


def test_decontamination(case, items, spark):
    df, plain = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = rows(decontam.decontaminate(df, bench), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    same(got, brute.decontaminate(plain, items))


def test_decontamination_of_the_table(docs, texts, spark, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute.decontaminate(list(texts.items()), [(r["item_id"], r["text"]) for r in bench.collect()])
    for limit in (decontam.BENCHMARK_BYTES, 3000):
        got = rows(decontam.decontaminate(docs, bench, limit=limit), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
        same(got, want)
        kept = {r["doc_id"] for r in decontam.drop_contaminated(docs, bench, limit=limit).collect()}
        assert kept == {w[0] for w in want if not w[-1]}


def test_lm_base(case):
    df, plain = case
    got = sorted(rows(lm_score.lm_score(df), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"), key=repr)
    for g, w in zip(got, sorted(brute.unigrams(plain), key=repr), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9)


def test_lm_probabilities_sum_to_one():
    """Over all next symbols of a context, whatever follows it."""
    q = np.array([0.4, 0.3, 0.2, 0.05, 0.05])
    for counts in ([5, 2, 1, 1, 0], [0, 0, 2, 0, 0], [7, 7, 7, 7, 7], [1, 1, 9, 0, 0]):
        c = np.array(counts)
        assert lm_score.smoothed(c, c.sum(), (c == 1).sum(), q).sum() == pytest.approx(1.0)


def test_lm_scores(docs):
    """Held-out texts are likelier than by the base, and the answer doesn't depend on how rows are dealt."""
    scored = lm_score.lm_score(docs).filter("held_out").collect()
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in scored)
    assert sum(r["score"] for r in scored) > sum(r["base_score"] for r in scored)
    again = {r["doc_id"]: r["score"] for r in lm_score.lm_score(docs.repartition(5)).collect()}
    assert all(again[r["doc_id"]] == r["score"] for r in scored)


def test_lm_scores_follow_the_tests(spark, texts):
    """Scores are those of a plain tree that tests every context, with copied passages, long contexts and rare ones."""
    rng = np.random.default_rng(4)
    made = [(10**6 + k, f"{rng.choice(list('abcdefgh'))} {'no yes'.split()[k % 2]} one two three {'red blue'.split()[k % 2]}") for k in range(400)]
    made += [(2 * 10**6 + k, "x " * int(rng.integers(1, 90)) + "z") for k in range(60)] + [(None, "no id here"), (5 * 10**6, None)]
    plain = [*[(i, (t or "")[:3000]) for i, t in list(texts.items())[:80]], *made]
    want, longest = brute.suffix_tree(plain, lm_score.lengths(), lm_score.STRENGTH, lm_score.DIVERGENCE)
    assert longest >= 16
    df = spark.createDataFrame(plain, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in lm_score.lm_score(df).collect()}
    assert [got[i] for i, _ in plain] == pytest.approx(want, rel=1e-4)


def test_lm_contexts_of_a_small_share(spark):
    """What is retained doesn't depend on how much else the corpus holds."""
    rare = [(k, "zq xj vw kp") for k in range(60)]
    last = []
    for filler in (1, 1_000_000):
        df = spark.createDataFrame([*rare, (10**6, "a " * filler)], "doc_id long, text string").repartition(2)
        last.append(min(r["score"] for r in lm_score.lm_score(df).filter("n_tokens = 5").collect()))
    assert abs(last[1] - last[0]) < 0.5


def test_near_dedup(case):
    df, plain = case
    got = rows(near_dedup.near_dedup(df, size=4), "doc_id", "n_shingles", "component_id", "kept")
    same(got, brute.near_dedup(plain))


def test_near_dedup_chains(spark):
    """Chains whose ends aren't alike, a group of many near copies, and short texts."""
    rng = np.random.default_rng(7)
    vocabulary = [f"w{k}" for k in range(500)]
    plain = []
    for c in range(6):
        base = list(rng.choice(vocabulary, 120))
        for k in range(8):
            plain.append((len(plain), " ".join(base)))
            base[15 * k + 3] = f"new{c}-{k}"
    base = list(rng.choice(vocabulary, 150))
    for _ in range(60):
        own = list(base)
        for j in rng.integers(0, 150, int(rng.integers(0, 6))):
            own[j] = str(rng.choice(vocabulary))
        plain.append((len(plain), " ".join(own)))
    for n in range(1, 14):
        plain += [(len(plain), " ".join(vocabulary[:n])), (len(plain) + 1, " ".join(vocabulary[: n + 1]))]
    df = spark.createDataFrame([(i + 1000 - (i % 4 == 3), t) for i, t in plain], "doc_id long, text string").repartition(4)
    own = [(i + 1000 - (i % 4 == 3), t) for i, t in plain]
    assert len({i for i, _ in own}) < len(own)  # some ids are those of two texts
    same(rows(near_dedup.near_dedup(df, size=4), "doc_id", "n_shingles", "component_id", "kept"), brute.near_dedup(own))


def test_register_estimate():
    rng = np.random.default_rng(3)
    for share in (0.5, 0.8, 0.95):
        errors = []
        for _ in range(40):
            common = rng.integers(0, 2**64, int(2000 * share), np.uint64)
            a, b = (np.unique(np.concatenate((common, rng.integers(0, 2**64, 2000 - len(common), np.uint64)))) for _ in range(2))
            (ra, fa), (rb, fb) = near_dedup.large_registers(a), near_dedup.large_registers(b)
            guess, _ = near_dedup.estimate(ra[None], fa[None], rb[None], fb[None])
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append(guess[0] - true)
        assert abs(np.mean(errors)) < 0.02


@pytest.mark.parametrize("run", [
    lambda d: exact_dedup.exact_dedup(d), lambda d: suffix_dedup.substring_dedup(d), lambda d: langid.identify(d.withColumn("lang", F.lit("en"))), lambda d: token_store.token_store(d, WORDS),
    lambda d: piece_codec.encode_decode(d, PIECES), lambda d: secret_scan.scan(d), lambda d: sharding.shuffle_to_shards(d),
    lambda d: decontam.decontaminate(d, d.select(F.col("doc_id").alias("item_id"), "text")), lambda d: lm_score.lm_score(d), lambda d: near_dedup.near_dedup(d),
])
def test_empty_tables(empty, run):
    assert run(empty).collect() == []


def test_spans_hash_alike_wherever_they_stand():
    data = np.frombuffer(b"abc abcdefghij abc abcdefghij" + b" " * tb.PAD, np.uint8).copy()
    starts, ends = tb.words(np.concatenate(([np.uint8(32)], data)), tb.NOT_SPACE)
    keys = tb.hash_spans(np.concatenate(([np.uint8(32)], data)), starts, ends - starts)
    assert keys[0] == keys[2] and keys[1] == keys[3] and keys[0] != keys[1]


def test_sha_of_nothing():
    assert brute.sha(b"") == hashlib.sha256(b"").hexdigest()


def test_exact_dedup_in_ranges(spark):
    """More rows than one filter is for: each range has its own, and no row is shuffled that needn't be."""
    df = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 4500).cast("string")).alias("text")).repartition(5)
    assert exact_dedup.ranges_for(9000, 1 << 15) == 5
    plain = [(r["doc_id"], r["text"]) for r in df.collect()]
    same(rows(exact_dedup.exact_dedup(df, max_bits=1 << 15), "doc_id", "keep_id", "group_size", "kept", "text_sha256"), brute.exact_dedup(plain))


CLASHES = ["__gone", "__sha", "__row", "_0", "_1", "_2", "_3", "_4", "_5", "page", "bitmap", "slot", "maybe", "range", "kind", "h", "a.b"]


def test_stages_with_clashing_names(spark):
    plain = [(5, "alpha beta gamma delta epsilon zeta"), (5, "other words that nobody else has here at all"), (1, "alpha beta gamma delta epsilon zeta"), (2, None), (3, ""), (None, "alpha beta gamma delta epsilon zeta")]
    df = spark.createDataFrame(plain, "doc_id long, text string")
    for k, name in enumerate(CLASHES):
        df = df.withColumn(name, F.lit(k))
    bench = spark.createDataFrame([(1, "alpha beta gamma"), (2, "nobody else")], "item_id long, text string")
    near = near_dedup.drop_near_copies(df)
    assert near.columns == df.columns
    same(rows(near, "doc_id", "text"), [plain[1], plain[2], plain[3], plain[4], plain[5]])
    copies = exact_dedup.drop_copies(df)
    assert copies.columns == df.columns
    same(rows(copies, "doc_id", "text"), [plain[0], plain[1], plain[4]])
    for limit in (1 << 20, 4):
        clean = decontam.drop_contaminated(df, bench, limit=limit)
        assert clean.columns == df.columns
        same(rows(clean, "doc_id", "text"), [plain[3], plain[4]])
    known = langid.drop_unidentified(df.withColumn("lang", F.lit("en")))
    same(rows(known, "doc_id", "text"), [p for p in plain if p[1]])


@pytest.mark.parametrize("stage", [
    lambda d, b: langid.drop_unidentified(d.withColumn("lang", F.lit("en"))).drop("lang"), lambda d, b: exact_dedup.drop_copies(d), lambda d, b: near_dedup.drop_near_copies(d),
    lambda d, b: decontam.drop_contaminated(d, b), lambda d, b: suffix_dedup.cleaned(d),
])
def test_stages_on_odd_and_empty_tables(spark, odd, empty, stage):
    bench = spark.createDataFrame([(1, "one"), (2, None)], "item_id long, text string")
    assert stage(empty, bench).collect() == []
    assert 0 < stage(odd, bench).count() <= len(ODD)


def test_near_copies_go_by_id_and_text(spark):
    """A repeated id whose other text is a near copy keeps the text that isn't."""
    a, b = "one two three four five six seven", "nothing of the kind stands in this text at all"
    df = spark.createDataFrame([(5, a), (5, b), (1, a)], "doc_id long, text string")
    same(rows(near_dedup.drop_near_copies(df), "doc_id", "text"), [(5, b), (1, a)])


def _sets(spark, sets):
    return spark.createDataFrame([(k, np.sort(np.array(s, "<u8")).tobytes()) for k, s in enumerate(sets)], "cid long, items binary")


def test_crowded_keys(spark):
    """A key of many classes in several components: each two components with a link get one, and only links come out."""
    rng = np.random.default_rng(9)
    base = [rng.integers(0, 2**63, 50, np.uint64) for _ in range(6)]
    sets, comp = [], []
    for k in range(90):
        own = base[k % 6].copy()
        own[: int(rng.integers(0, 8))] = rng.integers(0, 2**63, 1)[0]
        sets.append(np.unique(own))
        comp.append(k % 30)
    df = spark.createDataFrame([(7, k, c) for k, c in enumerate(comp)], "key long, cid long, comp long")
    got = {(r["a"], r["b"]) for r in near_dedup._crowded(df, _sets(spark, sets), 80).collect()}
    linked = lambda x, y: 100 * len(np.intersect1d(sets[x], sets[y])) >= 80 * len(np.union1d(sets[x], sets[y]))
    assert got and all(linked(a, b) for a, b in got)
    want = {(min(comp[x], comp[y]), max(comp[x], comp[y])) for x in range(90) for y in range(x) if comp[x] != comp[y] and linked(x, y)}
    assert {(min(comp[a], comp[b]), max(comp[a], comp[b])) for a, b in got} == want


def test_shingles_that_share_half_their_hash(spark):
    """Sets are compared by whole hashes."""
    high = np.uint64(7) << np.uint64(32)
    assert near_dedup.common([np.array([high + np.uint64(1), high + np.uint64(2)])], [np.array([high + np.uint64(1), high + np.uint64(3)])])[0, 0] == 1


def test_near_dedup_of_many_in_one_crowd(spark):
    """Forty components and more meet in the same keys through a shared half, beside one group of near copies."""
    rng = np.random.default_rng(12)
    words = np.array([f"v{k}" for k in range(4000)])
    head = list(rng.choice(words, 60))
    plain = []
    for k in range(70):
        tail = list(rng.choice(words, 40))
        plain.append((k, " ".join([*head, *tail])))
        if k % 2:
            tail[5] = "changed"
            plain.append((1000 + k, " ".join([*head, *tail])))
    plain += [(5000 + k, " ".join([*head, "and", str(k)])) for k in range(80)]
    df = spark.createDataFrame(plain, "doc_id long, text string").repartition(4)
    same(rows(near_dedup.near_dedup(df, size=4), "doc_id", "n_shingles", "component_id", "kept"), brute.near_dedup(plain))


def test_near_dedup_recall(spark):
    """Planted pairs just above the threshold are found."""
    rng = np.random.default_rng(13)
    words = np.array([f"v{k}" for k in range(20000)])
    plain = []
    for k in range(600):
        n = int(rng.integers(60, 900))
        own = list(rng.choice(words, n))
        plain.append((2 * k, " ".join(own)))
        for j in np.linspace(3, n - 4, max(1, int(n * 0.024))).astype(int):  # each change costs up to four shingles
            own[j] = f"c{k}-{j}"
        plain.append((2 * k + 1, " ".join(own)))
    pairs = [(a[0], b[0]) for a, b in zip(plain[::2], plain[1::2], strict=True) if 100 * len((x := brute.shingles(a[1], 4)) & (y := brute.shingles(b[1], 4))) >= 80 * len(x | y)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(spark.createDataFrame(plain, "doc_id long, text string"), size=4).collect()}
    assert len(pairs) > 300
    assert np.mean([got[b] == a for a, b in pairs]) >= 0.99
