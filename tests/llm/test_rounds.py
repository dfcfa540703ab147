import numpy as np
import pyarrow as pa

from lacuna.llm import blocks as bl
from lacuna.llm import lm_score
from lacuna.llm import textbytes as tb


def test_texts_are_read_once(tmp_path, monkeypatch):
    """The step that sends words keeps the tokens, and the base figures are made of them."""
    folder = f"file://{tmp_path}/tokens"
    texts = tb.of_texts([b"A b a c", None, b"", b"x " * 50])
    want = lm_score.Tokens.read(texts)
    row = pa.RecordBatch.from_pylist([bl.packed(3, texts) | {"further": []}])
    (sent,) = lm_score._send_words([row], parts=1, folder=folder)
    monkeypatch.setattr(lm_score.Tokens, "read", None)
    got = lm_score._combine_words(pa.Table.from_batches([sent])).to_pylist()
    (answers,) = [r["answers"] for r in got if r["block"] == 3]
    told = pa.RecordBatch.from_arrays([pa.array([3]), pa.array([f"{folder}/3".encode()]), pa.array([[answers]], pa.list_(pa.binary()))], names=["block", "data", "answers"])
    (rows,) = lm_score._begin([told], tokens_in_all=58, distinct=5, size=1, folder=f"file://{tmp_path}/states")
    assert {r["block"] for r in rows.to_pylist()} == {3}
    kept = lm_score.Tokens.load((tmp_path / "tokens" / "3").read_bytes())
    for name in ("ids", "null", "train", "counts", "held", "distinct", "of", "keys", "scored", "text"):
        assert getattr(kept, name).tolist() == getattr(want, name).tolist(), name


def test_rounds_take_as_many_tasks_as_their_states_fill():
    """A round whose states are small isn't dealt over all ranges, and none over more."""
    assert [lm_score.parts_of_round(held, 48) for held in (1, 8 << 20, (8 << 20) + 1, 80 << 20, 8 << 30)] == [1, 1, 2, 10, 48]


def test_hashes_travel_in_fewer_bytes():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 5000):
        keys = np.sort(rng.integers(0, 1 << 64, n, np.uint64, endpoint=False))
        columns = rng.integers(0, 3, n), rng.integers(-5, 1 << 40, n)
        packed = bl.squeeze_hashes(keys, *columns)
        assert [x.tolist() for x in bl.expand_hashes(packed, 2)] == [x.tolist() for x in (keys, *columns)]
    few = keys[-1] - np.arange(300, dtype=np.uint64)[::-1]
    assert bl.expand_hashes(bl.squeeze_hashes(few), 0)[0].tolist() == few.tolist()
    assert len(bl.squeeze_hashes(keys)) < len(bl.squeeze(keys))


def test_sums_travel_as_what_sets_them_apart():
    """Whole numbers come back as they were; for contexts with one n-gram two of the four are 0 or a rounding from it."""
    rng = np.random.default_rng(6)
    c = rng.integers(2, 1000, (3, 400)) * (rng.random((3, 400)) < [[0.8], [0.3], [0.1]])
    q = rng.random((3, 400)) * 0.1 + 1e-6
    seen = np.log((np.maximum(c - 1, 0) + lm_score.STRENGTH * q) / q)
    terms = np.stack((c, *(np.rint(c * x * lm_score.FINE).astype(np.int64) for x in (seen, seen - np.log(np.maximum(c - 1, 0) + lm_score.STRENGTH), np.log(np.maximum(c, 1))))))
    sums = terms.sum(axis=1)
    sent = lm_score._apart(sums)
    assert np.stack(lm_score._together(*sent)).tolist() == sums.tolist()
    assert sent[2:, (c > 0).sum(axis=0) < 2].max() <= 2
