import gc

import numpy as np
import pyarrow as pa

from lacuna.llm import blocks as bl
from lacuna.llm import lm_score
from lacuna.llm import textbytes as tb


def block(texts: list[bytes]) -> pa.RecordBatch:
    row = bl.packed(0, tb.of_texts(texts))
    return pa.RecordBatch.from_pylist([row | {"further": []}] * 2)


def test_steps_hold_no_block_that_is_done():
    batch = block([b"a b c d", b"b c d e"])
    steps = lm_score._send_words([batch], parts=2)
    for _ in range(2):
        next(steps)
        assert not [x for x in gc.get_objects() if isinstance(x, lm_score.Tokens)]


def test_states_hold_the_stretches_that_contexts_can_reach():
    """Of a long text with one stretch that goes on, the rest is left out, and the keys of the contexts stay."""
    words = [b"w%d" % k for k in range(1000)]
    tokens = lm_score.Tokens.read(tb.of_texts([b" ".join(words), b"x y"]))
    tokens.base = np.arange(len(tokens.distinct))
    n = len(tokens.of)
    repeated = np.zeros(n, bool)
    repeated[300:320] = True
    still = np.zeros(n, bool)
    still[300:320] = True
    state = lm_score.State(tokens, np.zeros(2, np.int64), np.zeros(2, np.int64), np.zeros(2), repeated, still, tokens.base[tokens.of[still]])
    want = tokens.before(np.arange(304, 320), 4)
    (live,) = [r["data"] for r in state.rows(0, still.copy(), 4, 3).to_pylist() if r["kind"] == "live"]
    left = lm_score.State.load(live)
    assert len(left.tokens.of) < 30 and left.tokens.counts.tolist() == [1002]
    places, contexts, _, _ = left.asked(4)
    assert set(contexts.tolist()) <= set(tokens.before(np.arange(298, 320), 4).tolist()) and set(want.tolist()) <= set(contexts.tolist())


def test_numbers_travel_in_the_bytes_they_need():
    for values in ([], [0, 0], [1, 255], [256, 1 << 40], [-1, 3], [np.iinfo(np.int64).min, np.iinfo(np.int64).max]):
        values = np.array(values, np.int64)
        assert bl.numbers_in(bl.numbers_out(values)).tolist() == values.tolist()
        keys = np.sort(values.view(np.uint64))
        got = bl.expand(bl.squeeze(keys, values, values + 1), 2)
        assert [g.tolist() for g in got] == [keys.tolist(), values.tolist(), (values + 1).tolist()]
    assert len(bl.numbers_out(np.arange(200))) < 300
