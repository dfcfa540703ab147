import numpy as np
import pyarrow as pa

from lacuna.llm import lm_score
from lacuna.llm import textbytes as tb


def test_states_stay_in_files(tmp_path):
    """What a round passes on for a block is the path of its state; the next step reads the same state from there."""
    tokens = lm_score.Tokens.read(tb.of_texts([b" ".join(b"w%d" % (k % 700) for k in range(5000))]))
    tokens.base = np.arange(len(tokens.distinct))
    n = len(tokens.of)
    state = lm_score.State(tokens, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1), np.ones(n, bool), tokens.scored, tokens.base[tokens.of[tokens.scored]])
    rows = state.rows(7, tokens.scored, 1, 0)
    (want,) = [r["data"] for r in rows.to_pylist() if r["kind"] == "live"]
    kept = lm_score._kept(rows, f"file://{tmp_path}/states")
    (live,) = [r for r in kept.to_pylist() if r["kind"] == "live"]
    assert len(live["data"]) < 500 < len(want)
    ((block, got),) = lm_score._read([pa.RecordBatch.from_pylist([{"block": live["block"], "data": live["data"]}])])
    assert block == 7 and got.dump() == want
    assert [p.name for p in (tmp_path / "states").iterdir()] == ["7"]
