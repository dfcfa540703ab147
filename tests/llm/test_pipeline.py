"""The pipeline against the plain versions of its stages, each on what the one before kept."""

import public_tokenizers
import sentencepiece

import corpus_pipeline
from lacuna.llm import langid

from . import brute


def test_pipeline(spark, sf, docs, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = sorted((i, t) for i, t in texts.items() if any(c.isalpha() for c in t or ""))
    rows = [r for r, d in zip(rows, brute.exact_dedup(rows), strict=True) if d[3]]
    rows = [r for r, d in zip(rows, brute.near_dedup(rows, 5), strict=True) if d[3]]
    rows = [r for r, d in zip(rows, brute.decontaminate(rows, bench), strict=True) if not d[5]]
    want = []
    for i, t in rows:
        ids = library.encode(t)
        want.append((i, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(library.decode(ids))))
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, sf).collect()]
    assert sorted(got) == sorted(want)


def test_stages_keep_the_columns(spark, sf, docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
    assert langid.UNKNOWN == "und"
