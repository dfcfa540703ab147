"""The queries of this subpackage: thin calls of the operators with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lacuna.llm import decontam, exact_dedup, langid, lm_score, near_dedup, piece_codec, secret_scan, sharding, suffix_dedup, token_store


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.substring_dedup(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_store(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shuffle_to_shards(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_score(_table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_table(spark, sf_dir, "documents"), size=4, threshold=80)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express; the others are tested against plain versions."""
    return {"op1_exact_dedup": OP1_SQL, "op2_suffix_dedup": OP2_SQL, "op8_decontamination": OP8_SQL, "op10_near_dedup": OP10_SQL}


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = f"""
WITH h AS (SELECT doc_id, sha256({_LOW}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM h GROUP BY text_sha256)
SELECT h.doc_id, g.keep_id, g.group_size, h.doc_id = g.keep_id AS kept, h.text_sha256
FROM h JOIN g ON h.text_sha256 = g.text_sha256
"""

OP2_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
p AS (SELECT doc_id, n, i, substr(h, 128 * i + 1, 226) AS h FROM (SELECT doc_id, h, n, unnest(range(0, (n + 63) // 64)) AS i FROM d)),
b AS (SELECT doc_id, n, 64 * i + j AS k, substr(h, 2 * j + 1, 2) AS byte, substr(h, 2 * j + 1, 100) AS s FROM (SELECT doc_id, n, i, h, unnest(range(0, 64)) AS j FROM p) WHERE 64 * i + j < n),
first AS (SELECT s, min(doc_id) AS m FROM b WHERE k <= n - 50 GROUP BY s HAVING count(*) > 1),
cut AS (SELECT b.doc_id, b.k FROM b JOIN first ON first.s = b.s WHERE b.k <= b.n - 50 AND first.m < b.doc_id),
last AS (SELECT b.doc_id, b.k, b.byte, max(cut.k) OVER (PARTITION BY b.doc_id ORDER BY b.k) AS c FROM b LEFT JOIN cut ON cut.doc_id = b.doc_id AND cut.k = b.k),
gone AS (SELECT doc_id, k, byte, coalesce(k - c < 50, false) AS gone FROM last),
edge AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY k), false) AS starts FROM gone),
t AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS r, count(*) FILTER (WHERE starts) AS p, string_agg(byte, '' ORDER BY k) FILTER (WHERE NOT gone) AS kept FROM edge GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(t.r, 0) AS n_removed, coalesce(t.p, 0) AS n_spans, sha256(unhex(coalesce(t.kept, ''))) AS kept_sha256
FROM d LEFT JOIN t ON t.doc_id = d.doc_id
"""

_WORDS = f"regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP8_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bs AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS s FROM bs),
ds AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
hit AS (SELECT x.doc_id, x.k, x.n, win.item_id FROM (SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS s FROM ds) x JOIN win ON win.n = x.n AND win.s = x.s),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS j FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l FROM (SELECT DISTINCT doc_id, item_id::varchar AS i FROM hit) GROUP BY doc_id),
spans AS (SELECT doc_id, count(*) AS n_spans FROM (SELECT doc_id, j, lag(j) OVER (PARTITION BY doc_id ORDER BY j) AS p FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS j FROM hit)) WHERE p IS NULL OR p < j - 1 GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated, coalesce(n_spans, 0) AS n_spans
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id LEFT JOIN spans ON spans.doc_id = d.doc_id
"""

OP10_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(doc_id, to_id) AS (SELECT x, y FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.to_id),
m AS (SELECT doc_id, min(to_id) AS t FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.t, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(m.t, d.doc_id)) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""
