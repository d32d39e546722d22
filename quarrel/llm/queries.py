"""The operators of this subpackage on the driver's tables, with production parameters and whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrel.llm import licenses, minhash, mixing, neardup_vectors, packing, pii, quality, substring, tokenfile, topk
from quarrel.llm.common import scratch_dir
from quarrel.llm.tokens import vocabulary


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op2_tiered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1, words=True)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch_dir(spark)}/token-files-{uuid.uuid4().hex}"
    tokenfile.write(_table(spark, sf_dir, "documents"), folder, vocabulary("byte_bpe_50k.json"), end_id=0)
    return tokenfile.digests(spark, folder)


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.takes(_table(spark, sf_dir, "documents"))


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op1 that SQL can express."""
    return pii.find(_table(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op4 that SQL can express."""
    return mixing.takes(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target")


def op5_substring_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(_table(spark, sf_dir, "documents"))


def op6_license_patience(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licensed(_table(spark, sf_dir, "documents"))


def op7_embedding_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup_vectors.links(_table(spark, sf_dir, "embeddings"))


def op8_cover_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top(_table(spark, sf_dir, "embeddings"))


def op9_tensor_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(_table(spark, sf_dir, "documents"), percent=85)


def op10_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_pii_crf, op2_tiered_packing, op3_token_files, op4_source_mix, op5_substring_automata, op6_license_patience, op7_embedding_codes, op8_cover_tree_topk, op9_tensor_minhash, op10_nbsvm_quality)
    return {f.__name__: f for f in ops} | {"pipeline": _pipeline, "mix_targets": mix_targets, "pii_counts": pii_counts}


def oracle_sql() -> dict[str, str]:
    """What SQL can express. op2, op3, op6, op10 and the pipeline depend on a tokenizer, an alignment or a model, op4's copies on a hash draw, and the
    places of op1's spans on searches that give places; tests/llm hold those against brute force, and SQL the parts mix_targets and pii_counts."""
    return {"op5_substring_automata": _OP5, "op7_embedding_codes": _OP7, "op8_cover_tree_topk": _OP8, "op9_tensor_minhash": _OP9, "mix_targets": mixing.TARGETS_SQL, "pii_counts": _PII}


_OP5 = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
k AS (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35),
win AS (SELECT r, i, array_to_string(list_slice(ws, i, i + 34), ' ') AS key FROM k),
dup AS (SELECT key FROM win GROUP BY key HAVING count(*) > 1), d AS (SELECT r, i FROM win WHERE key IN (SELECT key FROM dup)),
f AS (SELECT t.r, t.i, word, max(CASE WHEN d.i IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY t.r ORDER BY t.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM t LEFT JOIN d ON d.r = t.r AND d.i = t.i),
s AS (SELECT r, sum(gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM f GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN s ON s.r = w.r
"""

_OP7 = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
n AS (
  SELECT r, vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (SELECT a.r AS a, b.r AS b FROM n a JOIN n b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
c AS (SELECT r AS id, r AS x FROM v UNION SELECT c.id, l.b FROM c JOIN l ON l.a = c.x),
m AS (SELECT c.id, min(v.vec_id) AS component_id FROM c JOIN v ON v.r = c.x GROUP BY c.id), k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN m ON m.id = v.r LEFT JOIN k ON k.a = v.r
"""

_OP9 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM w WHERE len(ws) > 0),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS g FROM p), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
s AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM s JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
c AS (SELECT doc_id AS id, doc_id AS x FROM w UNION SELECT c.id, l.b FROM c JOIN l ON l.a = c.x), m AS (SELECT id, min(x) AS component_id FROM c GROUP BY id)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w JOIN m ON m.id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""

_PII = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS e, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS i,
  regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+') AS c, regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]') AS p FROM d),
g AS (SELECT doc_id, e, list_filter(i, lambda x: len(list_filter(string_split(x, '.'), lambda y: length(ltrim(y, '0')) > 3 OR ('0' || right(ltrim(y, '0'), 3))::INTEGER > 255)) = 0) AS i,
  list_filter(list_transform(c, lambda x: reverse(regexp_replace(x, '[^0-9]', '', 'g'))), lambda x: length(x) BETWEEN 14 AND 19) AS c, list_filter(p, lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 10 AND 15) AS p FROM f)
SELECT doc_id, len(e)::BIGINT AS n_email, len(i)::BIGINT AS n_ip,
  len(list_filter(c, lambda x: list_sum(list_transform(range(1, length(x) + 1), lambda k: CASE WHEN k % 2 = 1 THEN x[k]::INTEGER ELSE x[k]::INTEGER * 2 - 9 * (x[k]::INTEGER > 4)::INTEGER END)) % 10 = 0))::BIGINT AS n_card, len(p)::BIGINT AS n_phone FROM g
"""

_OP8 = """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM ok q JOIN ok c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
