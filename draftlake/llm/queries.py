"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftlake.llm.common import table


def op1_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from draftlake.llm.sharding import assign_shards

    return assign_shards(table(spark, sf_dir, "documents"), 24)


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from draftlake.llm.packing import digest_pieces, pack

    return digest_pieces(pack(table(spark, sf_dir, "documents")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from draftlake.llm.line_dedup import dedup_lines

    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from draftlake.llm.wfst import decode_ids, digest, encode_texts

    return digest(decode_ids(encode_texts(table(spark, sf_dir, "documents"))))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from draftlake.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), 5, 50)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from draftlake.llm.quality import resample

    scored = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.round("log_weight", 6).alias("log_weight"), F.round("gumbel_key", 6).alias("gumbel_key"), "accepted")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from draftlake.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), 10, 100)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from draftlake.llm.langid import identify

    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from draftlake.llm.toxicity import grade_toxicity

    graded = grade_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return graded.select("doc_id", F.round("expected_severity", 6).alias("expected_severity"), "is_toxic")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from draftlake.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from draftlake.llm.prefix_trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"), rebuilt=True)


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from draftlake.llm.substrings import dedup_substrings

    kept = dedup_substrings(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", F.col("n_removed").cast("long").alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from draftlake.llm.runs import digest_runs, periodic_runs, with_planted_tail

    return digest_runs(periodic_runs(table(spark, sf_dir, "documents"), change=with_planted_tail))


OP3_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT doc_id, pos, list_extract(parts, pos) AS line
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos
        FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM docs))),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
owners AS (SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k),
marked AS (
  SELECT doc_id, pos, line, coalesce(owner < doc_id, false) AS dropped
  FROM keyed LEFT JOIN owners ON keyed.k = owners.k AND length(keyed.k) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP5_SQL = r"""
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM rows q JOIN rows c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""


# crc32 of a decimal: its bytes in turn, each followed by eight shifts
OP11_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, sha256(length(role) || ':' || role || text) AS t, length(text) AS cp,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS i
  FROM turns),
steps AS (
  SELECT conv_id, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])) AS s
  FROM (SELECT DISTINCT conv_id FROM turns)),
convs AS (
  SELECT conv_id, xor(4294967295, list_reduce(list_prepend(4294967295, s), lambda a, x:
           CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) % 6 AS h
  FROM steps),
rebuilt AS (
  SELECT c.conv_id, o.t, o.cp, o.i, 0 AS late FROM convs c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 100 AND o.i <= c.h
  UNION ALL
  SELECT c.conv_id, o.t, o.cp, o.i, 1 FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.i > c.h),
numbered AS (SELECT conv_id, t, cp, row_number() OVER (PARTITION BY conv_id ORDER BY late, i) AS depth FROM rebuilt),
lens AS (SELECT c.conv_id, coalesce(max(n.depth), 0) AS len FROM convs c LEFT JOIN numbered n USING (conv_id) GROUP BY c.conv_id),
prefixes AS (
  SELECT conv_id, depth, cp, string_agg(t, '') OVER (PARTITION BY conv_id ORDER BY depth) AS key FROM numbered
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM convs),
nodes AS (
  SELECT key, any_value(p.depth) AS depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(cp) AS cp,
         sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (WHERE p.depth = l.len), '')) AS ends_sha256
  FROM prefixes p JOIN lens l USING (conv_id) GROUP BY key),
children AS (SELECT key[: 64 * (depth - 1)] AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
above AS (
  SELECT key[: 64 * up] AS key, sum((n_convs - 1) * cp)::BIGINT AS saved,
         sum(CASE WHEN leaf THEN 1 ELSE 0 END)::BIGINT AS leaves
  FROM (SELECT n.*, c.n IS NULL AS leaf, unnest(range(0, n.depth + 1)) AS up FROM nodes n LEFT JOIN children c USING (key)) GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children,
       a.leaves AS n_leaves, a.saved AS saved_tokens, n.ends_sha256
FROM nodes n JOIN above a USING (key) LEFT JOIN children c USING (key)
LEFT JOIN nodes p ON n.depth > 0 AND p.key = n.key[: 64 * (n.depth - 1)]
"""

OP12_SQL = r"""
WITH docs AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM docs),
windows AS (SELECT doc_id, i, md5(array_to_string(words[i : i + 12], ' ')) AS k FROM starts),
owners AS (SELECT k, min(doc_id) AS owner FROM windows GROUP BY k),
covered AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM windows JOIN owners USING (k) WHERE owner < doc_id),
placed AS (SELECT doc_id, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS i FROM docs),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS text FROM placed ANTI JOIN covered USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""


QUERIES = {f.__name__: f for f in (op1_shard, op2_pack, op3_line_dedup, op4_sentencepiece, op5_topk, op6_quality, op7_ann, op8_langid, op9_toxicity, op10_simhash, op11_trie, op12_substrings, op13_runs)}


def queries() -> dict:
    """All queries; ``pipeline`` is corpus_pipeline.py at the repository top."""
    return QUERIES | {"pipeline": importlib.import_module("corpus_pipeline").run}


def oracle_sql() -> dict[str, str]:
    whole = importlib.import_module("corpus_pipeline").ORACLE_SQL
    return {"op3_line_dedup": OP3_SQL, "op5_topk": OP5_SQL, "op11_trie": OP11_SQL, "op12_substrings": OP12_SQL} | ({"pipeline": whole} if whole else {})
