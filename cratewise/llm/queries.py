"""One query for each operator, over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cratewise.llm import alignment, byte_bpe, decontaminate, forest, line_dedup, privacy, quality, secrets, set_join, spelling, token_shards, toxicity, winnowing
from cratewise.llm.common import fold, read

END_ID = 2


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_shards.scratch_path(spark)
    token_shards.write(read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return token_shards.read_back(spark, path)


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_edited(read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, remainder = read(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5)
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), remainder != 0)
    return toxicity.score(docs, model).select("doc_id", (remainder == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, remainder = read(spark, sf_dir, "documents").select("doc_id", "text"), fold(F.col("doc_id"), 4)
    network = quality.fit(docs, read(spark, sf_dir, "labels"), remainder != 2)
    return quality.score(docs, network).select("doc_id", (remainder == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.links(read(spark, sf_dir, "documents"), words=4, numerator=85, denominator=100)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove(read(spark, sf_dir, "documents"), report=True)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.report(read(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]


def op13_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
l AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS c FROM e x JOIN e y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY 1, 2) p WHERE 100 * c >= 85 * (na + nb - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT doc_id, len(g)::BIGINT AS n_shingles, component_id, coalesce(n_links, 0)::BIGINT AS n_links FROM s JOIN c ON doc_id = c.a LEFT JOIN k ON doc_id = k.a
"""


OP6_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, s.size, i, array_to_string(w[i : i + s.size - 1], ' ') AS win
  FROM (SELECT doc_id, w, s.size, unnest(range(1, len(w) - s.size + 2)) AS i FROM w, (SELECT DISTINCT size FROM bw) s) s),
m AS (SELECT DISTINCT doc_id, i, dw.size, item_id FROM dw JOIN bw USING (win)),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS p FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM m) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


OP7_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, text, l, list_transform(l, lambda x: len(regexp_extract_all(x, '\S+'))) AS w FROM d),
s AS (SELECT doc_id, l, w, unnest(range(1, len(l) + 1)) AS i FROM w),
e AS (SELECT doc_id, l, i, list_position(list_transform(range(i, len(w) + 1), lambda j: list_sum(w[i : j]) >= 20), true) AS m FROM s WHERE w[i] > 0),
r AS (SELECT doc_id, i, m, array_to_string(l[i : i + m - 1], chr(10)) AS run FROM e WHERE m > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY m, run ORDER BY doc_id, i) AS k FROM r),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS p FROM o WHERE k > 1),
n AS (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS island FROM g),
u AS (SELECT doc_id, min(p) AS p, count(*) AS c FROM n GROUP BY doc_id, island),
x AS (SELECT doc_id, sum(c) AS n_deleted, string_agg((p - 1) || ':' || c, ',' ORDER BY p) AS runs FROM u GROUP BY doc_id),
t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM (SELECT doc_id, i, l[i] AS line FROM s) ANTI JOIN (SELECT doc_id, p AS i FROM g) USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(d.l)::BIGINT AS n_lines, coalesce(n_deleted, 0)::BIGINT AS n_deleted, coalesce(runs, '') AS runs, coalesce(t.text, '') AS text
FROM d LEFT JOIN x USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    first = (op1_token_shards, op2_winnowing, op3_toxicity, op4_quality, op5_set_join, op6_decontaminate, op7_line_dedup, op8_byte_bpe, op9_privacy, op10_secrets)
    return {f.__name__: f for f in (*first, op11_spelling_variants, op12_token_alignment, op13_nearest_vectors)}


def oracle_sql() -> dict[str, str]:
    return {"op5_set_join": OP5_SQL, "op6_decontaminate": OP6_SQL, "op7_line_dedup": OP7_SQL}
