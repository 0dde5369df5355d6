"""Registered queries of the operators that learn from or join the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import embed_join, gru_lm, langid, shingle_join, substring
from tidepool.llm.common import table
from tidepool.llm.registry import register

FOLDS, HELD = 4, 2


@register("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    remainder = langid.fold(F.col("doc_id"), FOLDS)
    prototypes = langid.learn(docs.where(remainder != HELD))
    return (langid.predict(docs.select("doc_id", "text"), prototypes)
            .select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder == HELD, F.lit(False)).alias("held_out"), "lang_pred", "score"))


OP3_SQL = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s FROM doc),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS i
        FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM met WHERE 100 * i >= 85 * (nx + ny - i) UNION SELECT y, x FROM met WHERE 100 * i >= 85 * (nx + ny - i)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM sets UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x)
SELECT CAST(sets.doc_id AS BIGINT) AS doc_id, CAST(len(s) AS BIGINT) AS n_shingles, CAST(c.component_id AS BIGINT) AS component_id
FROM sets JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = sets.doc_id
"""


@register("op3_ngram_jaccard", sql=OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


@register("op6_repeated_passages")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(table(spark, sf_dir, "documents", "doc_id", "text"))


OP8_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
       AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
         WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x),
part AS (SELECT x, min(y) AS c FROM reach GROUP BY x),
deg AS (SELECT x, count(*) AS n FROM link GROUP BY x)
SELECT CAST(v.vec_id AS BIGINT) AS vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, CAST(c AS BIGINT) AS component_id, v.vec_id = c AS kept
FROM v JOIN part ON part.x = v.vec_id LEFT JOIN deg ON deg.x = v.vec_id
"""


@register("op8_embedding_duplicates", sql=OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_join.near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


@register("op9_gru_scores")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.language_model_scores(table(spark, sf_dir, "documents", "doc_id", "text"))
