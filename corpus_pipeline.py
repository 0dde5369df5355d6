"""A training corpus from the documents table, in five stages.

Each stage takes the documents that its predecessor kept, and all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import bpe_index, decontam, langid, shingle_join, substring
from tidepool.llm.common import free_name, saved, small, tokenizer_file
from tidepool.llm.join_queries import FOLDS, HELD
from tidepool.operators.split import global_rank

#: A text whose cosine with every learnt language is not above this is
#: rejected.  The cosine of unrelated text is noise of about 0.03, of clean text
#: of 30 letters 0.2 and more; shorter texts have proportionally less to reach.
MIN_LANGUAGE_SCORE = 0.1
SURE_LETTERS = 30


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without a letter, and those that
    resemble none, go.  Letters of different words count, so that a word that
    stands many times does not make a text long.  If nothing can be learnt, all
    texts with a letter stay.  Learns from the labelled documents of the
    training folds."""
    prototypes = langid.learn(docs.where(langid.fold(F.col("doc_id"), FOLDS) != HELD))
    if not prototypes:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    lang, score = free_name(docs, "lang_pred"), free_name(docs, "score")
    found = langid.predict(docs, prototypes, lang_out=lang, score_out=score)
    letters = F.length(F.array_join(F.array_distinct(F.split(F.lower("text"), r"\P{L}+")), ""))
    enough = F.least(letters / SURE_LETTERS, F.lit(1.0)) * MIN_LANGUAGE_SCORE
    # letters are looked at only where the score is low
    alike = (F.col(score) > MIN_LANGUAGE_SCORE) | (F.col(score) > enough)
    return found.where((F.col(lang) != langid.UNKNOWN) & alike).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest
    id (of rows that share an id, the first by a hash of the text).  Rows that
    share an id are documents like others: different texts stay, equal ones are
    near-duplicates.  Documents without words or with a null id stay."""
    key, row = free_name(docs, "_key"), free_name(docs, "_row")
    twice = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if twice.isEmpty():
        ids, rows = "doc_id", docs
    else:  # ids by which rows can be told apart, in the order of doc_id
        ids = row
        rows = saved(global_rank(docs, F.col("doc_id"), F.xxhash64("text"), out=row).withColumn(row, F.when(F.col("doc_id").isNotNull(), F.col(row))), "numbered")
    groups = shingle_join.near_duplicates(rows, doc_id=ids).where("doc_id is not null")
    gone = saved(groups.where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct(), "gone")
    return rows.join(small(gone), F.col(ids) == F.col(key), "left_anti").select(docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more stay only where they stand first."""
    return substring.drop_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut; documents made of them go."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet").select("item_id", "text"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` and the decoded text of each document."""
    coded = bpe_index.encode_decode(docs, tokenizer_file("word_bpe_49k.json"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("benchmark_decontamination", decontaminate),
    ("bpe_encoding", encode),
]

#: SQL cannot express the learnt, the near-duplicate and the BPE stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``, each written to the
    checkpoint folder and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
