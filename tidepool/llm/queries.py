"""The registered queries of this package; each applies its operator to the
whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import bpe_index, bpe_rank, decontam, license, warc
from tidepool.llm.common import table, tokenizer_file
from tidepool.llm.registry import register
from tidepool.session import scratch_path


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_KNOWN = "MAP {" + ", ".join(f"{_text(k)}: {_text(v)}" for k, v in license.SENTENCES.items()) + "}"
_NAMES = "[" + ", ".join(_text(n) for n, _ in license.RULES) + "]"


def _rules_sql(seq: str) -> str:
    for k, (_, rule) in enumerate(license.RULES):
        seq = f"replace({seq}, {_text(''.join(f'<{i}>' for i in rule))}, '[{k}]')"
    return seq


OP2_SQL = f"""
WITH cut AS (
  SELECT doc_id, list_filter(list_transform(
    string_split_regex(regexp_replace(coalesce(text, ''), {_text(license.SPDX)}, E'\\n\\n\\\\1\\n\\n', 'g'), {_text(license.BOUNDARY)}),
    lambda s: trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))), lambda s: s <> '') AS s FROM documents),
known AS (SELECT {_KNOWN} AS k),
ids AS (SELECT doc_id, len(s) AS n, list_filter(list_transform(s, lambda x: k[x]), lambda i: i IS NOT NULL) AS ids FROM cut, known),
seq AS (SELECT *, {_rules_sql("array_to_string(list_transform(ids, lambda i: '<' || i || '>'), '')")} AS seq FROM ids)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(n AS BIGINT) AS n_sentences, CAST(len(ids) AS BIGINT) AS n_known,
  coalesce(array_to_string(ids, ','), '') AS sentence_ids,
  coalesce(array_to_string(list_transform(regexp_extract_all(seq, '\\[(\\d+)\\]', 1), lambda k: {_NAMES}[CAST(k AS INT) + 1]), ','), '') AS licences,
  CAST(len(regexp_extract_all(seq, '<(\\w+)>', 1)) AS BIGINT) AS n_unmatched
FROM seq
"""


@register("op2_license_scan", sql=OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license.scan_licences(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_sentences", F.size("sentence_ids").cast("long").alias("n_known"),
                        F.array_join("sentence_ids", ",").alias("sentence_ids"),
                        F.array_join("licences", ",").alias("licences"), "n_unmatched")


@register("op4_bpe_roundtrip")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_index.encode_decode(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_file("word_bpe_49k.json"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


_WORDS_SQL = r"list_filter(string_split_regex(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda w: w <> '')"

OP5_SQL = f"""
WITH doc AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
item AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
win AS (
  SELECT item_id, len(w) AS m, array_to_string(w, ' ') AS g FROM item WHERE len(w) BETWEEN 1 AND 9
  UNION ALL
  SELECT item_id, 10, array_to_string(w[i:i + 9], ' ') FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS i FROM item WHERE len(w) >= 10)),
lens AS (SELECT DISTINCT m FROM win),
gram AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
         FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM doc, lens WHERE len(w) >= m)),
found AS (SELECT DISTINCT gram.doc_id, gram.m, gram.i, win.item_id FROM gram JOIN win ON gram.m = win.m AND gram.g = win.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM found) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT CAST(doc.doc_id AS BIGINT) AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@register("op5_benchmark_hits", sql=OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_items(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@register("op7_token_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = bpe_rank.count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_file("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


OP10_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h) END AS first FROM d)
SELECT CAST(page_id AS BIGINT) AS page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN CAST(first AS BIGINT) END AS refers_to
FROM f
"""


@register("op10_warc_roundtrip", sql=OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


from tidepool.llm import corpus_queries, join_queries  # noqa: E402,F401 - register the other queries
