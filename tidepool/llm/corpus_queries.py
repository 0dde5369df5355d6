"""Registered queries of the operators that take statistics of the corpus or
describe it: personal data, token alignment, the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import align, merkle, sanitise
from tidepool.llm.common import table, tokenizer_file
from tidepool.llm.registry import register


def _field_sql(c: str) -> str:
    return f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(map(_field_sql, ("doc_id", "source", "lang", "n_chars", text))) + ")"


#: crc32 of the decimal doc_id: a byte is xor-ed in, then eight steps follow
_CRC_SQL = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
  lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS BIGINT)) ELSE c // 2 END), CAST(4294967295 AS BIGINT))"""


def _tree_sql(name: str, rows: str) -> str:
    """The levels over ``rows`` (g, p, m, d), and the siblings on each."""
    return f"""{name}(g, lev, p, m, d) AS (
  SELECT g, 0, p, m, d FROM {rows}
  UNION ALL
  SELECT g, lev + 1, p // 3, (m + 2) // 3, sha256(string_agg(d, '' ORDER BY p)) FROM {name} WHERE m > 1 GROUP BY g, lev, p // 3, m),
{name}_own AS (SELECT a.g, a.p AS leaf_p, n.lev, n.p FROM {rows} a JOIN {name} n ON n.g = a.g AND n.m > 1 AND n.p = a.p // CAST(3 ** n.lev AS BIGINT)),
{name}_step AS (SELECT o.g, o.leaf_p, o.lev, coalesce(string_agg(s.d, '' ORDER BY s.p) FILTER (s.p < o.p), '') || '|' ||
    coalesce(string_agg(s.d, '' ORDER BY s.p) FILTER (s.p > o.p), '') AS step
  FROM {name}_own o JOIN {name} s ON s.g = o.g AND s.lev = o.lev AND s.p // 3 = o.p // 3 GROUP BY o.g, o.leaf_p, o.lev),
{name}_path AS (SELECT g, leaf_p, list(step ORDER BY lev) AS path FROM {name}_step GROUP BY g, leaf_p)"""


OP13_SQL = f"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, coalesce(':' || source, '-') AS g, {_leaf_sql('text')} AS d,
    CASE WHEN {_CRC_SQL} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql('text')} END AS t
  FROM documents),
rows_ AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS p, count(*) OVER (PARTITION BY g) AS m FROM leaf),
{_tree_sql('low', 'rows_')},
tops AS (SELECT '' AS g, g AS name, d, row_number() OVER (ORDER BY encode(g)) - 1 AS p, count(*) OVER () AS m FROM low WHERE m = 1),
{_tree_sql('high', 'tops')},
proof AS (
  SELECT r.doc_id, r.d, r.t, s.d AS subroot, (SELECT d FROM high WHERE m = 1) AS root,
    list_concat(coalesce(lp.path, []), coalesce(hp.path, [])) AS path
  FROM rows_ r JOIN tops s ON s.name = r.g LEFT JOIN low_path lp ON lp.g = r.g AND lp.leaf_p = r.p LEFT JOIN high_path hp ON hp.leaf_p = s.p),
folded AS (SELECT *, list_reduce(list_prepend(t, path), lambda d, x: sha256(split_part(x, '|', 1) || d || split_part(x, '|', 2))) AS folded_root FROM proof)
SELECT CAST(doc_id AS BIGINT) AS doc_id, d AS leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256,
  folded_root, folded_root = root AS verified
FROM folded
"""


@register("op13_merkle_manifest", sql=OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text")
    fields = ("doc_id", "source", "lang", "n_chars")
    altered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    presented = F.when(altered, F.unhex(merkle.leaf(*fields, F.replace("text", F.lit("\n"), F.lit("")))))
    leaves = docs.select(F.col("source").alias("grp"), F.col("doc_id").cast("long").alias("key"),
                         merkle.leaf(*fields, "text").alias("leaf"), presented.alias("presented"))
    found = merkle.manifest(leaves, ("presented",))
    again = merkle.fold(F.coalesce(F.lower(F.hex("presented")), F.col("leaf")), F.col("path"))
    return (found.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), again.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


@register("op12_token_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align.align(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"), digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")



@register("op11_personal_data")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitise.sanitise(table(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("spans", lambda x: x["kind"].isin(*sanitise.KINDS))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, sanitise.KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
