"""Noise / corruption queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.functions.permute import sql_permuted, sql_round_keys
from tidepool.functions.rand import sql_uniform, sql_uniform_int
from tidepool.functions.schedules import alpha, kappa, loss_weight
from tidepool.functions.text import md5_of_ids
from tidepool.functions.tokenizer import DEFAULT_TOKENIZER as TOK
from tidepool.operators import noise as nz
from tidepool.plans.registry import register
from tidepool.plans.sequence_queries import SQL_DOCS, encoded_docs, sql_md5_ids
from tidepool.sources.readers import table

MASK = TOK.mask_token_id
HALF_PI = 1.5707963267948966


def noised_base(spark, sf_dir):
    """Documents whose first 8 labels are -100 (a prompt-like prefix)."""
    d = encoded_docs(spark, sf_dir)
    d = d.withColumn("labels", F.transform("input_ids", lambda x, i: F.when(i < 8, F.lit(-100).cast("bigint"))
                                           .otherwise(x)))
    return nz.mask_prob(nz.draw_time(d, "doc_id", seed=1), "linear")


SQL_BASE = f"""{SQL_DOCS},
base AS (
  SELECT doc_id, ids, list_transform(ids, lambda x, i: CASE WHEN i <= 8 THEN -100 ELSE x END) AS labels,
         0.001::DOUBLE + 0.999::DOUBLE * {sql_uniform(1, "'t'", 'doc_id')} AS t
  FROM enc
),
pm AS (SELECT *, 1.0::DOUBLE - (1.0::DOUBLE - t) AS p FROM base)"""


def _sql_u(tag: str, pos: str) -> str:
    return sql_uniform(2, f"'{tag}'", "doc_id", pos)


def _n_true(col):
    return F.size(F.filter(col, lambda b: b)).cast("bigint")


# --------------------------------------------------- N1, N2, N5 random

def noise_random_docs(spark, sf_dir):
    d = nz.apply_mask(noised_base(spark, sf_dir), MASK, "random", seed=2)
    return d.select("doc_id", F.round("t", 9).alias("t"), _n_true(F.col("masked")).alias("n_masked"),
                    md5_of_ids("noised_input_ids").alias("noised_md5"))


register("noise_random_docs", f"""
WITH {SQL_BASE},
m AS (SELECT doc_id, t, ids,
             list_transform(ids, lambda x, i: {_sql_u('m', 'i - 1')} < p AND labels[i] <> -100) AS masked FROM pm)
SELECT doc_id, round(t, 9) AS t, len(list_filter(masked, lambda b: b))::BIGINT AS n_masked,
       {sql_md5_ids(f"list_transform(ids, lambda x, i: CASE WHEN masked[i] THEN {MASK} ELSE x END)")} AS noised_md5
FROM m
""")(noise_random_docs)


# ------------------------------------------------ N6, N7, N8 strategies

def noise_strategies_docs(spark, sf_dir):
    d = noised_base(spark, sf_dir)
    ids, lab, p = F.col("input_ids"), F.col("labels"), F.col("p_mask")
    pre = nz.prefix_safe_flags(2, "doc_id", p, lab, ids)
    suf = nz.suffix_flags(2, "doc_id", p, lab, ids)
    blk = nz.block_flags(2, "doc_id", lab, ids)
    d = d.select("doc_id", pre.alias("pre"), suf.alias("suf"), blk.alias("blk"))  # columns, as each is read twice
    return d.select("doc_id", _n_true(F.col("pre")).alias("n_prefix"), _n_true(F.col("suf")).alias("n_suffix"),
                    _n_true(F.col("blk")).alias("n_block"),
                    F.md5(F.array_join(F.transform("suf", lambda b: b.cast("int")), "")).alias("suffix_md5"),
                    F.md5(F.array_join(F.transform("blk", lambda b: b.cast("int")), "")).alias("block_md5"))


def _sql_strategies() -> str:
    spans = []
    for j in range(3):
        size = sql_uniform_int(2, "10", "50", f"'bsize{j}'", "doc_id")
        spans.append((f"s{j}", f"z{j}", size))
    span_cols = ", ".join(
        f"{size} AS {z}" for (_, z, size) in spans)
    starts = ", ".join(
        f"{sql_uniform_int(2, '0', f'greatest(len(ids) - {z}, 0)', f''''bstart{j}' ''', 'doc_id')} AS {s}"
        for j, (s, z, _) in enumerate(spans))
    in_span = " OR ".join(f"(i - 1 >= {s} AND i - 1 < {s} + {z})" for (s, z, _) in spans)
    rnd = f"({_sql_u('m', 'i - 1')} < p AND labels[i] <> -100)"
    cut = f"floor(len(ids) * ({sql_uniform(2, chr(39) + 'suffix' + chr(39), 'doc_id')} * 0.3))::INTEGER"
    return f"""
WITH {SQL_BASE},
sz AS (SELECT *, {span_cols}, {cut} AS cut FROM pm),
st AS (SELECT *, {starts} FROM sz),
f AS (
  SELECT doc_id,
    list_transform(ids, lambda x, i: i - 1 >= len(ids) // 2 AND {rnd}) AS pre,
    list_transform(ids, lambda x, i: (cut > 0 AND i - 1 >= len(ids) - cut) OR {rnd}) AS suf,
    list_transform(ids, lambda x, i: ({in_span}) AND labels[i] <> -100) AS blk
  FROM st
)
SELECT doc_id, len(list_filter(pre, lambda b: b))::BIGINT AS n_prefix,
       len(list_filter(suf, lambda b: b))::BIGINT AS n_suffix, len(list_filter(blk, lambda b: b))::BIGINT AS n_block,
       md5(array_to_string(list_transform(suf, lambda b: b::INTEGER), '')) AS suffix_md5,
       md5(array_to_string(list_transform(blk, lambda b: b::INTEGER), '')) AS block_md5
FROM f
"""


register("noise_strategies_docs", _sql_strategies())(noise_strategies_docs)


# ------------------------------------------------- N9, N10 curriculum

def noise_curriculum_docs(spark, sf_dir):
    d = noised_base(spark, sf_dir).withColumn("step", F.col("doc_id") * 10)
    probs = nz.curriculum(F.col("step"), 10000)
    d = d.withColumn("strategy", nz.draw_strategy(F.col("step"), 10000, seed=4))
    d = nz.apply_mask(d, MASK, F.col("strategy"), seed=2)
    return d.select("doc_id", "step", "strategy",
                    F.round(probs["random"], 9).alias("p_random"), F.round(probs["block_masking"], 9).alias("p_block"),
                    _n_true(F.col("masked")).alias("n_masked"), md5_of_ids("noised_input_ids").alias("noised_md5"))


def _sql_curriculum() -> str:
    prog = "least(1.0::DOUBLE, step::DOUBLE / 10000.0)"
    raw = [f"greatest(0.1::DOUBLE, 1.0 - {prog})", f"least(0.3::DOUBLE, {prog} * 0.4)",
           f"least(0.2::DOUBLE, {prog} * 0.3)", f"least(0.4::DOUBLE, {prog} * 0.5)"]
    u = sql_uniform(4, "'strategy'", "step")
    spans = [(f"s{j}", f"z{j}", sql_uniform_int(2, "10", "50", f"'bsize{j}'", "doc_id")) for j in range(3)]
    span_cols = ", ".join(f"{size} AS {z}" for (_, z, size) in spans)
    starts = ", ".join(f"{sql_uniform_int(2, '0', f'greatest(len(ids) - {z}, 0)', chr(39) + f'bstart{j}' + chr(39), 'doc_id')} AS {s}"
                       for j, (s, z, _) in enumerate(spans))
    in_span = " OR ".join(f"(i - 1 >= {s} AND i - 1 < {s} + {z})" for (s, z, _) in spans)
    rnd = f"({_sql_u('m', 'i - 1')} < p AND labels[i] <> -100)"
    cut = f"floor(len(ids) * ({sql_uniform(2, chr(39) + 'suffix' + chr(39), 'doc_id')} * 0.3))::INTEGER"
    return f"""
WITH {SQL_BASE},
s AS (SELECT *, doc_id * 10 AS step FROM pm),
r AS (SELECT *, {raw[0]} AS r0, {raw[1]} AS r1, {raw[2]} AS r2, {raw[3]} AS r3 FROM s),
pr AS (SELECT *, r0 / (r0 + r1 + r2 + r3) AS q0, r1 / (r0 + r1 + r2 + r3) AS q1,
              r2 / (r0 + r1 + r2 + r3) AS q2, r3 / (r0 + r1 + r2 + r3) AS q3, {u} AS u FROM r),
ch AS (SELECT *, CASE WHEN u < q0 THEN 'random' WHEN u < q0 + q1 THEN 'unmaskable_prefix'
                      WHEN u < q0 + q1 + q2 THEN 'truncated_suffix' ELSE 'block_masking' END AS strategy,
              {span_cols}, {cut} AS cut FROM pr),
st AS (SELECT *, {starts} FROM ch),
f AS (
  SELECT *, CASE
    WHEN strategy = 'unmaskable_prefix' THEN list_transform(ids, lambda x, i: i - 1 >= len(ids) // 2 AND {rnd})
    WHEN strategy = 'truncated_suffix' THEN list_transform(ids, lambda x, i: (cut > 0 AND i - 1 >= len(ids) - cut) OR {rnd})
    WHEN strategy = 'block_masking' THEN list_transform(ids, lambda x, i: ({in_span}) AND labels[i] <> -100)
    ELSE list_transform(ids, lambda x, i: {rnd}) END AS masked
  FROM st
)
SELECT doc_id, step, strategy, round(q0, 9) AS p_random, round(q3, 9) AS p_block,
       len(list_filter(masked, lambda b: b))::BIGINT AS n_masked,
       {sql_md5_ids(f"list_transform(ids, lambda x, i: CASE WHEN masked[i] THEN {MASK} ELSE x END)")} AS noised_md5
FROM f
"""


register("noise_curriculum_docs", _sql_curriculum())(noise_curriculum_docs)


# ------------------------------------------------ N2, N3, N4 schedules

def schedule_values_docs(spark, sf_dir):
    d = nz.draw_time(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", seed=1)
    t = F.col("t")
    cols = {
        "alpha_linear": alpha(t, "linear"), "alpha_cosine": alpha(t, "cosine"),
        "kappa_cubic": kappa(t, "cubic"), "kappa_cosine": kappa(t, "cosine"), "kappa_linear": kappa(t, "linear"),
        "w_alpha_linear": loss_weight(t, "linear", "alpha"), "w_alpha_cosine": loss_weight(t, "cosine", "alpha"),
        "w_kappa_cubic": loss_weight(t, "cubic", "kappa"), "w_uniform": loss_weight(t, "uniform"),
    }
    return d.select("doc_id", *[F.round(c, 6).alias(n) for n, c in cols.items()])


register("schedule_values_docs", f"""
WITH b AS (SELECT doc_id, 0.001::DOUBLE + 0.999::DOUBLE * {sql_uniform(1, "'t'", 'doc_id')} AS t FROM documents)
SELECT doc_id,
  round(1.0 - t, 6) AS alpha_linear,
  round(1.0 - cos({HALF_PI} * (1.0 - t)), 6) AS alpha_cosine,
  round(2 * t * t * t - 3 * t * t + 2 * t, 6) AS kappa_cubic,
  round(1.0 - cos({HALF_PI} * t), 6) AS kappa_cosine,
  round(t, 6) AS kappa_linear,
  round(1.0 / ((1.0 - (1.0 - t)) + 1e-6), 6) AS w_alpha_linear,
  round(({HALF_PI} * sin({HALF_PI} * (1.0 - t))) / ((1.0 - (1.0 - cos({HALF_PI} * (1.0 - t)))) + 1e-6), 6) AS w_alpha_cosine,
  round((6 * t * t - 6 * t + 2) / ((1.0 - (2 * t * t * t - 3 * t * t + 2 * t)) + 1e-6), 6) AS w_kappa_cubic,
  1.0::DOUBLE AS w_uniform
FROM b
""")(schedule_values_docs)


# ------------------------------------------------------ N11 Monte-Carlo

def bench_requests(spark, sf_dir):
    """Likelihood requests from ``benchmark``: context = text before the
    first '.', continuation = the rest; target length = continuation
    token count."""
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    cont = F.expr("substring(text, length(substring_index(text, '.', 1)) + 1)")
    return (b.withColumn("context", F.substring_index("text", ".", 1)).withColumn("continuation", cont)
            .withColumn("target_len", TOK.count(F.col("continuation"))))


def mc_perturb_bench(spark, sf_dir):
    r = bench_requests(spark, sf_dir).where(F.col("target_len") > 0)
    m = nz.mc_perturb(r, "item_id", "target_len", mc_num=128, batch=8, seed=6)
    return m.select("item_id", "loop", F.col("copy").cast("bigint").alias("copy"), "n_masked",
                    F.round("p", 9).alias("p"),
                    F.md5(F.array_join(F.transform("target_mask", lambda b: b.cast("int")), "")).alias("mask_md5"))


def sql_mc_copies(cont: str) -> str:
    """CTEs up to ``d``: the copies with the place of each target position."""
    k = sql_uniform_int(6, "1", "L", "'k'", "item_id", "loop")
    return f"""
r AS (SELECT item_id, len({TOK.sql_tokens(cont)}) AS L FROM benchmark),
l AS (SELECT item_id, L, loop FROM r, range(16) t(loop) WHERE L > 0),
k AS (SELECT *, {k} AS k FROM l),
c AS (SELECT item_id, L, loop, copy, ((round_even(k + copy * (L / 8.0), 0)::BIGINT - 1) % L) + 1 AS x,
        {sql_round_keys(6, "'pos'", "item_id", "loop", "copy")} AS keys
      FROM k, range(8) t(copy)),
q AS (SELECT item_id, loop, copy, L, keys, unnest(range(L)) AS q FROM c),
pl AS (SELECT item_id, loop, copy, q, {sql_permuted("q", "L", "keys")} AS place FROM q),
d AS (SELECT c.item_id, c.loop, c.copy, c.L, c.x, list(place ORDER BY q) AS dr FROM c JOIN pl USING (item_id, loop, copy)
      GROUP BY c.item_id, c.loop, c.copy, c.L, c.x)"""


def _sql_mc() -> str:
    return f"""
WITH {sql_mc_copies("substr(text, length(split_part(text, '.', 1)) + 1)")}
SELECT item_id, loop::BIGINT AS loop, copy::BIGINT AS copy, x::BIGINT AS n_masked, round(x / L, 9) AS p,
       md5(array_to_string(list_transform(dr, lambda v: (v < x)::INTEGER), '')) AS mask_md5
FROM d
"""


register("mc_perturb_bench", _sql_mc())(mc_perturb_bench)
