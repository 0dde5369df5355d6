"""Corruption operators: offline masked copies of a corpus.

Every random draw is ``uniform(seed, keys…)`` — a function of the row key,
the position and a purpose tag — so masks are reproducible on any cluster
layout and after executor loss.  Masks are built with ``transform`` over the
id array (no token explosion); what is the same for all positions of a row is
worked out once (``once``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions.permute import domain, permuted, round_keys
from tidepool.functions.rand import drawn_below, edge, once, stem, uniform, uniform_int
from tidepool.functions.schedules import alpha

IGNORE = -100
EPS = 1e-3


# ----------------------------------------------------------------- N1 time

def draw_time(df: DataFrame, key: str, seed: int, eps: float = EPS, out: str = "t") -> DataFrame:
    """Per-sequence time ``t = eps + (1 - eps) * u``, eps in (0, 1)."""
    if not 0.0 < eps < 1.0:
        raise ValueError("time epsilon must be in (0, 1)")
    return df.withColumn(out, F.lit(eps) + F.lit(1.0 - eps) * uniform(seed, F.lit("t"), F.col(key)))


def mask_prob(df: DataFrame, kind: str = "linear", t: str = "t", out: str = "p_mask") -> DataFrame:
    """p_mask = 1 - α(t)."""
    return df.withColumn(out, 1.0 - alpha(F.col(t), kind))


# ------------------------------------------------------------ strategies

def _eligible(labels: Column, i: Column) -> Column:
    return F.get(labels, i) != F.lit(IGNORE)


def _draws(seed, key, p: Column, labels: Column, **more: Column) -> dict[str, Column]:
    """What the random mask of a row needs at every position."""
    return {"stem": stem(seed, F.lit("m"), F.col(key)), "edge": edge(p), "labels": labels, **more}


def _random(r: Column, i: Column) -> Column:
    return drawn_below(r["stem"], i, r["edge"]) & _eligible(r["labels"], i)


def random_mask_flags(seed, key, p: Column, labels: Column, ids: Column) -> Column:
    """N5 flags: u < p and label != -100."""
    return once(_draws(seed, key, p, labels), lambda r: F.transform(ids, lambda x, i: _random(r, i)))


def prefix_safe_flags(seed, key, p: Column, labels: Column, ids: Column, prefix_len: Column | None = None) -> Column:
    """N6 flags: random mask only at positions >= prefix_len (default: half
    of the padded length)."""
    pl = prefix_len if prefix_len is not None else F.floor(F.size(ids) / 2)
    return once(_draws(seed, key, p, labels, start=pl), lambda r: F.transform(ids, lambda x, i: (i >= r["start"]) & _random(r, i)))


def suffix_flags(seed, key, p: Column, labels: Column, ids: Column, max_ratio: float = 0.3) -> Column:
    """N7 flags: the last ``int(l * U(0, max_ratio))`` positions are masked
    even where label = -100; random mask (eligible only) elsewhere."""
    n = F.size(ids)
    start = n - F.floor(n * (uniform(seed, F.lit("suffix"), F.col(key)) * max_ratio)).cast("int")
    return once(_draws(seed, key, p, labels, start=start), lambda r: F.transform(ids, lambda x, i: (i >= r["start"]) | _random(r, i)))


def block_flags(seed, key, labels: Column, ids: Column, num_blocks: int = 3, lo: int = 10, hi: int = 50) -> Column:
    """N8 flags: ``num_blocks`` spans (sizes lo..hi inclusive, may overlap,
    start in [0, max(0, l - size)]), eligible positions only; p ignored."""
    n = F.size(ids)
    spans = []
    for j in range(num_blocks):
        size = uniform_int(seed, lo, hi, F.lit(f"bsize{j}"), F.col(key))
        start = uniform_int(seed, F.lit(0), F.greatest(n - size, F.lit(0)), F.lit(f"bstart{j}"), F.col(key))
        spans.append(F.struct(start.alias("s"), (start + size).alias("e")))
    return once({"spans": F.array(*spans), "labels": labels}, lambda r: F.transform(
        ids, lambda x, i: F.exists(r["spans"], lambda sp: (i >= sp["s"]) & (i < sp["e"])) & _eligible(r["labels"], i)))


STRATEGIES = ("random", "unmaskable_prefix", "truncated_suffix", "block_masking")


def strategy_flags(strategy: str | Column, seed, key, p, labels, ids) -> Column:
    builders = {
        "random": lambda: random_mask_flags(seed, key, p, labels, ids),
        "unmaskable_prefix": lambda: prefix_safe_flags(seed, key, p, labels, ids),
        "truncated_suffix": lambda: suffix_flags(seed, key, p, labels, ids),
        "block_masking": lambda: block_flags(seed, key, labels, ids),
    }
    if isinstance(strategy, str):
        return builders.get(strategy, builders["random"])()   # unknown name = random
    expr = F.when(strategy == "unmaskable_prefix", builders["unmaskable_prefix"]())
    expr = expr.when(strategy == "truncated_suffix", builders["truncated_suffix"]())
    expr = expr.when(strategy == "block_masking", builders["block_masking"]())
    return expr.otherwise(builders["random"]())


def apply_mask(df: DataFrame, mask_id: int, strategy: str | Column = "random", seed: int = 0,
               key: str = "doc_id", p: str = "p_mask", ids: str = "input_ids",
               labels: str = "labels") -> DataFrame:
    """N5–N8, N10 dispatch: adds ``masked`` (array<boolean>) and
    ``noised_input_ids``."""
    flags = strategy_flags(strategy, seed, key, F.col(p), F.col(labels), F.col(ids))
    df = df.withColumn("masked", flags)
    noised = F.zip_with(F.col(ids), F.col("masked"),
                        lambda x, m: F.when(m, F.lit(mask_id).cast("bigint")).otherwise(x))
    return df.withColumn("noised_input_ids", noised)


# ------------------------------------------------------------ curriculum

def curriculum(step: Column, total: int) -> Column:
    """Struct of the four strategy probabilities at ``step``,
    normalised; early steps favour random masking."""
    prog = F.least(F.lit(1.0), step.cast("double") / F.lit(float(total)))
    raw = [F.greatest(F.lit(0.1), 1.0 - prog), F.least(F.lit(0.3), prog * 0.4),
           F.least(F.lit(0.2), prog * 0.3), F.least(F.lit(0.4), prog * 0.5)]
    tot = raw[0] + raw[1] + raw[2] + raw[3]
    return F.struct(*[(r / tot).alias(n) for r, n in zip(raw, STRATEGIES)])


def draw_strategy(step: Column, total: int, seed: int) -> Column:
    """One strategy per step, drawn by weight (cumulative probabilities
    against ``U(seed, step)``)."""
    probs = curriculum(step, total)
    u = uniform(seed, F.lit("strategy"), step)
    c1 = probs[STRATEGIES[0]]
    c2 = c1 + probs[STRATEGIES[1]]
    c3 = c2 + probs[STRATEGIES[2]]
    return (F.when(u < c1, F.lit(STRATEGIES[0])).when(u < c2, F.lit(STRATEGIES[1]))
            .when(u < c3, F.lit(STRATEGIES[2])).otherwise(F.lit(STRATEGIES[3])))


# ------------------------------------------------------- Monte-Carlo

def mc_counts(k: Column, L: Column, b: int) -> Column:
    """Mask counts of the ``b`` copies: ``((rint(k + i·L/b) - 1) mod L) + 1``."""
    return F.transform(F.sequence(F.lit(0), F.lit(b - 1)),
                       lambda i: F.pmod(F.rint(k + i * (L / F.lit(float(b)))).cast("bigint") - 1, L) + 1)


def mc_perturb(df: DataFrame, key: str, target_len: str, mc_num: int, batch: int, seed: int,
               parts: int | None = None) -> DataFrame:
    """``max(1, mc_num // batch)`` loops × ``batch`` copies per request;
    per loop ``k ~ U{1..L}``; copy i masks ``x_i`` of the L target positions
    uniformly without replacement: those that a permutation keyed by (request,
    loop, copy) puts below ``x_i``; ``p = x / L``.  Rows grow ×loops×batch: the
    loops are dealt over ``parts`` partitions (default: the cluster's
    parallelism; an explicit number, which AQE leaves alone) before the copies
    are made."""
    loops = max(1, mc_num // batch)
    L = F.col(target_len)
    rows = (df.withColumn("loop", F.explode(F.sequence(F.lit(0), F.lit(loops - 1))))
            .repartition(parts or df.sparkSession.sparkContext.defaultParallelism, key, "loop")
            .withColumn("_k", uniform_int(seed, F.lit(1), L, F.lit("k"), F.col(key), F.col("loop")))
            .withColumn("_x", mc_counts(F.col("_k"), L, batch))
            .select("*", F.posexplode("_x").alias("copy", "n_masked"))
            .drop("_x", "_k"))
    rows = rows.withColumn("_keys", round_keys(seed, F.lit("pos"), F.col(key), F.col("loop"), F.col("copy"))).withColumn("_size", domain(L))
    place = F.transform(F.sequence(F.lit(0), L - 1), lambda q: permuted(q, F.col("_size"), F.col("_keys")))
    return (rows.withColumn("target_mask", F.transform(place, lambda at: at < F.col("n_masked")))
            .withColumn("p", F.col("n_masked") / L)
            .drop("_keys", "_size"))
