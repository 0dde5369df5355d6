"""What is the same for every position of a row is worked out once a row."""
import math

import pytest
from pyspark.sql import functions as F

from tidepool.functions.rand import drawn, drawn_below, edge, stem, uniform
from tidepool.functions.tokenizer import DEFAULT_TOKENIZER as TOK
from tidepool.operators import noise as nz, scoring as sc, split as sp


def test_draws_by_digits_are_the_uniform_ones(spark):
    probs = [0.0, -0.5, 2.0 ** -60, 1e-3, 0.25, 0.5, 1 - 2.0 ** -53, 1.0, 2.0, math.nan, None]
    rows = [(k, i, p) for k in (None, 0, 7, 10 ** 12) for i in range(30) for p in probs]
    d = spark.createDataFrame(rows, "k long, i int, p double")
    u, s = uniform(2, F.lit("m"), F.col("k"), F.col("i")), stem(2, F.lit("m"), F.col("k"))
    own = d.withColumn("u", u).withColumn("at", F.col("u"))  # a draw is not below itself
    for p in ("p", "at"):
        wrong = own.where(~(F.col("u") < F.col(p)).eqNullSafe(drawn_below(s, F.col("i"), edge(F.col(p)))) | (drawn(s, F.col("i")) != F.col("u")))
        assert wrong.count() == 0


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_masks_bind_row_constants_outside_the_lambda(spark):
    d = spark.createDataFrame([(1, list(range(60))), (None, []), (3, None), (4, list(range(5)))], "doc_id long, input_ids array<long>")
    d = d.withColumn("labels", F.transform("input_ids", lambda x: F.when(x < 0, -100).otherwise(x))).withColumn("p_mask", F.lit(0.4))
    for strategy, draw in (("truncated_suffix", "suffix"), ("block_masking", "bsize1")):
        plan = _plan(nz.apply_mask(d, 3, strategy, seed=2).select("masked"))
        flags = plan[plan.index("transform(array("):]
        inside = flags[flags.index("lambdafunction(transform("):]  # what is evaluated for each position
        assert draw not in inside, strategy
        assert "< 0" not in inside, strategy  # nor are all labels made again


def _flags(row, strategy):
    """The masks in plain Python."""
    import hashlib
    def u(*k):
        return int(hashlib.md5(":".join(str(x) for x in ("2", *k) if x is not None).encode()).hexdigest()[:13], 16) / 2 ** 52
    key, n, p = row.doc_id, len(row.input_ids), row.p_mask
    ok = [y != -100 for y in row.labels]
    rnd = [u("m", key, i) < p and ok[i] for i in range(n)]
    if strategy == "unmaskable_prefix":
        return [i >= n // 2 and rnd[i] for i in range(n)]
    if strategy == "truncated_suffix":
        return [i >= n - int(n * (u("suffix", key) * 0.3)) or rnd[i] for i in range(n)]
    if strategy == "block_masking":
        spans = []
        for j in range(3):
            z = 10 + math.floor(u(f"bsize{j}", key) * 41)
            s = math.floor(u(f"bstart{j}", key) * (max(n - z, 0) + 1))
            spans.append((s, s + z))
        return [ok[i] and any(s <= i < e for s, e in spans) for i in range(n)]
    return rnd


@pytest.mark.parametrize("strategy", nz.STRATEGIES)
def test_masks_are_those_of_the_definition(spark, strategy):
    rows = [(k, list(range(n)), [-100 if i % 7 == 0 else i for i in range(n)], p)
            for k in (None, 5, 6) for n in (0, 1, 9, 120) for p in (0.0, 0.3, 1.0)]
    d = spark.createDataFrame(rows, "doc_id long, input_ids array<long>, labels array<long>, p_mask double")
    for r in nz.apply_mask(d, 3, strategy, seed=2).collect():
        assert r.masked == _flags(r, strategy)


def test_scores_bind_their_stem_outside_the_lambda(spark):
    plan = _plan(spark.range(3).select(sc.pseudo_token_nll(12, F.col("id"), F.lit(4)).alias("v")))
    assert "nll" not in plan[plan.index("lambdafunction(transform("):]


def test_special_tokens_that_share_no_beginning(spark):
    from tidepool.functions.tokenizer import StandinTokenizer
    own = StandinTokenizer(specials={"[a]": 1, "<b>": 2})
    words = spark.createDataFrame([("[a]",), ("<b>",), ("<|pad|>",), ("x",), ("<|x",)], "w string")
    r = words.select(own.token_id(F.col("w")).alias("own"), TOK.token_id(F.col("w")).alias("std"), StandinTokenizer(specials={}).token_id(F.col("w")).alias("none")).collect()
    assert [x.own for x in r][:2] == [1, 2] and r[2].std == 0
    assert [x.own for x in r][2:] == [x.none for x in r][2:] and all(x.std == x.none for k, x in enumerate(r) if k != 2)


def test_ranking_computes_its_rows_twice_however_many_passes(spark):
    """Once for values and tiebreaks, once for the ranked rows."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(k, 0 if k < 400 else k * 1000) for k in range(1000)]
    d = spark.createDataFrame(rows, "id long, v long").repartition(2).mapInArrow(count, "id long, v long")
    got = sp.global_rank(d, F.col("v"), F.col("id"), buckets=16, heavy=20).collect()
    assert sorted((r["rank"], r.id) for r in got) == [(k, k) for k in range(1000)]
    assert seen.value == 2000


def test_length_buckets_make_the_ids_once(spark):
    from tidepool.operators import batching as bt
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    kind = "doc_id long, input_ids array<long>"
    d = spark.createDataFrame([(k, list(range(k % 40))) for k in range(300)], kind).repartition(2).mapInArrow(count, kind)
    rows = bt.length_bucket(d, 4, "doc_id", seed=5, bucket_width=16, pad_id=0).collect()
    assert seen.value == 300 and len(rows) == 300
    assert all(x.length_bucket <= y.length_bucket for x in rows for y in rows if x.batch_id < y.batch_id)
