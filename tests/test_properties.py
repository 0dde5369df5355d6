"""Properties of the operators on the driver tables (sf0.001)."""
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tidepool.functions.tokenizer import DEFAULT_TOKENIZER as TOK
from tidepool.operators import batching as bt, noise as nz, pack as pk, split as sp, tokens as tk
from tidepool.sources.readers import table


def _docs(spark):
    d = table(spark, SF_SMALL, "documents").select("doc_id", "text")
    return tk.encode_text(d, "text", TOK).drop("text")


def test_pack_conserves_tokens(spark):
    enc = tk.append_eos(_docs(spark), TOK.eos_token_id)
    total = enc.select(F.sum(F.size("input_ids"))).first()[0]
    kept = pk.pack(enc, 64, drop_tail=False, group_size=50).select(F.sum(F.size("input_ids"))).first()[0]
    assert kept == total


def test_split_exact_size_and_disjoint(spark):
    d = table(spark, SF_SMALL, "documents").select("doc_id")
    n = d.count()
    s = sp.split_exact(d, "doc_id", 0.05, seed=42)
    counts = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    import math
    assert counts["test"] == math.ceil(0.05 * n) and counts["train"] == n - counts["test"]
    assert s.select("doc_id").distinct().count() == n


def test_global_rank_is_permutation(spark):
    d = table(spark, SF_SMALL, "documents").select("doc_id")
    from tidepool.functions.rand import hash52
    r = sp.global_rank(d, hash52(5, F.col("doc_id")), F.col("doc_id"), out="rk")
    n = d.count()
    got = sorted(x.rk for x in r.collect())
    assert got == list(range(n))


def test_clip_bounds(spark):
    c = tk.clip(_docs(spark), 17, "left")
    assert c.select(F.max(F.size("input_ids"))).first()[0] <= 17


def test_masks_respect_ignore(spark):
    d = tk.clip(_docs(spark), 64).withColumn(
        "labels", F.transform("input_ids", lambda x, i: F.when(i < 8, F.lit(-100).cast("bigint")).otherwise(x)))
    d = nz.mask_prob(nz.draw_time(d, "doc_id", 1))
    for strat in ("random", "unmaskable_prefix", "block_masking"):
        m = nz.apply_mask(d, TOK.mask_token_id, strat, seed=3)
        bad = m.where(F.exists(F.arrays_zip("masked", "labels"), lambda p: p["masked"] & (p["labels"] == -100)))
        assert bad.count() == 0, strat


def test_collate_shapes(spark):
    d = tk.clip(_docs(spark), 32).withColumn("labels", F.col("input_ids"))
    b = bt.batch_collate(d, 4, "doc_id", seed=1, pad_id=0)
    per = b.groupBy("batch_id").agg(F.countDistinct(F.size("input_ids")).alias("w"), F.count(F.lit(1)).alias("n"))
    assert per.where("w != 1").count() == 0
    assert per.where("n > 4").count() == 0
