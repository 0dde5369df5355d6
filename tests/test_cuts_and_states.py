"""Cuts over any 64-bit keys, keyed permutations, metric states, audits, time
buckets, settings as of a time, logs, steps."""
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidepool import steps
from tidepool.functions import permute
from tidepool.operators import audit, batching as bt, cuts, metric_state as ms, noise as nz, pack as pk, scoring as sc, split as sp, tokens as tk
from tidepool.sources import mixture, readers as rd

MIN, MAX = -(1 << 63), (1 << 63) - 1


def _hashed(n, seed=0):
    r = random.Random(seed)
    return [MIN, MAX, 0, -1] + [r.randint(MIN, MAX) for _ in range(n - 4)]


# -------------------------------------------------------------- cuts

def test_cuts_of_full_range_keys(spark):
    keys = _hashed(500)
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "v long, t long").repartition(4)
    order = sorted(keys)
    for n in (1, 2, 17, 250, 499, 500, 900):
        assert sorted(r.v for r in sp.first_n(df, n, "v").collect()) == order[:n]
    got = sp.derive_splits_disjoint(df, 100, 30, "v").collect()
    assert sorted(r.v for r in got if r.split == "test") == order[:30] and sorted(r.v for r in got if r.split == "train") == order[30:130]


def test_cuts_within_ties(spark):
    df = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (2, 13), (None, 14), (None, 15)], "v long, x long")
    for n, want in ((1, {10, 11, 12}), (2, {10, 11, 12}), (4, {10, 11, 12, 13}), (5, {10, 11, 12, 13, 14, 15})):
        got = [r.x for r in sp.first_n(df, n, "v").collect()]
        assert len(got) == n and set(got) <= want
    assert [r.x for r in sp.first_n(df, 2, "v", "x").collect()] == [10, 11]
    assert sorted(r.x for r in sp.first_n(df, 5, "v", "x").collect()) == [10, 11, 12, 13, 14]
    same = spark.createDataFrame([(1, 1)] * 3, "v long, x long")
    assert sp.first_n(same, 3, "v").count() == 3
    with pytest.raises(ValueError):
        sp.first_n(same, 2, "v")
    assert sp.limit_split(df.withColumn("split", F.lit("train")), {"train": 2}, "v").count() == 2


def test_many_cuts_share_their_passes(spark, monkeypatch):
    frames = [spark.createDataFrame([(k, k % 3) for k in _hashed(200, seed)], "key long, s int") for seed in (1, 2, 3)]
    frames = [df.withColumn("split", F.when(F.col("s") == 0, "test").otherwise("train")) for df in frames]
    calls = []
    search = cuts._search
    monkeypatch.setattr(cuts, "_search", lambda rows, live: calls.append(len(live)) or search(rows, live))
    out = sp.limit_all([(frames[0], {"train": 5, "test": 7}), (frames[1], {"train": 50}), (frames[2], {})], "key")
    assert calls == [3]
    for df, got, limits in zip(frames, out, ({"train": 5, "test": 7}, {"train": 50}, {})):
        want = []
        for split in ("train", "test"):
            rows = sorted(r.key for r in df.where(F.col("split") == split).collect())
            want += rows[:limits.get(split, len(rows))]
        assert sorted(r.key for r in got.collect()) == sorted(want)


def test_mixture_splits_and_limits_sources_together(spark):
    df = spark.createDataFrame([(k, f"t{k}") for k in range(200)], "key long, text string")
    registry = {"a": lambda s, r, o: sp.Unsplit(df, "key", 0.1), "b": lambda s, r, o: sp.Unsplit(df, "key", 7, 3, then=lambda x: x.where("key < 100")),
                "c": lambda s, r, o: df.where(F.col("text") == o.pop("name"))}
    mix = mixture.load_mixture(spark, "x/a[test:5] + x/b + x/c[name:t9]", registry, "")
    n = {(r.source, r.split): r["count"] for r in mix.groupBy("source", "split").count().collect()}
    alone = sp.split_exact(df, "key", 7, 3).where("key < 100").groupBy("split").count().collect()
    assert n == {("x/a", "train"): 180, ("x/a", "test"): 5, **{("x/b", r.split): r["count"] for r in alone}, ("x/c", "train"): 1}


def test_loaders_get_the_place_under_the_base_folder(spark, tmp_path):
    (tmp_path / "x" / "d").mkdir(parents=True)
    seen = []
    load = {"d": lambda s, root, o: seen.append(root) or s.range(1).withColumnRenamed("id", "key")}
    mixture.load_mixture(spark, "x/d", load, "elsewhere", base=f"file://{tmp_path}").count()
    mixture.load_mixture(spark, "y/d", load, "elsewhere", base=f"file://{tmp_path}").count()
    assert seen[0].endswith("/x/d") and seen[1] == "elsewhere"


@pytest.mark.parametrize("heavy", [10, 10_000])
def test_ranks_of_full_range_keys(spark, heavy):
    keys = _hashed(400)
    df = spark.createDataFrame([(k,) for k in keys], "v long").repartition(3)
    got = {r.v: r["rank"] for r in sp.global_rank(df, F.col("v"), F.col("v"), heavy=heavy, buckets=16).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


def test_pack_and_batches_of_full_range_keys(spark):
    keys = _hashed(300)
    df = spark.createDataFrame([(k, [1, 2, 3]) for k in keys], "doc_id long, input_ids array<long>")
    assert pk.pack(df, 4, group_size=100).count() == 3 * (300 // 4)
    assert [r["count"] for r in bt.assign_batches(df, 30, F.col("doc_id"), "doc_id").groupBy("batch_id").count().collect()] == [30] * 10


# ------------------------------------------------------- permutations

def test_permutations_are_one_to_one(spark):
    for n in (1, 2, 3, 4, 5, 7, 16, 17, 100, 101, 997, 4096, 10_007):
        df = spark.range(n).withColumn("size", permute.domain(F.lit(n))).withColumn("keys", permute.round_keys(5, F.lit("e")))
        got = [r.p for r in df.select(permute.permuted(F.col("id"), F.col("size"), F.col("keys")).alias("p")).collect()]
        assert sorted(got) == list(range(n)), n
    big = 10 ** 12 + 39
    df = spark.range(0, big, big // 2000).withColumn("size", permute.domain(F.lit(big))).withColumn("keys", permute.round_keys(1))
    got = [r.p for r in df.select(permute.permuted(F.col("id"), F.col("size"), F.col("keys")).alias("p")).collect()]
    assert len(set(got)) == len(got) and 0 <= min(got) and max(got) < big
    assert abs(sum(got) / len(got) / big - 0.5) < 0.05


def test_epochs_share_a_rank_and_differ(spark):
    keys = _hashed(300)
    got = sp.epoch_positions(spark.createDataFrame([(k,) for k in keys], "k long"), "k", 3, seed=1).collect()
    orders = [[r.k for r in sorted((r for r in got if r.epoch == e), key=lambda r: r.position)] for e in range(3)]
    assert all(sorted(o) == sorted(keys) for o in orders)
    moved = [sum(a != b for a, b in zip(orders[0], o)) for o in (orders[1], orders[2], sorted(keys))]
    assert min(moved) > 250


def test_perturbed_positions_are_uniform_without_sorting(spark):
    df = spark.createDataFrame([(i, 10) for i in range(60)], "item_id long, n int")
    m = nz.mc_perturb(df, "item_id", "n", mc_num=32, batch=4, seed=2, parts=2)
    assert "array_sort" not in m._jdf.queryExecution().toString()
    rows = m.collect()
    assert all(sum(r.target_mask) == r.n_masked for r in rows)
    share = [sum(r.target_mask[q] for r in rows) / sum(r.n_masked for r in rows) for q in range(10)]
    assert max(abs(s - 0.1) for s in share) < 0.015


# ------------------------------------------------------- metric states

def test_states_merge_to_the_direct_aggregate(spark):
    r = random.Random(1)
    rows = [(r.choice("abc"), r.choice(["train", "eval"]), d, r.choice([None, r.random()]), r.choice([None, 1.0, 2.0, 0.0])) for d in range(5) for _ in range(60)]
    df = spark.createDataFrame(rows, "run string, split string, day int, v double, w double").cache()
    m = ms.Metrics({"nll": ms.Metric(F.col("v"), F.col("w")), "ppl": ms.Metric(F.col("v"), F.col("w"), ms.perplexity),
                    "n": ms.Metric(F.lit(1.0), F.col("w"), ms.summed), "bits": ms.Metric(F.col("v"), finish=ms.bits)})
    days = [m.states(df.where(F.col("day") == d), "run", "split") for d in range(5)]
    for keys in (("run", "split"), ("split",)):
        direct = {tuple(x[k] for k in (*keys, "metric")): x.value for x in m.finished(m.states(df, *keys)).collect()}
        rolled = {tuple(x[k] for k in (*keys, "metric")): x.value for x in m.finished(m.merge(m.merge(days, "run", "split"), *keys)).collect()}
        assert direct.keys() == rolled.keys() and all(math.isclose(direct[k], rolled[k]) for k in direct)
    mine = [(v, w) for run, s, _, v, w in rows if s == "eval" and v is not None and w is not None]
    want = sum(v * w for v, w in mine) / sum(w for _, w in mine)
    logged = {x.key: x.value for x in m.logged(m.states(df, "split")).collect()}
    assert math.isclose(logged["eval_nll"], want) and math.isclose(logged["eval_ppl"], math.exp(want)) and "nll" in logged
    zero = ms.Metrics({"x": ms.Metric(F.col("v"), F.lit(0.0))})
    assert {x.value for x in zero.finished(zero.states(df, "run")).collect()} == {None}
    with pytest.raises(Exception, match="no metric is called"):
        zero.finished(m.states(df, "run")).collect()
    with pytest.raises(ValueError):
        m.merge(df, "run")
    assert m.states(df.limit(0), "run").count() == 0


def test_a_part_of_states_written_twice_counts_once(spark, tmp_path):
    m = ms.Metrics({"x": ms.Metric(F.col("id"))})
    for part in ("a", "b", "a"):
        ms.save_states(m.states(spark.range(5), F.lit("r").alias("run")), f"{tmp_path}/s", part)
    assert m.merge(spark.read.parquet(f"{tmp_path}/s"), "run").first()["rows"] == 10


# ------------------------------------------------------------- audits

def test_audit_counts_what_it_leaves_out_in_one_scan(spark, tmp_path):
    df = spark.createDataFrame([(k, None if k % 10 == 0 else k) for k in range(100)], "k long, v long")
    a = audit.Audit({"null": F.col("v").isNull(), "small": F.col("v") < 20, "odd": F.col("v") % 2 == 1})
    kept = a.kept(df)
    kept.write.parquet(f"{tmp_path}/kept")
    want = Counter("null" if k % 10 == 0 else "small" if k < 20 else "odd" if k % 2 else "kept" for k in range(100))
    assert a.counts() == want and spark.read.parquet(f"{tmp_path}/kept").count() == want["kept"]
    assert {r.reason: r.n for r in a.report(df).collect()} == want
    assert kept._jdf.queryExecution().toString().count("Exchange") == 0
    none = audit.Audit({"null": F.col("v").isNull()})
    none.kept(df.limit(0)).write.parquet(f"{tmp_path}/none")
    assert none.counts() == {"null": 0, "kept": 0}
    with pytest.raises(ValueError):
        audit.Audit({"kept": F.lit(True)})
    with pytest.raises(ValueError):
        audit.Audit({"x": F.lit(True)}).counts()


# ------------------------------------------------- time buckets, settings

HOUR = 3_600_000_000


def _log(spark, n=600):
    """Run a: spread over hours; run b: one hour; run c: one microsecond."""
    r = random.Random(3)
    rows = [("a", r.randint(-3 * HOUR, 40 * HOUR), i) for i in range(n)] + [("b", 7 * HOUR + r.randint(0, HOUR // 3600), 10_000 + i) for i in range(n)]
    rows += [("c", 9 * HOUR + 5, 20_000 + i) for i in range(n)] + [(None, 1, 30_000), (None, 2, 30_001)]
    return spark.createDataFrame(rows, "run string, at long, id long"), rows


def test_time_buckets_are_bounded_and_grow(spark):
    df, rows = _log(spark)
    got = sc.time_buckets(df, F.col("at"), "id", "run", rows=50).collect()
    assert len(got) == len(rows)
    per = Counter((r.run, r.bucket) for r in got)
    assert max(per.values()) <= 50
    for run in "abc":
        mine = sorted((r for r in got if r.run == run), key=lambda r: (r["at"], r["id"]))
        buckets = [tuple(r.bucket) for r in mine]
        assert buckets == sorted(buckets)
    whole = sc.time_buckets(df, F.col("at"), "id", "run")
    assert {r.bucket.start % HOUR for r in whole.collect()} == {0}


@pytest.mark.parametrize("rows", [20, 100_000])
def test_settings_hold_until_the_next(spark, rows):
    df, log = _log(spark, 300)
    r = random.Random(5)
    given = [(run, at, i, r.randint(1, 9), None if k % 4 == 0 else k) for k, (run, at, i) in enumerate(r.sample(log, 60))] + [("a", -4 * HOUR, 0, 77, 5)]
    settings = spark.createDataFrame(given, "run string, at long, id long, size int, other int")
    got = {r["id"]: (r["size"], r.other) for r in sc.as_of(df, settings, "run", "at", "id", ["size", "other"], rows).collect()}
    for run, at, i in log:
        mine = sorted((x for x in given if x[0] == run and (x[1], x[2]) <= (at, i)), key=lambda x: (x[1], x[2]))
        assert got[i] == ((mine[-1][3], mine[-1][4]) if mine else (None, None))
    assert len(got) == len(log)


def test_running_counts_over_small_buckets(spark):
    df, log = _log(spark, 200)
    b = sc.time_buckets(df, F.col("at"), "id", "run", rows=15)
    got = {r["id"]: r.running for r in sc.running_count(b, "run", ["at", "id"], F.col("id") % 3 == 0, F.col("bucket")).collect()}
    for run, at, i in log:
        assert got[i] == sum(x[0] == run and (x[1], x[2]) < (at, i) and x[2] % 3 == 0 for x in log)


# ------------------------------------------------------------- S9, A11

def test_a_transaction_logged_twice_is_there_once(spark, tmp_path):
    path = f"{tmp_path}/log"
    rows = spark.createDataFrame([("r1", 1, "loss", 0.5), ("r1", 1, "eval_loss", 0.6), ("r2", 1, "loss", 0.7)], "run string, step int, key string, value double")
    for _ in range(2):
        rd.append_run_log(rows, path, txn=("run", "step"))
    rd.append_run_log(rows.withColumn("step", F.lit(2)).withColumn("value", F.lit(9.0)), path, txn=("run", "step"))
    back = spark.read.parquet(path)
    assert back.count() == 6 and back.where("step = 1").agg(F.round(F.sum("value"), 6)).first()[0] == 1.8
    with pytest.raises(ValueError):
        rd.append_run_log(rows, path)
    gens = spark.createDataFrame([("r", 1, "p", "g"), ("r", 1, "p2", "g2")], "run string, step int, prompt string, generation string")
    for _ in range(2):
        rd.log_generations(gens, f"{tmp_path}/g")
    assert sorted((r.prompt, r.generation) for r in spark.read.parquet(f"{tmp_path}/g").collect()) == [("p", "g"), ("p2", "g2")]


def test_text_stops_and_lists_of_ids(spark):
    df = spark.createDataFrame([("a</s>b<eot>c",), ("x<eot>y</s>z",), ("plain",), ("",), (None,)], "t string")
    assert [r.trimmed for r in tk.trim_text(df, "t", "</s>", "<eot>").collect()] == ["a", "x", "plain", "", None]
    assert [r.trimmed for r in tk.trim_text(df, "t", None, "").collect()] == [r.t for r in df.collect()]
    ids = spark.createDataFrame([("[126081;126348]",), (" [1] ",), ("1; 2 ;",), ("[]",), ("",), (None,)], "t string")
    assert [r.x for r in ids.select(tk.token_list("t").alias("x")).collect()] == [[126081, 126348], [1], [1, 2], [], [], []]
    with pytest.raises(Exception):
        spark.createDataFrame([("[1;x]",)], "t string").select(tk.token_list("t")).collect()


# --------------------------------------------------------------- steps

class _Trace(steps.Wrapper):
    def __init__(self, name, log):
        self.name, self.log = name, log

    def before(self, step, df):
        self.log.append((self.name, "before", step))
        return df

    def after(self, step, df):
        self.log.append((self.name, "after", step))
        return df


def test_chains_from_text(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, " ".join("x" * 20))], "doc_id long, text string")
    log, r = [], steps.standard()
    run = r.chain('[{"step": "encode_text"}, {"step": "filter_length", "max_length": 5}]', [_Trace("out", log), _Trace("in", log)])
    assert [x.doc_id for x in run(df).collect()] == [1]
    assert log[:4] == [("out", "before", "encode_text"), ("in", "before", "encode_text"), ("in", "after", "encode_text"), ("out", "after", "encode_text")]
    for bad in ('[{"step": "encode"}]', '[{"step": "clip"', '{"step": "encode_text"}', '[{"step": "filter_length"}]', '[{"step": "filter_length", "max_length": "5"}]',
                '[{"step": "filter_length", "max_length": true}]', '[{"step": "encode_text", "field": "text"}]', '["encode_text"]'):
        with pytest.raises(steps.StepError):
            r.chain(bad)
    for late in ('[{"step": "append_eos"}]', '[{"step": "encode_text", "text": "body"}]'):
        with pytest.raises(steps.StepError):
            r.chain(late)(df)
    with pytest.raises(steps.StepError):
        r.add("render", lambda df: df)
    assert "text" not in r.chain('[{"step": "encode_text"}]', [steps.DropColumns("text")])(df).columns
