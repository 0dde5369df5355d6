"""Hand-computed goldens (FIXTURES.md §4)."""
import pytest
from pyspark.sql import functions as F

from tidepool.functions import schedules as sch
from tidepool.operators import noise as nz, pack as pk, scoring as sc, tokens as tk
from tidepool.sources import spec


def test_curriculum_goldens(spark):
    df = spark.createDataFrame([(0,), (2500,), (5000,), (10000,), (20000,)], "step long")
    rows = df.select("step", nz.curriculum(F.col("step"), 10000).alias("p")).orderBy("step").collect()
    got = {r.step: [round(r.p[k], 6) for k in nz.STRATEGIES] for r in rows}
    assert got[0] == [1.0, 0.0, 0.0, 0.0]
    assert got[2500] == [0.714286, 0.095238, 0.071429, 0.119048]
    assert got[5000] == [0.454545, 0.181818, 0.136364, 0.227273]
    assert got[10000] == got[20000] == [0.1, 0.3, 0.2, 0.4]
    for v in got.values():
        assert abs(sum(v) - 1) < 1e-5


def test_schedule_goldens(spark):
    df = spark.createDataFrame([(0.25,), (0.5,), (0.75,)], "t double")
    t = F.col("t")
    r = df.select(
        F.round(sch.alpha(t, "linear"), 6).alias("al"), F.round(sch.loss_weight(t, "linear"), 6).alias("wl"),
        F.round(sch.alpha(t, "cosine"), 6).alias("ac"), F.round(sch.loss_weight(t, "cosine"), 6).alias("wc"),
        F.round(sch.kappa(t, "cubic"), 6).alias("kc"), F.round(sch.kappa(t, "cosine"), 6).alias("kcos"),
    ).collect()
    assert [tuple(x) for x in r] == [
        (0.75, 3.999984, 0.617317, 3.792228, 0.34375, 0.07612),
        (0.5, 1.999996, 0.292893, 1.570794, 0.5, 0.292893),
        (0.25, 1.333332, 0.07612, 0.650644, 0.65625, 0.617317),
    ]


def test_schedule_registry_errors():
    with pytest.raises(ValueError):
        sch.alpha(F.lit(0.5), "nope")
    assert sch._get(sch.ALPHA, "LinearAlphaScheduler") is sch.ALPHA["linear"]


@pytest.mark.parametrize("k,L,b,want", [
    (3, 10, 4, [3, 6, 8, 10]), (10, 10, 4, [10, 2, 5, 8]), (1, 5, 8, [1, 2, 2, 3, 4, 4, 5, 5])])
def test_mc_counts(spark, k, L, b, want):
    r = spark.range(1).select(nz.mc_counts(F.lit(k), F.lit(L), b).alias("x")).first()
    assert list(r.x) == want


def test_specs_read_into_typed_sources():
    parse = spec.parse
    assert parse("a/b") == [spec.Source("a/b")]
    assert parse("a/b[train:5_000, lang:python] + B|C") == [spec.Source("a/b", {"train": 5000}, {"lang": "python"}), spec.Source("B"), spec.Source("C")]
    assert parse("x=1,y=2 | n=1[n:z]") == [spec.Source(None, {}, {"x": "1", "y": "2"}), spec.Source(None, {}, {"n": "z"})]
    assert parse('"a+b/c"[train:3]') == [spec.Source("a+b/c", {"train": 3})]
    assert parse(" + ") == [] and parse("a[train:5k]")[0].options == {"train": "5k"}
    for bad in ("x[bad]", "x[a:1", "x]", "x[a:1]y", 'x"', "x[:1]", "a b[c:d:e]"):
        with pytest.raises(spec.SpecError):
            parse(bad)
    registry = {"b": 1, "~corpus": 2}
    assert spec.find_loader("a/b", registry) == 1 and spec.find_loader("my/corpus-x", registry) == 2
    with pytest.raises(spec.SpecError):
        spec.find_loader("a/bb", registry)


def test_clip_goldens(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5], 2, 3)], "input_ids array<long>, prompt_len int, p3 int")
    r = tk.clip(df, 3, "right").first().input_ids
    l_ = tk.clip(df, 3, "left").first().input_ids
    kr = tk.clip_keep_prompt(df, 3, "right").first().input_ids
    kl = tk.clip_keep_prompt(df, 3, "left").first().input_ids
    assert (list(r), list(l_), list(kr), list(kl)) == ([1, 2, 3], [3, 4, 5], [1, 2, 3], [1, 2, 5])
    df3 = df.withColumn("prompt_len", F.lit(3))
    assert list(tk.clip_keep_prompt(df3, 3, "left").first().input_ids) == [1, 2, 3]
    assert list(tk.clip_keep_prompt(df3, 3, "left", compat=True).first().input_ids) == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("L,drop,want", [
    (2, True, [[1, 2], [9, 3], [9, 9]]),
    (4, True, [[1, 2, 9, 3]]),
    (4, False, [[1, 2, 9, 3], [9, 9]]),
])
def test_pack_golden(spark, L, drop, want):
    df = spark.createDataFrame([(0, [1, 2]), (1, [3]), (2, [])], "doc_id long, input_ids array<long>")
    out = pk.pack(df, L, eos_id=9, drop_tail=drop).orderBy("chunk_id").collect()
    assert [list(r.input_ids) for r in out] == want
    assert all(list(r.labels) == list(r.input_ids) for r in out)


def test_score_summary(spark):
    rows = [("f", "t1", "acc,none", 0.0), ("f", "t1", "em,none", 0.4), ("f", "t2", "other", 1.0)]
    df = spark.createDataFrame(rows, "path string, task string, metric string, value double")
    ref = {r.task: r.score for r in sc.score_summary(df, compat=True).collect()}
    safe = {r.task: r.score for r in sc.score_summary(df).collect()}
    assert ref == {"t1": "0.4", "t2": "N/A"}
    assert safe == {"t1": "0.0", "t2": "N/A"}


def test_append_eos(spark):
    df = spark.createDataFrame([([1, 2],), ([3, 9],), ([],)], "input_ids array<long>")
    got = [list(r.input_ids) for r in tk.append_eos(df, 9).collect()]
    assert got == [[1, 2, 9], [3, 9], [9]]
    with pytest.raises(ValueError):
        tk.append_eos(df, 0)
