"""Inputs that the queries' tables do not hold: null and sparse keys, skew,
null message content, mixed metric values, bad limits, many stream files."""
import json
import random

import pytest
from pyspark.sql import functions as F

from tidepool.functions.tokenizer import SpecialIds
from tidepool.operators import batching as bt, chat, normalise as nz, pack as pk, scoring as sc, split as sp, tokens as tk
from tidepool.sources import mixture, readers as rd
from tidepool.sources.spec import Source, SpecError
from tidepool.streaming import streams as st


def _ranks(df, **options):
    return [(r.v, r.t, r.rank) for r in sp.global_rank(df, F.col("v"), F.col("t"), **options).collect()]


@pytest.mark.parametrize("heavy", [10, 10_000])
def test_rank_with_outlier_ties_and_nulls(spark, heavy):
    r = random.Random(1)
    rows = [(r.randint(0, 30), i) for i in range(300)] + [(10_000_000, 300), (-(1 << 60), 301), (None, 302), (None, 303)] + [(7, 400 + i) for i in range(200)]
    df = spark.createDataFrame(rows, "v long, t long").repartition(5)
    want = {x: i for i, x in enumerate(sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1])))}
    assert {(v, t): k for v, t, k in _ranks(df, heavy=heavy, buckets=16)} == want
    assert _ranks(df.limit(0)) == [] and [k for *_, k in _ranks(spark.createDataFrame([(None, 1)], "v long, t long"))] == [0]


def test_rank_buckets_stay_small(spark):
    df = spark.range(20_000).select(F.when(F.col("id") == 0, 10_000_000).otherwise(10 + F.col("id") % 500).alias("v"), F.col("id").alias("t"))
    ranked = sp.global_rank(df, F.col("v"), F.col("t"), heavy=500)
    assert ranked.agg(F.count_distinct("rank"), F.min("rank"), F.max("rank")).first() == (20_000, 0, 19_999)
    import re
    keys = re.findall(r"hashpartitioning\(([^)]*)\)", ranked._jdf.queryExecution().toString())
    assert keys and all("_g" in k or "_b" in k for k in keys)


def test_cut_with_nulls_and_ties(spark):
    rows = [(5, i) for i in range(50)] + [(1, 100), (None, 101), (None, 102)]
    df = spark.createDataFrame(rows, "v long, t long")
    order = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    for n in (0, 1, 7, 51, 52, 53, 60):
        part, cut = sp.rank_cut(df, F.col("v"), F.col("t"), n=n)
        got = sorted((tuple(r) for r in df.where(part.within(cut)).collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        assert got == order[:n]


def test_limits_keep_rows_without_a_split(spark):
    df = spark.createDataFrame([(1, "train"), (2, "train"), (3, None), (4, "test")], "key long, split string")
    assert sorted(r.key for r in sp.limit_split(df, {"train": 1, "absent": 5}, "key").collect()) == [1, 3, 4]
    with pytest.raises(ValueError):
        sp.derive_splits_named(df, 1, None, "key").union(sp.derive_splits_named(df.where("split = 'test'"), 1, None, "key"))


@pytest.mark.parametrize("keys", [lambda i: i, lambda i: i * 1000, lambda i: (i * 7919) % 100_003])
def test_pack_groups_rows_not_key_values(spark, keys):
    rows = [(keys(i), [i] * 100) for i in range(300)]
    chunks = pk.pack(spark.createDataFrame(rows, "doc_id long, input_ids array<long>").repartition(3), 128, group_size=100).collect()
    assert len(chunks) == 3 * (100 * 100 // 128)
    first = min(keys(i) for i in range(300))
    assert next(c for c in chunks if (c.pack_group, c.chunk_id) == (0, 0)).input_ids[0] in [i for i in range(300) if keys(i) == first]


def test_pack_keeps_rows_with_null_keys_and_tokenises_once(spark):
    df = spark.createDataFrame([(None, [1, 2, 3]), (1, [4]), (2, None), (3, [])], "doc_id long, input_ids array<long>")
    got = pk.pack(df, 3, drop_tail=False).orderBy("chunk_id").collect()
    assert [list(c.input_ids) for c in got] == [[4, 1, 2], [3]]


def test_messages_without_content(spark):
    schema = "conv_id long, messages array<struct<role:string,content:string>>"
    df = spark.createDataFrame([(1, [("user", "a"), ("assistant", "b")]), (2, [("user", None), ("assistant", "b")]), (3, [("user", "a")]), (4, []), (5, None)], schema)
    for template in chat.TEMPLATES:
        assert [r.conv_id for r in chat.render_chat(df, template).where("text is null").orderBy("conv_id").collect()] == [2, 5]
    bad = {r.conv_id: r.reason for r in chat.sft_rejects(chat.encode_sft(df)).collect()}
    assert bad[2] == bad[5] == "message_without_content" and 1 not in bad
    assert {bad[3], bad[4]} <= {"last_role_not_assistant", "prompt_longer_than_render"}


def test_label_violations_never_null(spark):
    df = spark.createDataFrame([(1, [1, 2], [-100, 2]), (2, [1, 2], [1]), (3, [1, 2], [1, 3]), (4, [1], None), (5, [1, None], [1, 2])],
                               "k long, input_ids array<long>, labels array<long>")
    got = {r.k: r.v for r in df.select("k", bt.label_violations(df).alias("v")).collect()}
    assert got == {1: False, 2: True, 3: True, 4: True, 5: True}


def test_results_keep_tasks_names_and_unreadable_files(spark, tmp_path):
    files = {"a": {"results": {"gsm": {"alias": "gsm", "acc,none": 0.0, "em,none": "0.5", "acc_stderr,none": "N/A"}, "none": {}, "text": {"alias": "t"}}},
             "b": {"results": {"gsm": {"acc,none": 0.25}}}, "c": "broken"}
    for run, x in files.items():
        (tmp_path / run).mkdir()
        (tmp_path / run / "results.json").write_text(x if run == "c" else json.dumps(x))
    res = rd.read_results(spark, f"file://{tmp_path}/*/results.json")
    got = {(r.path.split("/")[-2], r.task): r.score for r in sc.score_summary(res.where("task is not null")).collect()}
    assert got == {("a", "gsm"): "0.0", ("a", "none"): "N/A", ("a", "text"): "N/A", ("b", "gsm"): "0.25"}
    assert {(r.path.split("/")[-2], r.task): r.score for r in sc.score_summary(res, compat=True).collect()}["a", "gsm"] == "0.5"
    assert [r.path.split("/")[-2] for r in rd.unreadable_results(res).collect()] == ["c"]


def test_metric_counts_labelled_positions_only(spark):
    df = spark.createDataFrame([("s", [1.0, 1.0, 1.0, 1.0], [True, False, True, False], [-100, 5, 6, 7], 1.0)],
                               "split string, token_nll array<double>, masked array<boolean>, labels array<long>, loss_weight double")
    row = sc.weighted_token_values(df)
    assert (row.first().row_value, row.first().row_nll, row.first().row_eligible) == (2.0, 1.0, 3)
    assert abs(sc.nll_by_split(row).first().nll - 1 / 3) < 1e-12


def test_windows_keep_null_runs(spark):
    rows = [(None, 1, True), (None, 2, False), ("a", 1, False), ("a", 2, True)]
    df = spark.createDataFrame(rows, "run string, at long, f boolean")
    n = {(r.run, r["at"]): r.running for r in sc.running_count(df, "run", ["at"], F.col("f"), F.col("at"), inclusive=True).collect()}
    assert n == {(None, 1): 1, (None, 2): 1, ("a", 1): 0, ("a", 2): 1}
    lag = {(r.run, r["at"]): r.prev_at for r in sc.bucketed_lag(df, "run", ["at"], ["at"], F.col("at")).collect()}
    assert lag == {(None, 1): None, (None, 2): 1, ("a", 1): None, ("a", 2): 1}


def _source(df):
    return lambda spark, root, options: df


def test_limits_and_options_are_strict(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i,) for i in range(9)], "key long")
    load = lambda spec: mixture.load_mixture(spark, spec, {"d": _source(df)}, "")
    assert load("x/d[train:4]").count() == 4 and load("x/d[train:4,test:2]").count() == 6
    for bad in ("x/d[train:5k]", "x/d[name:zzz]", "x/e", "", "train=4"):
        with pytest.raises(SpecError):
            load(bad)
    out = df.withColumn("config", F.when(F.col("key") < 3, "p").otherwise("q")).withColumn("split", F.lit("train"))
    rd.write_prepared(out, f"{tmp_path}/prep")
    monkeypatch.setenv(mixture.BASE_FOLDER, f"file://{tmp_path}")
    assert mixture.load_prepared(spark, "prep[name:p,train:2]").count() == 2 and mixture.load_prepared(spark, f"{tmp_path}/prep").count() == 9
    with pytest.raises(SpecError):
        mixture.load_prepared(spark, "prep[lang:en]")
    assert rd.read_all_configs(spark, f"{tmp_path}/prep", config="q").count() == 6
    with pytest.raises(ValueError):
        rd.read_all_configs(spark, f"{tmp_path}/prep/split=train/config=p")


def test_language_column_by_config(spark):
    df = spark.createDataFrame([("synthetic_qa", "py", "x"), ("algorithmic_corpus", "x", "py"), ("synthetic_qa", "py", "py")], "config string, program_lang string, lang string")
    assert nz.lang_equals(df, "py").count() == 3
    assert nz.lang_equals(df, "py", config="algorithmic_corpus").count() == 2
    with pytest.raises(NotImplementedError):
        nz.lang_equals(df, "py", config="other")


def test_mask_id_of_a_real_tokenizer_is_asked_for():
    assert SpecialIds(pad=100, eos=101, mask=102).resolved().mask == 102 and SpecialIds(pad=1).resolved(50).mask == 50
    with pytest.raises(ValueError):
        SpecialIds(pad=100, eos=101).resolved()


@pytest.mark.parametrize("limit", [64 << 20, 10])
def test_decode_in_shards(spark, monkeypatch, limit):
    monkeypatch.setattr(tk, "VOCAB_BYTES", limit)
    vocab = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (2, "x"), (1, "a")], "id long, token string")
    df = spark.createDataFrame([(1, [1, 2, 1, 9]), (2, []), (3, None), (4, [3, 3])], "k long, input_ids array<long>")
    got = {r.k: r.decoded for r in tk.decode(df, vocab, skip_ids=[3]).collect()}
    assert got == {1: "a b a <unk:9>", 2: "", 3: "", 4: ""}


def _stream_table(spark, tmp_path, n=40, files=5):
    r = random.Random(3)
    rows = [(i, i % 3, [i * 100 + j for j in range(r.randint(0, 30))]) for i in range(n)]
    import time
    for k in range(files):
        part = [x for x in rows if x[0] * files // n == k]
        spark.createDataFrame(part, "doc_id long, lane long, input_ids array<long>").coalesce(1).write.parquet(f"{tmp_path}/t/part={k}")
        time.sleep(0.05)
    return rows, st.StreamTable(f"{tmp_path}/t", spark.read.parquet(f"{tmp_path}/t/part=0").schema)


def test_lanes_carry_over_micro_batches(spark, tmp_path):
    rows, t = _stream_table(spark, tmp_path)
    out = f"{tmp_path}/out"
    st.pack_lanes(st.read_stream(spark, t, files_per_trigger=1), out, f"{tmp_path}/ck", 16, eos_id=7)
    got = {(r.lane, r.chunk_id): list(r.input_ids) for r in spark.read.parquet(out).collect()}
    want = {}
    for lane in range(3):
        flat = [x for _, k, ids in rows if k == lane for x in [*ids, 7]]
        want |= {(lane, c): flat[c * 16:c * 16 + 16] for c in range(len(flat) // 16)}
    assert got == want
    written = [json.loads(x) for f in (tmp_path / "out" / "_spark_metadata").iterdir() if f.name.isdigit() for x in f.read_text().splitlines()[1:]]
    assert len(list((tmp_path / "ck" / "commits").glob("[0-9]*"))) == 5 and len({x["path"] for x in written}) == len(written)


def test_stream_splits_by_source(spark, tmp_path):
    rows, t = _stream_table(spark, tmp_path)
    load = lambda spark, root, options: t
    s, sources = st.stream_corpus(spark, "a/t[test:5,train:20] | b/t", {"t": load}, "", files_per_trigger=1)
    st.split_stream(s.select("source_rank", "doc_id"), sources, f"{tmp_path}/o", f"{tmp_path}/ck", "doc_id")
    got = spark.read.parquet(f"{tmp_path}/o").collect()
    assert sorted(r.doc_id for r in got if r.source_rank == 1) == [r[0] for r in rows]
    mine = sorted((r.position, r.split) for r in got if r.source_rank == 0)
    assert mine == [(i, "test" if i < 5 else "train") for i in range(25)]
    with pytest.raises(SpecError):
        st.stream_corpus(spark, "a/t[lang:x]", {"t": load}, "")
    with pytest.raises(SpecError):
        st.split_stream(s, [Source("x", {"other": 3})], f"{tmp_path}/o2", f"{tmp_path}/ck2", "doc_id")
