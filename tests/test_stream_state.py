"""State on streams: intervals, lanes, audits and sources in order, over many
micro-batches, with restarts and with a job that dies between batches."""
import random
import time

import pytest
from pyspark.sql import functions as F

from tidepool.operators import metric_state as ms, scoring as sc
from tidepool.streaming import streams as st

LOG = "run string, at long, id long, mark boolean, split string, v double"


def _rows(n=300):
    r = random.Random(7)
    return [(r.choice(["a", "b", None]), i // 3, i, r.random() < 0.05, r.choice(["train", "eval"]), None if r.random() < 0.1 else r.random()) for i in range(n)]


def _add(spark, path, rows, schema, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/part={name}")
    time.sleep(0.05)


def _intervals(rows):
    """Plain version: (run, interval, split) -> [values]."""
    out, marks = {}, {}
    for run, _, _, mark, split, v in sorted(rows, key=lambda x: (x[1], x[2])):
        marks[run] = marks.get(run, 0) + mark
        if not mark and v is not None:
            out.setdefault((run, marks[run], split), []).append(v)
    return out


def _metrics():
    return ms.Metrics({"loss": ms.Metric(F.col("v")), "twice": ms.Metric(F.col("v"), F.lit(2.0), ms.summed)})


def _columns():
    return dict(run="run", at=F.col("at"), tiebreak=F.col("id"), is_mark=F.col("mark"), split=F.col("split"))


@pytest.mark.parametrize("cuts", [(300,), (100, 200, 300), (1, 2, 7, 150, 151, 290, 300)])
def test_intervals_do_not_depend_on_micro_batches(spark, tmp_path, cuts):
    rows, src, at = _rows(), f"{tmp_path}/log", 0
    for k, end in enumerate(cuts):
        part = rows[at:end]
        random.Random(k).shuffle(part)
        _add(spark, src, part, LOG, k)
        at = end
        if k % 2 == 0:  # restarts from the checkpoint after every second slice
            s = st.read_stream(spark, st.StreamTable(src, spark.createDataFrame([], LOG).schema), files_per_trigger=1)
            st.interval_metrics(s, _metrics(), f"{tmp_path}/out", f"{tmp_path}/ck", **_columns())
    if len(cuts) % 2 == 0:
        st.interval_metrics(s, _metrics(), f"{tmp_path}/out", f"{tmp_path}/ck", **_columns())
    got = _metrics().finished(st.latest(spark, f"{tmp_path}/out", ["run", "eval_interval", "split", "metric"])).collect()
    want = _intervals(rows)
    assert {(r.run, r.eval_interval, r.split) for r in got} == set(want)
    for r in got:
        values = want[r.run, r.eval_interval, r.split]
        assert r["rows"] == len(values)
        assert abs(r.value - (sum(values) / len(values) if r.metric == "loss" else 2 * sum(values))) < 1e-9
    last = {}
    for run, i, _ in want:
        last[run] = max(last.get(run, 0), i)
    assert all(r.closed == (r.eval_interval < sum(x[3] for x in rows if x[0] == r.run)) or r.eval_interval < last[r.run] for r in got)


def test_intervals_equal_the_batch_operator(spark, tmp_path):
    rows, src = _rows(), f"{tmp_path}/log"
    for k in range(3):
        _add(spark, src, rows[k * 100:k * 100 + 100], LOG, k)
    s = st.read_stream(spark, st.StreamTable(src, spark.createDataFrame([], LOG).schema), files_per_trigger=1)
    st.interval_metrics(s, _metrics(), f"{tmp_path}/out", f"{tmp_path}/ck", **_columns())
    got = _metrics().finished(st.latest(spark, f"{tmp_path}/out", ["run", "eval_interval", "split", "metric"])).collect()
    df = sc.time_buckets(spark.createDataFrame(rows, LOG), F.col("at"), "id", "run")
    want = sc.metrics_by_interval(df, "run", ["at", "id"], F.col("mark"), F.col("split"), _metrics(), F.col("bucket")).collect()
    key = lambda r: (r.run, r.eval_interval, r.split, r.metric)
    want = {key(r): (r["rows"], r.value) for r in want}
    assert {key(r): (r["rows"], pytest.approx(r.value)) for r in got} == want


LANES = "doc_id long, lane long, input_ids array<long>"


class Killed(Exception):
    pass


def _lanes(rows, length, eos):
    out = {}
    for lane in {r[1] for r in rows}:
        flat = [x for _, k, ids in rows if k == lane for x in [*(ids or []), eos]]
        out |= {(lane, c): flat[c * length:(c + 1) * length] for c in range(len(flat) // length)}
    return out


def test_lanes_survive_restarts(spark, tmp_path):
    r = random.Random(9)
    rows = [(i, i % 2, [i * 100 + j for j in range(r.randint(0, 40))]) for i in range(60)]
    src = f"{tmp_path}/t"
    table = st.StreamTable(src, spark.createDataFrame([], LANES).schema)
    for k in range(4):
        _add(spark, src, rows[k * 15:k * 15 + 15], LANES, k)
        st.pack_lanes(st.read_stream(spark, table, files_per_trigger=1), f"{tmp_path}/out", f"{tmp_path}/ck", 16, eos_id=7)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {(x.lane, x.chunk_id): list(x.input_ids) for x in got} == _lanes(rows, 16, 7) and all(x.input_ids == x.labels for x in got)
    assert len(got) == len(_lanes(rows, 16, 7))


def test_lanes_go_on_after_a_query_that_was_stopped_in_between(spark, tmp_path):
    """A query is stopped while batches are left; the next one goes on."""
    rows = [(i, 0, list(range(i * 10, i * 10 + 9))) for i in range(40)]
    src = f"{tmp_path}/t"
    table = st.StreamTable(src, spark.createDataFrame([], LANES).schema)
    for k in range(8):
        _add(spark, src, rows[k * 5:k * 5 + 5], LANES, k)
    from tidepool.operators.tokens import append_eos
    from tidepool.streaming.state import lane_chunks, state_store
    stream = append_eos(st.read_stream(spark, table, files_per_trigger=1), 7)
    with state_store(spark):
        q = (lane_chunks(stream, 16, "lane", "doc_id", "input_ids").writeStream.format("parquet").option("path", f"{tmp_path}/out")
             .option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").start())
        end = time.time() + 90
        while len(list((tmp_path / "ck" / "commits").glob("[0-9]*") if (tmp_path / "ck" / "commits").exists() else [])) < 2 and time.time() < end:
            time.sleep(0.1)
        q.stop()
    done = len(list((tmp_path / "ck" / "commits").glob("[0-9]*")))
    assert 2 <= done
    st.pack_lanes(st.read_stream(spark, table, files_per_trigger=1), f"{tmp_path}/out", f"{tmp_path}/ck", 16, eos_id=7)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {(x.lane, x.chunk_id): list(x.input_ids) for x in got} == _lanes(rows, 16, 7) and len(got) == len(_lanes(rows, 16, 7))


def test_audited_stream_counts_each_batch_once(spark, tmp_path):
    src = f"{tmp_path}/t"
    for k in range(3):
        _add(spark, src, [(k * 10 + i, None if i == 0 else i) for i in range(10)], "k long, v long", k)
    s = st.read_stream(spark, st.StreamTable(src, spark.createDataFrame([], "k long, v long").schema), files_per_trigger=1)
    checks = {"null": F.col("v").isNull(), "big": F.col("v") > 6}
    for _ in range(2):  # the second run finds nothing new
        got = {r.reason: r.n for r in st.write_audited(s, checks, f"{tmp_path}/out", f"{tmp_path}/ck").collect()}
    assert got == {"null": 3, "big": 9, "kept": 18} and spark.read.parquet(f"{tmp_path}/out").count() == 18


def test_streams_in_order_after_dying_in_the_second(spark, tmp_path, monkeypatch):
    schema = "doc_id long"
    for name, files in (("a", 2), ("b", 4), ("c", 1)):
        for k in range(files):
            _add(spark, f"{tmp_path}/{name}", [(k * 10 + i,) for i in range(10)], schema, k)
    load = lambda: [st.read_stream(spark, st.StreamTable(f"{tmp_path}/{x}", spark.createDataFrame([], schema).schema), 1) for x in "abc"]
    rank, calls = st.global_rank, []

    def dies(*args, **options):
        calls.append(1)
        if len(calls) == 5:  # the third batch of the second source
            raise Killed("between two batches")
        return rank(*args, **options)

    monkeypatch.setattr(st, "global_rank", dies)
    with pytest.raises(Exception):
        st.concat_streams(load(), f"{tmp_path}/out", f"{tmp_path}/ck", "doc_id")
    st.concat_streams(load(), f"{tmp_path}/out", f"{tmp_path}/ck", "doc_id")
    st.concat_streams(load(), f"{tmp_path}/out", f"{tmp_path}/ck", "doc_id")  # all are used up
    got = sorted((r.position, r.source_rank, r.doc_id) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = [(0, i) for i in range(20)] + [(1, i) for i in range(40)] + [(2, i) for i in range(10)]
    assert got == [(k, s, i) for k, (s, i) in enumerate(want)]
