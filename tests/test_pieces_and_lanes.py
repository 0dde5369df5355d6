"""Rows of a task are decoded in pieces of bounded ids; runs share a state."""
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidepool.operators import metric_state as ms, tokens as tk
from tidepool.streaming import state, streams as st


def test_pieces_hold_at_most_so_many_ids():
    lists = [[1] * 3, None, [], [2] * 4, [3] * 50, [4], [5] * 9, []]
    batch = pa.record_batch({"k": pa.array(range(8)), "ids": pa.array(lists, pa.list_(pa.int64()))})
    for b, rows in ((batch, lists), (batch.slice(2, 5), lists[2:7]), (batch.slice(0, 0), [])):
        got = list(tk._pieces(b, 1, size=10))
        assert [x for p in got for x in p.column(1).to_pylist()] == rows
        assert all(p.num_rows == 1 or len(p.column(1).flatten()) <= 10 for p in got)
    assert len(list(tk._pieces(batch, 1, size=10))) == 3


def test_decoding_in_pieces_keeps_unknown_and_skipped_ids(spark, monkeypatch):
    vocab = spark.createDataFrame([(k, f"w{k}") for k in range(50)] + [(3, "a3")], "id long, token string")
    r = np.random.default_rng(1)
    rows = [(k, None if k % 17 == 0 else [int(x) for x in r.integers(0, 60, k % 13)]) for k in range(200)]
    d = spark.createDataFrame(rows, "k int, input_ids array<long>")

    def word(i):
        return "a3" if i == 3 else f"w{i}" if i < 50 else f"<unk:{i}>"

    want = {k: " ".join(word(i) for i in ids or [] if i != 7) for k, ids in rows}
    for limit in (1 << 26, 200):  # one shard and several
        monkeypatch.setattr(tk, "VOCAB_BYTES", limit)
        assert {x.k: x.decoded for x in tk.decode(d, vocab, skip_ids=[7]).collect()} == want


def test_runs_share_the_state_of_a_lane(spark, tmp_path, monkeypatch):
    """As many runs as you like take one call a lane and micro-batch."""
    src, log = f"{tmp_path}/log", "run string, at long, id long, mark boolean, split string, v double"
    rows = [(None if k % 41 == 0 else f"r{k % 41}", k, k, k % 11 == 0, ("train", "eval", None)[k % 3], None if k % 5 == 0 else float(k)) for k in range(900)]
    for part in range(3):  # some runs have no row in some micro-batches
        mine = [x for x in rows if x[1] // 300 == part and (part != 1 or x[0] in (None, "r1", "r2"))]
        spark.createDataFrame(mine, log).coalesce(1).write.parquet(f"{src}/part={part}")
    rows = [x for x in rows if x[1] // 300 != 1 or x[0] in (None, "r1", "r2")]
    metrics = ms.Metrics({"loss": ms.Metric(F.col("v"))})
    s = st.read_stream(spark, st.StreamTable(src, spark.createDataFrame([], log).schema), files_per_trigger=1)
    columns = dict(run="run", at=F.col("at"), tiebreak=F.col("id"), is_mark=F.col("mark"), split=F.col("split"))
    st.interval_metrics(s, metrics, f"{tmp_path}/out", f"{tmp_path}/ck", lanes=2, **columns)
    got = st.latest(spark, f"{tmp_path}/out", ["run", "eval_interval", "split", "metric"]).collect()
    want, marks = {}, {}
    for run, _, _, mark, split, v in rows:
        marks[run] = marks.get(run, 0) + mark
        if not mark and v is not None:
            want.setdefault((run, marks[run], split), []).append(v)
    assert {(x.run, x.eval_interval, x.split): (x.total, x.weight, x["rows"]) for x in got} == {k: (sum(v), len(v), len(v)) for k, v in want.items()}
    assert state.LANES > 1
