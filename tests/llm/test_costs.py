"""Memory of workers, hashes of whole texts, alignment and interval tests
against plain ones."""
import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from tidepool.llm import align, bpe_index, common, gru_lm, hashing, langid, shingle_join, substring


def test_language_vectors_take_a_byte_a_dimension():
    p = langid.Profiles(64)
    assert p.vectors.nbytes == langid.HELD * 64
    texts = ["".join(random.Random(k).choices("abcdefghijklmnopqrstuvwxyz ", k=3000)) for k in range(3)]
    made = p.vectors_of(list(enumerate(texts)), 3)
    assert len(p.held) > langid.CHUNK  # more than one chunk was added up
    for t, v in zip(texts, made):
        alone = np.zeros(64)
        slots = [0, *(ord(c) if c.isalpha() else 0 for c in t), 0]
        for a, b, c in zip(slots, slots[1:], slots[2:]):
            if b:
                alone += p.letters[0][a] * p.letters[1][b] * p.letters[2][c]
        assert (v == alone).all()


def test_batches_follow_the_operator_and_the_session(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    df, before = spark.range(1), spark.conf.get(key)
    try:
        for bound, small, plain in (("256m", "4m", "16m"), ("1m", "1m", "1m"), ("8m", "4m", "8m")):
            spark.conf.set(key, bound)
            for most, want in ((common.SMALL_BATCH, small), (common.BATCH, plain), (common.SMALL_BATCH, small)):
                common.in_batches(df, most)
                assert spark.conf.get(key) == want
    finally:
        spark.conf.set(key, before)


def _task(made, batch):
    """What a task of ``made(docs)`` gives back for a batch."""
    run = made(SimpleNamespace(mapInArrow=lambda f, ddl: f))
    return list(run(iter([batch])))


def test_workers_give_back_batches_of_bounded_size(monkeypatch):
    monkeypatch.setattr(substring, "in_batches", lambda df, *most: df)
    monkeypatch.setattr(shingle_join, "in_batches", lambda df, *most: df)
    rng = random.Random(6)
    words = [f"w{k}" for k in range(40_000)]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(12_000)]
    texts += texts[:2000]  # rows of the second kind
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    for made in (lambda df: substring.windows(df, 5, 50, 4), lambda df: shingle_join.signatures(df, 4, 85)):
        got = _task(made, batch)
        assert sum(b.num_rows for b in got) > common.ROWS >= max(b.num_rows for b in got)
    whole = pa.RecordBatch.from_arrays([pa.array(range(10))], ["x"])
    assert [b.num_rows for b in common.pieces(whole, 4)] == [4, 4, 2]
    assert pa.Table.from_batches(common.pieces(whole, 4)).column(0).to_pylist() == list(range(10))


def test_alignment_keeps_ids_as_numbers_and_compares_bytes_only_where_it_must():
    pair = align.pair_of(common.tokenizer_file("byte_bpe_50k.json"), common.tokenizer_file("piece_bpe_32k.model"))
    assert pair.exact_b
    rng = random.Random(12)
    texts = [None, "", " ", "▁", "a▁b", "\x00 \t\r\n", "<s> </s> <unk> <0x41>", "ﬁ e\u0301 \xa0\u3000 🙂", "  x ", "|".join("ab" * 4000)]
    texts += ["".join(rng.choices("ab 1.é\n▁日<>\r\u2003", k=rng.randint(1, 60))) for _ in range(400)]
    made = []
    for exact in (True, False):
        pair.known, pair.exact_b = {}, exact
        made.append(pair.encode(texts))
        made.append(pair.encode(texts))  # the pieces are known now
    pair.exact_b = True
    assert all(m == made[0] for m in made[1:])
    for t, a, b in zip(texts, *made[0]):
        a = np.frombuffer(a, np.int32).tolist()
        want_a, want_b = pair.a.encode(f" {t}", add_special_tokens=False).ids if t else [], pair.b.encode(t or "")
        if not t or any(b"".join(map(of.__getitem__, ids)) != f" {t}".encode() for of, ids in ((pair.bytes_a, want_a), (pair.bytes_b, want_b))):
            want_a, want_b = [], []
        assert (a, b) == (want_a, want_b)


def test_word_hashes_tell_words_apart(monkeypatch):
    rng = random.Random(3)
    texts = ["", " \t\n", "One", " a b  a ", "ÄB äb  x", "a" * 50 + " " + "b" * 70]
    texts += ["".join(rng.choices("abAB é\n\x1c\x0b", k=rng.randint(1, 400))) for _ in range(200)]
    seen = {}
    for piece in (hashing.PIECE, 16):
        monkeypatch.setattr(hashing, "PIECE", piece)
        for t in texts:
            words, h = hashing.words_of(t), hashing.word_hashes(t).tolist()
            assert len(words) == len(h)
            for w, x in zip(words, h):
                assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    assert len(hashing.word_hashes(None)) == 0


def _plain_chains(runs, gap):
    """Each run goes on from the best of all runs before it."""
    score, back, part = [], [], []
    for k, (i, j, p, q) in enumerate(runs):
        best, prev, own = j - i + 1, -1, [i, j, p, q]
        for x in range(k):
            e, f = runs[x][1], runs[x][3]
            cut = max(0, e + 1 - i, f + 1 - p)
            if e >= i - gap - 1 and i + cut <= j and i + cut - e <= gap + 1 and p + cut - f <= gap + 1 and score[x] + j - i + 1 - cut > best:
                best, prev, own = score[x] + j - i + 1 - cut, x, [i + cut, j, p + cut, q]
        score.append(best)
        back.append(prev)
        part.append(own)
    out = []
    for k in range(len(runs)):
        if k not in back:
            chain, x = [], k
            while x >= 0:
                chain.append(part[x] if back[x] >= 0 else runs[x])
                x = back[x]
            out.append(chain[::-1])
    return out


def test_chains_equal_those_of_all_pairs_of_runs():
    rng = np.random.default_rng(5)
    many = 0
    for k in range(60):
        a = rng.integers(0, 6 + k, 150)
        b = np.concatenate((rng.integers(0, 6 + k, 20), np.where(rng.random(150) < 0.1, 99, a), a[:60]))
        runs = substring._runs(a.astype(np.uint64), b.astype(np.uint64), 20, 10)
        assert substring._chains(runs, 10) == _plain_chains(runs, 10)
        many += len(runs)
    assert many > 10_000


def test_uncovered_equals_all_spans(spark):
    rng = random.Random(8)
    spans = [(rng.randint(1, 4), a := rng.randint(0, 80), a + rng.randint(1, 25)) for _ in range(30)]
    rows = [(rng.choice([1, 2, 3, 4, 5, None]), lo := rng.randint(0, 100), lo + rng.randint(1, 12)) for _ in range(300)]
    got = substring._uncovered(spark.createDataFrame(rows, "id long, lo long, hi long"), spark.createDataFrame(spans, "doc_id long, first_word long, end_word long"),
                               substring.F.col("lo"), substring.F.col("hi"))
    want = [r for r in rows if not any(r[0] == d and a <= r[1] and r[2] <= z for d, a, z in spans)]
    assert 0 < len(want) < len(rows)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_gates_equal_the_plain_steps():
    """States of a window, step by step, with texts that begin within it."""
    v = gru_lm.Vocabulary([b"a", b"b", b"c"], [5, 4, 3], 15, 4)
    rng = np.random.default_rng(2)
    n = rng.integers(1, 9, 900)
    lanes, unit = gru_lm.Lanes(v, rng.integers(0, 4, int(n.sum())), n), gru_lm.Unit(gru_lm.first_weights(v))
    place, _ = next(lanes.windows())
    h = np.zeros((place.shape[1], gru_lm.HIDDEN), np.float32)
    states, n = unit.forward(lanes, place, h.copy(), True)[1], gru_lm.HIDDEN
    for t, at in enumerate(place):
        h = h * ~lanes.fresh[at][:, None]
        x, a = unit.w["G"][lanes.input[at]], h @ unit.w["U"]
        z, r = (1 / (1 + np.exp(-(x[:, k:k + n] + a[:, k:k + n]))) for k in (0, n))
        c = np.tanh(x[:, 2 * n:] + r * a[:, 2 * n:])
        h = (1 - z) * c + z * h
        assert np.allclose(states[t], h, atol=1e-6)


def test_components_stop_at_stars(spark, monkeypatch):
    """Stars are looked at once; paths and repeated edges give the same
    components with and without broadcast tables."""
    steps, saved = [], common.saved
    monkeypatch.setattr(common, "saved", lambda df, name: steps.append(name) or saved(df, name))
    stars = spark.createDataFrame([(2, 1), (1, 3), (9, 7), (2, 1)], "a long, b long")
    assert {(r.id, r.component) for r in common.components(stars).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (9, 7)}
    assert steps == ["cc", "low"]
    ids = random.Random(4).sample(range(100), 12)
    path = spark.createDataFrame([*zip(ids, ids[1:]), *zip(ids[1:6], ids), (200, 201), (201, 200)], "a long, b long")
    want = {(i, min(ids)) for i in ids} | {(200, 200), (201, 200)}
    for few in (True, False):
        monkeypatch.setattr(common, "fits", lambda df, few=few: few)
        got = common.components(path).collect()
        assert len(got) == len(want) and {(r.id, r.component) for r in got} == want


def test_workers_let_go_of_what_others_kept(monkeypatch):
    monkeypatch.setattr(common, "_kept", [])
    made = []
    f = common.kept(lambda x: made.append(x) or [x])
    assert f(1) is f(1) and made == [1]
    common.let_go()
    assert f(1) == [1] and made == [1, 1]


def test_joins_let_go_of_what_the_encoder_kept(monkeypatch):
    class Maps:
        def mapInArrow(self, run, ddl):
            self.run = run

    maps, path = Maps(), common.tokenizer_file("word_bpe_49k.json")
    for module, make in ((shingle_join, lambda: shingle_join.signatures(None, 4, 85)), (substring, lambda: substring.windows(None, 5, 50, 4))):
        monkeypatch.setattr(module, "in_batches", lambda df, *most: maps)
        make()
        bpe_index.index_of(path)
        assert list(maps.run(iter([]))) == [] and bpe_index.index_of.cache_info().currsize == 0


def test_encoder_keeps_ids_as_bytes_and_works_on_small_slices(monkeypatch):
    monkeypatch.setattr(bpe_index, "in_batches", lambda df, *most: df)
    sizes, path = [], common.tokenizer_file("word_bpe_49k.json")
    plain = bpe_index.PairIndex.encode
    monkeypatch.setattr(bpe_index.PairIndex, "encode", lambda self, texts: sizes.append(sum(map(len, texts))) or plain(self, texts))
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdefgh é.", k=50_000)) for _ in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array(texts)], ["doc_id", "text"])
    docs = SimpleNamespace(select=lambda *c: SimpleNamespace(mapInArrow=lambda f, ddl: f))
    monkeypatch.setattr(bpe_index, "F", SimpleNamespace(col=lambda c: SimpleNamespace(cast=lambda t: SimpleNamespace(alias=lambda a: c), alias=lambda a: c)))
    got = pa.Table.from_batches(bpe_index.encode_decode(docs, path)(iter([batch])))
    assert len(sizes) > 1 and max(sizes) <= bpe_index.SLICE
    index = bpe_index.index_of(path)
    assert all(type(ids) is bytes for ids in index.cache.values())
    ids, ends = plain(bpe_index.PairIndex(path), texts)  # all at once
    assert got["ids"].to_pylist() == [ids[a:z].tolist() for a, z in zip(ends, ends[1:])]
