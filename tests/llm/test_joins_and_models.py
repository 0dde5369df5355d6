"""Join and model operators against brute force, gradients by differences,
held-out accuracy."""
import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.llm import common, embed_join, gru_lm, langid, shingle_join, substring

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, DOC_ID2 string"


def _components(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(40)] + [(5, 5), (None, 3)]
    got = {x.id: x.component for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = _components({x for e in edges if None not in e for x in e}, [e for e in edges if None not in e])
    assert {k: v for k, v in want.items() if k in got} == got and all(want[k] == k for k in want.keys() - got.keys())
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_language_vectors_equal_the_definition():
    p = langid.Profiles(256, 3)
    texts = ["Hello wörld, ABC 1x", "", "日本 a", "x" * 50 + " é", "ΑΣ 𐐀b"]

    def plain(t):
        out = np.zeros(256)
        s = [0, *(langid._slot(ord(c)) if c.isalpha() else 0 for c in t.lower()), 0]
        for i in range(1, len(s) - 1):
            if s[i]:
                out += p.letters[0][s[i - 1]].astype(int) * p.letters[1][s[i]] * p.letters[2][s[i + 1]]
        return out

    for t, v in zip(texts, p.vectors_of(list(enumerate(texts)), len(texts))):
        assert (plain(t) == v).all()


def test_language_pieces_and_full_tables_change_nothing(monkeypatch):
    r = random.Random(2)
    texts = ["".join(r.choice("abcdefghijklmnop é") for _ in range(3000)) for _ in range(4)]
    whole = langid.Profiles(64).vectors_of(list(enumerate(texts)), 4)
    monkeypatch.setattr(langid, "PIECE", 200)
    monkeypatch.setattr(langid, "HELD", 90)
    assert (langid.Profiles(64).vectors_of(list(enumerate(texts)), 4) == whole).all()


def test_language_accuracy_and_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rem = langid.fold(F.col("doc_id"), 4)
    made = langid.predict(docs, langid.learn(docs.where(rem != 2))).where(rem == 2)
    right, n = made.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right / n > 0.98
    rows = spark.createDataFrame([(1, "12 !", "en"), (2, None, None), (3, "", "x"), (4, "the and of " * 9, "en"), (None, "der die das und", "de")], "doc_id long, text string, lang string")
    learnt = langid.learn(rows)
    got = {r.doc_id: r for r in langid.predict(rows, learnt).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, None)] == ["und", "und", "und", "en", "de"] and got[1].score == 0 and 0 < got[4].score <= 1
    assert {r.lang_pred for r in langid.predict(rows, langid.learn(rows.limit(0))).collect()} == {"und"}
    assert langid.predict(rows.limit(0), learnt).count() == 0
    assert [crc32(str(i).encode()) % 4 for i in range(9)] == [r[0] for r in spark.range(9).select(langid.fold(F.col("id"), 4)).collect()]


def _sets(t, k):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\xa0", "\x00").encode().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def _near_docs(seed, n):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [[r.choice(vocab) for _ in range(r.choice([2, 3, 8, 20, 60, 150]))] for _ in range(8)]
    line = [f"line{i}" for i in range(9)]
    out = []
    for i in range(n):
        w = list(r.choice(base)) if r.random() < 0.8 else [r.choice(vocab) for _ in range(r.randint(0, 80))]
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            if w:
                w[r.randrange(len(w))] = r.choice(vocab)
        if r.random() < 0.3:
            w = w + line
        out.append((i, (" " if r.random() < 0.5 else "\n\t").join(x.upper() if r.random() < 0.1 else x for x in w), "x"))
    return out + [(n, None, "x"), (n + 1, "  \n ", "x"), (n + 2, "", "x")]


@pytest.mark.parametrize("seed", [1, 2])
def test_shingle_join_equals_brute_force(spark, seed):
    docs = _near_docs(seed, 220)
    sets = {i: _sets(t, 4) for i, t, _ in docs}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = _components(sets, links)
    got = shingle_join.near_duplicates(spark.createDataFrame(docs, DOCS).repartition(5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), want[i]) for i in sets}


def test_shingle_join_edges(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A  b c d e f"), (3, "x y"), (4, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in shingle_join.near_duplicates(df).collect())
    assert got == [(0, 3, 0), (1, 3, 1), (1, 3, 1), (2, 3, 1), (3, 1, 3), (4, 1, 3)]
    assert shingle_join.near_duplicates(df.limit(0)).count() == 0


def test_blocks_of_linked_sets_meet():
    r, bands, tried = np.random.default_rng(4), shingle_join.Bands(), 0
    for _ in range(2000):
        n = int(r.integers(7, 500))
        base = r.integers(0, 1 << 63, n + 200).astype(np.uint64) * np.uint64(2)
        a, k = np.unique(base[:n]), int(r.integers(0, max(1, n // 6)))
        b = np.unique(np.concatenate((np.delete(base[:n], r.permutation(n)[:k]), base[n:n + int(r.integers(0, k + 1))])))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both) and not np.array_equal(a, b):
            tried += 1
            assert len(np.intersect1d(shingle_join.block_keys(a, bands), shingle_join.block_keys(b, bands)))
    assert tried > 500


def test_embeddings_equal_brute_force(spark):
    r = np.random.default_rng(5)
    base = r.standard_normal((12, 16))
    rows = []
    for i in range(260):
        v = base[r.integers(12)] + r.standard_normal(16) * r.choice([0, 0.05, 0.15, 0.25])
        rows.append((i, [float(x) for x in np.float32(v)], int(r.integers(2))))
    rows += [(300, None, 0), (301, [0.0] * 16, 0), (302, [None] + [1.0] * 15, 0), (303, [float("nan")] * 16, 1), (304, rows[0][1], None),
             (305, [], 1), (306, rows[0][1], rows[0][2]), (307, [2 * x for x in rows[0][1]], rows[0][2]), (308, rows[0][1][:8], rows[0][2])]
    got = {x.vec_id: x for x in embed_join.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}

    def usable(v, lab):
        return lab is not None and bool(v) and None not in v and np.isfinite(v).all() and any(v)

    def cos(a, b):
        a, b = np.float64(np.float32(a)), np.float64(np.float32(b))
        return a @ b / math.sqrt(a @ a) / math.sqrt(b @ b)

    links = [(a, b) for a, va, la in rows for b, vb, lb in rows if a < b and usable(va, la) and usable(vb, lb) and la == lb and len(va) == len(vb) and cos(va, vb) >= 0.98]
    deg, part = Counter(x for e in links for x in e), _components([r_[0] for r_ in rows], links)
    assert len(links) > 100
    assert {i: (x.n_links, x.component_id, x.kept) for i, x in got.items()} == {r_[0]: (deg[r_[0]], part[r_[0]], part[r_[0]] == r_[0]) for r_ in rows}
    assert embed_join.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_pivots_and_extents_equal_brute_force():
    r = np.random.default_rng(1)
    for turn in range(200):
        n, width = r.integers(1, 30, 5), int(r.integers(2, 9))
        h = (r.integers(1, 12, n.sum()) if turn % 2 else r.permutation(int(n.sum())) + 1).astype(np.uint64)
        start, end = np.repeat(np.cumsum(n) - n, n), np.repeat(np.cumsum(n), n)
        at, want = substring.pivots(h, start, end, width), set()
        for a, b in zip(np.cumsum(n) - n, np.cumsum(n)):
            for i in range(a, b - width + 1):
                want |= {j for j in range(i, i + width) if h[j] == h[i:i + width].min()}
        assert set(at.tolist()) == want
        left, right = substring.extents(h, at, start, end)
        for c, lo, hi in zip(at, left, right) if not turn % 2 else ():
            assert (h[lo:hi + 1] >= h[c]).all() and (lo == start[c] or h[lo - 1] < h[c]) and (hi == end[c] - 1 or h[hi + 1] < h[c])


def _passages(seed):
    r = random.Random(seed)
    vocab = [f"v{i}" for i in range(3000)]
    word = lambda n: [r.choice(vocab) for _ in range(n)]
    long, line, other = word(51), word(30), word(120)
    docs, hold = [], {}
    for i in range(60):
        kind = r.choice(["none", "long", "line", "other", "both", "edit", "short"])
        w = word(r.randint(0, 150))
        put = {"none": [], "long": long, "line": line, "other": other, "both": long + word(5) + other, "short": long[:40],
               "edit": other[:30] + ["new"] + other[31:90] + ["two"] + other[91:]}[kind]
        docs.append((i, " ".join(w + put + word(r.randint(0, 40))), "x"))
        hold[i] = (kind, len(w), len(put))
    return docs, hold


def test_repeated_passages(spark):
    docs, hold = _passages(6)
    spans = substring.repeated_passages(spark.createDataFrame(docs, DOCS)).collect()
    first = {}
    for i, (kind, at, n) in hold.items():
        mine = [s for s in spans if s.doc_id == i]
        for s in mine:
            a, b = docs[i][1].split()[s.first_word:s.end_word], docs[s.source_id][1].split()[s.source_first:s.source_end]
            x, y = ({tuple(p[j:j + 5]) for j in range(len(p) - 4)} for p in (a, b))
            assert s.source_id < i and len(a) >= 50 and len(x & y) / len(x | y) >= 0.8 - 1e-9
        if kind in ("none", "line", "short"):
            assert not mine
            continue
        group = {"both": ["long", "other"], "edit": ["other"]}.get(kind, [kind])
        again = all(g in first for g in group)
        for g in group:
            first.setdefault(g, i)
        if again:
            gone = {j for s in mine for j in range(s.first_word, s.end_word)}
            assert len(gone & set(range(at, at + n))) >= n - 6, (i, kind)
    kept = {r.doc_id: r.text for r in substring.drop_repeats(spark.createDataFrame(docs, DOCS)).collect()}
    for i, (kind, at, n) in hold.items():
        if kind in ("none", "line", "short"):
            assert kept[i] == docs[i][1]
    probe = " ".join(docs[first["long"]][1].split()[hold[first["long"]][1]:][:51])
    assert sum(probe in (t or "") for t in kept.values()) == 1


def _spans(a, b):
    w = substring.WordHashes()
    return substring.matching_spans(w.shingles(a, 5), w.shingles(b, 5), 46, 0.8)


def test_spans_hold_every_exact_passage_of_texts_with_repeated_lines():
    r = random.Random(8)
    new = lambda n: [b"%d" % r.getrandbits(60) for _ in range(n)]
    p = new(60)
    assert _spans(new(9) + p + new(9), p[:15] + new(30) + p + new(5)) == [(9, 64, 45, 100, 1.0)]
    for n, line in ((51, 6), (70, 30)):  # its head, and its tail, stand once more
        for q in (p[:0] + new(n),):
            for b in (q[:line] + new(20) + q, q + new(20) + q[-line:], q[:line] + q, q[-line:] + q):
                assert any(i <= 7 and z >= 7 + n - 5 for i, z, *_ in _spans(new(7) + q + new(7), b))
    edit = p[:30] + new(1) + p[31:]
    assert _spans(edit, p[25:30] + new(3) + p + new(9) + p[33:38]) and _spans(p, edit)
    lines = [new(12) for _ in range(4)]
    for _ in range(60):
        a, b = ([w for _ in range(14) for w in (r.choice(lines) if r.random() < 0.7 else new(r.randint(1, 9)))] for _ in range(2))
        grams = {tuple(b[i:i + 50]) for i in range(len(b) - 49)}
        got = _spans(a, b)
        for i in range(len(a) - 49):
            if tuple(a[i:i + 50]) in grams:
                assert any(x <= i and i + 45 <= z for x, z, *_ in got)
        for x, z, u, v, alike in got:
            one, two = ({tuple(t[k:k + 5]) for k in range(f, l + 1)} for t, f, l in ((a, x, z), (b, u, v)))
            assert z - x >= 45 and abs(len(one & two) / len(one | two) - alike) < 1e-9 and alike >= 0.8


def test_exact_passages_are_found_behind_partial_copies(spark):
    r = random.Random(12)
    new = lambda n: [f"n{r.getrandbits(50)}" for _ in range(n)]
    rows, want = [], []
    for g in range(12):  # two documents hold its first and last words, two the whole of it
        p, at = new(60 if g % 2 else 50), 10 * g
        for k, part in enumerate((p[:-1 if g % 2 == 0 else 49], p[1 if g % 2 == 0 else -49:], p, p)):
            rows.append((at + k, " ".join(new(40) + part + new(40))))
        want.append((at + 3, 40, 40 + len(p)))
    spans = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    for i, a, z in want:
        assert any(s.doc_id == i and s.first_word <= a and z <= s.end_word for s in spans)


def test_repeated_passages_edges(spark):
    same = " ".join(f"w{i}" for i in range(60))
    rows = [(1, same + " " + same), (2, None), (3, ""), (4, "short one"), (None, same), (5, "Before " + same.upper() + " after"), (5, "x " + same)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    spans = substring.repeated_passages(df).collect()
    assert {s.doc_id for s in spans} == {5} and {s.source_id for s in spans} == {1}
    out = substring.drop_repeats(df).collect()
    assert sorted(str(r.text) for r in out if r.doc_id == 5) == ["Before  after", "x "] and all(r.n_chars is None or r.n_chars == len(r.text) for r in out)
    assert len(out) == 7 and substring.drop_repeats(df.limit(0)).count() == 0


def test_unit_gradient_and_learning():
    r = np.random.default_rng(1)
    words = [b"w%d" % i for i in range(50)]
    vocab = gru_lm.Vocabulary([b"", *words], [20, *(100 - i for i in range(50))], 4000, 60)
    ids, n, _ = vocab.indexes([" ".join("w%d" % x for x in r.integers(0, 60, int(r.integers(0, 30)))) for _ in range(40)])
    lanes = gru_lm.Lanes(vocab, ids, n)
    w = {k: v.astype(np.float64) for k, v in gru_lm.first_weights(vocab).items()}
    place, mask = next(iter(lanes.windows()))
    h0 = np.zeros((place.shape[1], gru_lm.HIDDEN))

    def loss(w):
        unit = gru_lm.Unit(w)
        unit.w = w
        _, _, logits, _, norm, _, _ = unit.forward(lanes, place, h0, False)
        own = np.take_along_axis(logits, lanes.target[place].reshape(-1, 1), 1) - np.log(norm)
        return -(own.ravel() * mask.ravel()).sum() / mask.sum()

    unit, got = gru_lm.Unit(w), {}
    unit.w, unit._step = w, got.update
    unit._learn(lanes, place, mask, h0)
    for k in w:
        for _ in range(5):
            i = tuple(int(r.integers(0, s)) for s in w[k].shape)
            if k == "G":
                i = (int(lanes.input[place].ravel()[0]), i[1])
            a, b = dict(w), dict(w)
            a[k], b[k] = w[k].copy(), w[k].copy()
            a[k][i] += 3e-3
            b[k][i] -= 3e-3
            assert abs((loss(a) - loss(b)) / 6e-3 - got[k][i]) < 2e-5
    unit = gru_lm.Unit(gru_lm.first_weights(vocab))
    before = unit.score(lanes).sum()
    for _ in range(20):
        unit.train(lanes)
    assert unit.score(lanes).sum() > before


def test_unit_keeps_its_size():
    # a state, an input vector or a class fewer is a smaller model
    assert gru_lm.HIDDEN >= 24
    words, topic = [b"w%d" % i for i in range(3000)], np.arange(3001) % 8
    vocab = gru_lm.Vocabulary([b"", *words], [20, *(4000 - i for i in range(3000))], 10 ** 7, 4000, topic)
    assert len(set(vocab.input[:1024].tolist())) == 1024 and len(set(vocab.cls.tolist())) == 2 + 8 * 5 == vocab.classes
    assert gru_lm.first_weights(vocab)["U"].shape == (gru_lm.HIDDEN, 3 * gru_lm.HIDDEN)


def test_encoded_slices_hold_every_text():
    n = np.array([3, 1, 9, 1, 4])
    column = gru_lm.pa.array([np.arange(k, dtype=np.int32).tobytes() for k in n])
    for col, want in ((column, n), (column.slice(1, 3), n[1:4])):
        got = list(gru_lm.id_slices(col, 5, 2))
        assert [at for at, _, _ in got] == [sum(len(x) for _, _, x in got[:k]) for k in range(len(got))]
        assert np.concatenate([x for _, _, x in got]).tolist() == want.tolist()
        assert np.concatenate([i for _, i, _ in got]).tolist() == [j for k in want for j in range(k)]


def test_lanes_carry_the_state_over_whole_texts(monkeypatch):
    words = [b"w%d" % i for i in range(9)]
    vocab = gru_lm.Vocabulary([b"", *words], [5, *range(20, 11, -1)], 200, 10)
    unit = gru_lm.Unit(gru_lm.first_weights(vocab))
    texts = [" ".join("w%d" % ((i * j) % 9) for j in range(i * 7)) for i in range(9)]

    def scores():
        ids, n, _ = vocab.indexes(texts)
        return np.add.reduceat(unit.score(gru_lm.Lanes(vocab, ids, n)), np.cumsum(n) - n)

    want = scores()
    for window, lanes in ((1, 512), (5, 2), (100, 3)):
        monkeypatch.setattr(gru_lm, "WINDOW", window)
        monkeypatch.setattr(gru_lm, "LANES", lanes)
        assert np.allclose(scores(), want, atol=1e-4)


@pytest.mark.parametrize("head", [300_000, 40])
def test_scores_and_base_equal_the_definition(spark, monkeypatch, head):
    monkeypatch.setattr(gru_lm, "HEAD", head)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(120)
    docs = docs.union(spark.createDataFrame([(10_000, None), (10_001, ""), (10_002, "Zzz zzz unseen"), (None, "the of")], "doc_id long, text string"))
    rows = docs.collect()
    words = {r.doc_id: ("".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "").encode().split()) for r in rows}
    held = {i: i is not None and crc32(str(i).encode()) % 7 == 2 for i in words}
    counts = Counter(w for i, ws in words.items() if i is not None and not held[i] for w in [*ws, b""])
    total, distinct = sum(counts.values()), len(counts)
    c, broad, weights = gru_lm.learn(docs.where(langid.fold(F.col("doc_id"), 7) != 2), head=head)
    assert (broad.value.total, broad.value.distinct) == (total, distinct)
    # all words and one unseen word share a probability of 1
    v = broad.value
    unit = gru_lm.Unit(weights)
    got = {r.doc_id: r for r in gru_lm.score(docs, c, broad, weights).collect()}
    assert len(got) == len(rows)
    for i, ws in words.items():
        tokens = [*ws, b""]
        assert (got[i].n_tokens, got[i].n_known) == (len(tokens), sum(counts[w] > 0 for w in tokens))
        assert math.isclose(got[i].base_score, sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens), rel_tol=1e-9)
        ids, n, _ = v.indexes([b" ".join(ws).decode()])
        lanes = gru_lm.Lanes(v, ids, n)
        own = unit.score(lanes).sum() + v.share[ids].sum() + sum(math.log10((counts[w] + 1) / v.tail_mass) for w, k in zip(tokens, ids) if k < 0)
        assert math.isclose(got[i].score, own, rel_tol=1e-4) and got[i].score < 0
    share = 10.0 ** v.share[:len(v.words)]
    by_class = np.bincount(v.cls[:-1], share, v.classes)
    assert np.allclose(by_class[np.unique(v.cls[1:-1])], 1)
    tail = sum(k + 1 for w, k in counts.items() if w not in v.index) + 1
    assert tail == v.tail_mass


def test_model_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    out = gru_lm.language_model_scores(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]
    assert gru_lm.language_model_scores(docs.limit(0)).count() == 0
