"""Personal data, token alignment and the manifest against plain versions."""
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidepool.llm import align, common, corpus_queries, merkle, sanitise

SF = "/root/testdata/sf0.001"


def _documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --------------------------------------------------------------- manifest

def _h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _leaf(row):
    return _h("".join(map(_field, row)))


def _reduce(nodes):
    """Root, and for each node the siblings (left, right) of each level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = i - i % 3
            paths[k].append(("".join(nodes[run:i]), "".join(nodes[i + 1:run + 3])))
        at = [i // 3 for i in at]
        nodes = [_h("".join(nodes[i:i + 3])) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def _plain_manifest(rows):
    """(doc_id, leaf, subroot, root, path) in any order."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0], _leaf(r)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    done = {}
    for s in names:
        own = sorted(groups[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        done[s] = (own, *_reduce([d for _, d in own]))
    root, above = _reduce([done[s][1] for s in names])
    return [(i, d, done[s][1], root, tuple(p + above[k])) for k, s in enumerate(names) for (i, d), p in zip(done[s][0], done[s][2])]


def _manifest(df, **options):
    got = merkle.manifest(df.select(F.col("source").alias("grp"), F.col("doc_id").alias("key"), merkle.leaf(*df.columns[:5]).alias("leaf")), **options)
    return [(r.key, r.leaf, r.subroot, r.root, tuple((x.left, x.right) for x in r.path)) for r in got.collect()]


def _key(r):
    return (r[0] is not None, r[0] or 0, *map(str, r[1:]))


ROWS = "doc_id long, source string, lang string, n_chars long, text string, `Leaf` string, digest string"


def test_manifest_with_nulls_ties_wide_keys_and_clashing_names(spark):
    r = random.Random(5)
    rows = [(r.choice([None, r.randint(0, 40), r.randint(-2 ** 63, 2 ** 63 - 1), 7]), r.choice(["a", "a", "a", "é", "", None]), "en", 3,
             r.choice(["x", "", None, "x\ny", "ü" * 50000])) for _ in range(400)]
    rows += [(7, "a", "en", 3, "x")] * 60 + [(k, "b", None, None, "t") for k in range(65500, 65580)] + [(2 ** 63 - 1, "z", "", 0, ""), (-2 ** 63, "z", "", 0, "")]
    df = spark.createDataFrame([(*x, "q", "q") for x in rows], ROWS)
    assert sorted(_manifest(df, levels=2), key=_key) == sorted(_plain_manifest(rows), key=_key)


def test_manifest_of_many_groups_one_row_and_no_row(spark):
    rows = [(k, f"s{k % 30}", "en", 1, str(k)) for k in range(100)]
    df = spark.createDataFrame([(*x, "", "") for x in rows], ROWS)
    assert sorted(_manifest(df), key=_key) == sorted(_plain_manifest(rows), key=_key)
    one = df.where("doc_id = 5")
    assert _manifest(one) == _plain_manifest([rows[5]])
    assert _manifest(df.limit(0)) == []


def test_manifest_query_verifies_only_what_is_untouched(spark):
    got = corpus_queries.op13(spark, SF).collect()
    docs = {r.doc_id: r.text for r in _documents(spark).collect()}
    from zlib import crc32
    for r in got:
        touched = crc32(str(r.doc_id).encode()) % 2 == 0 and "\n" in docs[r.doc_id]
        assert r.verified == (not touched) == (r.folded_root == r.root)
    assert len(got) == len(docs) and {True, False} == {r.verified for r in got}


# -------------------------------------------------------------- alignment

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
TEXTS = [None, "", "a", " ", "the the the cat sat", "The quick  brown fox\n\njumps", "naïve café 日本語 text", "<|endoftext|> and <s> x </s>", "aaaa" * 200,
         "\x00 odd", "tab\tand\rcr", "a b", "ﬁne ½", "12345 67890", "the cat sat", "the cat sat", "😀😀 the", "\x85 x", "  two  spaces "]


def _plain_align(texts):
    import sentencepiece
    from tokenizers import Tokenizer
    from tidepool.llm.bpe_rank import byte_symbols
    byte = {c: bytes([k]) for k, c in enumerate(byte_symbols())}
    ta = Tokenizer.from_file(common.tokenizer_file(A))
    ta.encode_special_tokens = True
    sb = sentencepiece.SentencePieceProcessor(model_file=common.tokenizer_file(B))
    docs, holders = [], Counter()
    for t in texts:
        ids_a = ta.encode(" " + (t or ""), add_special_tokens=False).ids if t else []
        ids_b = sb.encode(t) if t else []
        raw_a = [b"".join(byte[c] for c in ta.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(sb.id_to_piece, ids_b)]
        whole = f" {t}".encode()
        if not t or b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            docs.append([])
            continue
        groups, x, y, ea, eb, ga, gb = [], 0, 0, 0, 0, [], []
        while x < len(ids_a) or y < len(ids_b):
            if ea <= eb and x < len(ids_a) and (ea < eb or not ga):
                ga.append(ids_a[x])
                ea += len(raw_a[x])
                x += 1
            else:
                gb.append(ids_b[y])
                eb += len(raw_b[y])
                y += 1
            if ea == eb and ga and gb:
                groups.append((ga, gb))
                ga, gb = [], []
        assert not ga and not gb
        docs.append(groups)
        holders.update({(i, j) for p, q in groups for i in p for j in q})
    best = {}
    for (i, j), n in holders.items():
        best[i] = max(best.get(i, 0), n)
    out = []
    for groups in docs:
        links = [(i, j) for p, q in groups for i in p for j in q]
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), len(links),
                    sum(holders[x] == best[x[0]] for x in links), sum(holders[x] for x in links), text))
    return out, holders, best


def _check_alignment(df, texts):
    want, holders, best = _plain_align(texts)
    files = common.tokenizer_file(A), common.tokenizer_file(B)
    got = align.align(df, *files).collect()
    rows = sorted((r.doc_id if r.doc_id is not None else -1, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in got)
    assert rows == sorted((k if k is not None else -1, *w) for k, w in zip((r.doc_id for r in df.collect()), want))
    pairs = align.pair_counts(df, *files).collect()
    assert {(r.a, r.b): r["count"] for r in pairs} == holders and len(pairs) == len(holders)
    assert all(r.best == (r["count"] == best[r.a]) for r in pairs)


def test_alignment_of_odd_texts_repeated_and_null_ids(spark):
    texts = TEXTS + ["x" * 5000, "the cat " * 3000]
    df = spark.createDataFrame([(None if k == 4 else 3 if k in (5, 6) else k, t, "g", 1) for k, t in enumerate(texts)],
                               "doc_id long, text string, `Groups` string, run int")
    _check_alignment(df.coalesce(1), texts)


def test_alignment_with_small_runs_and_several_merges(spark, monkeypatch):
    r = random.Random(2)
    words = "the cat sat on a mat naïve 日本 unbelievable tokenization 3.14 of and".split()
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 30))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = align.align(df, common.tokenizer_file(A), common.tokenizer_file(B)).collect()
    # workers load the module anew, so the bounds are checked in this process
    pair = align.pair_of(common.tokenizer_file(A), common.tokenizer_file(B))
    codes, part = align.Codes(len(pair.bytes_a), len(pair.bytes_b)), align.Slice(pair, texts)
    whole = align.Run()
    for keys, times in part.links(codes, 0):
        whole.add(keys, times)
    for size in (1, 3, 50):
        monkeypatch.setattr(align, "LINKS", size)
        run = align.Run()
        for keys, times in part.links(codes, 0):
            run.add(keys, times)
        assert all((x == y).all() for x, y in zip(run.sorted(), whole.sorted()))
    monkeypatch.setattr(align, "CHUNK", 7)
    rows = [(k, k % 3 + 1) for k in range(40)]
    blobs = list(align._chunks(iter(rows), 2))
    assert len(blobs) == 6 and list(align._merged([blobs, blobs])) == [(k, 2 * n) for k, n in rows]
    assert len(want) == 300
    monkeypatch.setattr(align, "FAN", 2)
    assert align.align(df, common.tokenizer_file(A), common.tokenizer_file(B)).count() == 300


def test_alignment_over_many_runs_equals_the_plain_one(spark):
    docs = _documents(spark)
    texts = [r.text for r in docs.collect()]
    df = docs.repartition(70)  # more runs than one heap takes
    want, _, _ = _plain_align(texts)
    got = align.align(df, common.tokenizer_file(A), common.tokenizer_file(B), digest=True).collect()
    ids = [r.doc_id for r in docs.collect()]
    assert sorted((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in got) == sorted(
        (i, *w[:6], _h(w[6]) if w[6] else "") for i, w in zip(ids, want))


def test_alignment_of_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    files = common.tokenizer_file(A), common.tokenizer_file(B)
    assert align.align(none, *files).collect() == [] and align.pair_counts(none, *files).collect() == []


# ---------------------------------------------------------- personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _plain_spans(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(sum(map(int, str(int(c) * (2 if k % 2 else 1)))) for k, c in enumerate(d[::-1])) % 10 == 0

    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]


def test_spans_equal_the_patterns_on_odd_texts():
    r = random.Random(11)
    bits = ["a@b.c", "@", "x.y", ".", "@-", "+1 ", "555", "(", ")", "-", " ", "1.2.3.4", "256", "0001", "4111 1111 1111 1111", "+", "é@x.yz", "😀", "\n", "4111-1111-1111-1111", "9" * 30, "%"]
    for _ in range(20000):
        t = "".join(r.choice(bits) for _ in range(r.randint(1, 14)))
        assert sanitise.base_spans(t) == _plain_spans(t), t


def test_long_runs_stay_linear():
    for t in ("9" * 400_000, "a" * 400_000, "a@" * 200_000, "1." * 200_000, "+1" + " " * 400_000, "1 " * 200_000, "a.b@" * 100_000):
        sanitise.base_spans(t)


def _plain_sanitise(texts, contexts, threshold):
    """Spans of each text, by the definition, with terms as words."""
    found = [_plain_spans(t) for t in texts]
    n_t, n_c, both, signs, held = Counter(), Counter(), Counter(), defaultdict(set), []
    for t, spans in zip(texts, found):
        words = sanitise._terms(t or "", spans)
        n_t.update({f for w in re.findall(r"[^\W_]+", t or "") for f in (w.lower(), sanitise.general(w.lower()))})
        here = defaultdict(set)
        for kind, s, e in spans:
            c = (kind, t[s:e].lower() if kind == "email" else t[s:e] if kind == "ip" else re.sub("[^0-9]", "", t[s:e]))
            before = [w for w, a, _ in words if a < s][-sanitise.WINDOW:]
            after = [w for w, a, _ in words if a >= e][:sanitise.WINDOW]
            near = before + after
            here[c] |= set()
            for f in {f for w in near for f in (w, sanitise.general(w))}:
                here[c].add(f)
                signs[c, f].add(min(map(sanitise._hash, near)))
        n_c.update(here.keys())
        both.update((c, f) for c, fs in here.items() for f in fs)
        held.append((words, here))
    n = len(texts)
    bad = {(c, f) for (c, f), k in both.items() if len(signs[c, f]) >= contexts and n_c[c] < n
           and math.log2(n * k / n_c[c] / max(k, n_t[f])) / math.log2(n / n_c[c]) >= threshold}
    out = []
    for spans, (words, here) in zip(found, held):
        gone = {f for c, fs in here.items() for f in fs if (c, f) in bad}
        out.append(spans + [("term", s, e) for w, s, e in words if w in gone])
    return out


def test_terms_that_disclose_equal_the_definition(spark):
    r = random.Random(4)
    common_words = [f"w{k}" for k in range(60)]
    texts = []
    for k in range(400):
        words = [r.choice(common_words) for _ in range(r.randint(0, 40))]
        if k % 9 == 0:  # a name that stands with one address only
            words[len(words) // 2:len(words) // 2] = ["Zebulon", "writes", "from", "zeb@mail.example.com", "to"]
        if k % 7 == 0:
            words.append(r.choice(["+1 (988) 555-2485", "10.0.0.1", "4111 1111 1111 1111"]))
        if k % 11 == 0:
            words.append("İstanbul")
        texts.append(" ".join(words))
    texts += [None, "", "bob@x.example.org " + "quiet harbour " * 4000] + ["ann@y.example.org Copied Words Here"] * 30
    df = spark.createDataFrame([(None if k % 50 == 0 else k // 2, t, "s", 1) for k, t in enumerate(texts)], "doc_id long, text string, `Spans` string, uid int")
    got = sanitise.sanitise(df, threshold=0.5).collect()
    want = _plain_sanitise(texts, sanitise.CONTEXTS, 0.5)
    ids = [r.doc_id for r in df.collect()]
    rows = lambda x: sorted(x, key=str)
    assert rows((r.doc_id, [tuple(s) for s in r.spans]) for r in got) == rows(zip(ids, want))
    flat = " ".join(r.sanitised or "" for r in got)
    assert "zeb@" not in flat and "Zebulon" not in flat and "555-2485" not in flat
    assert any("[EMAIL]" in (r.sanitised or "") for r in got)
    # copies are one surrounding: their words stay
    assert "[EMAIL] Copied Words Here" in flat
    assert all(r.sanitised is None for r in got if not r.spans)


def test_sanitise_of_no_rows(spark):
    assert sanitise.sanitise(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_personal_data_query_equals_the_patterns(spark):
    texts = {r.doc_id: r.text for r in _documents(spark).collect()}
    got = corpus_queries.op11(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        base = _plain_spans(texts[r.doc_id])
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == _h(listed) and r.spans.startswith(listed)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for x, _, _ in base) for k in sanitise.KINDS)
