"""Tokenizer operators against the library, benchmark hits, licences and
archives against plain versions."""
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidepool.llm import bpe_index, bpe_rank, decontam, license, queries, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, `Text2` string"


def _texts():
    r = random.Random(3)
    odd = ["a", "B", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", " ", "é", "é", "Σ", "ΑΣ", "İ", "ß", "日本", "😀", "'s", "'LL",
           "1", "²", "½", "!!", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "aaaa", "​", "ﬁ", "Ǆ", "\x00", "the", "ing"]
    out = ["", None, "<|endoftext|>", "a" * 3000, "ab" * 700 + " x", " " * 500, "<|endoftext|><|endoftext|> x"]
    return out + ["".join(r.choice(odd) for _ in range(r.randint(1, 60))) for _ in range(400)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(_texts())], DOCS)


def _documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


@pytest.mark.parametrize("name", ["odd", "table"])
def test_counts_equal_the_library(spark, odd, name):
    df = odd if name == "odd" else _documents(spark)
    lib = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))
    texts = {r[0]: r[1] or "" for r in df.collect()}
    got = bpe_rank.count_tokens(df, queries.tokenizer_file("byte_bpe_50k.json")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_bytes, r.n_tokens) == (len(texts[r.doc_id].encode()), len(lib.encode(texts[r.doc_id], add_special_tokens=False).ids)), texts[r.doc_id]


@pytest.mark.parametrize("name", ["odd", "table"])
def test_ids_and_decoded_equal_the_library(spark, odd, name):
    df = odd if name == "odd" else _documents(spark)
    lib = Tokenizer.from_file(queries.tokenizer_file("word_bpe_49k.json"))
    texts = {r[0]: r[1] or "" for r in df.collect()}
    got = bpe_index.encode_decode(df, queries.tokenizer_file("word_bpe_49k.json")).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids, texts[r.doc_id]
        assert r.decoded == lib.decode(ids, skip_special_tokens=False)


def test_caches_that_start_anew_change_nothing(monkeypatch):
    path, texts = queries.tokenizer_file("word_bpe_49k.json"), [t for t in _texts() if t][:60]
    ids, ends = bpe_index.PairIndex(path).encode(texts)
    whole = [x.tolist() for x in np.split(ids, ends[1:-1])]
    monkeypatch.setattr(bpe_index, "CACHE", 5)
    index = bpe_index.PairIndex(path)
    assert [index.encode([t])[0].tolist() for t in texts] == whole
    ids, ends = index.encode([None, "", *texts[:3], ""])
    assert index.decode(ids, ends).to_pylist()[:2] == ["", ""] and len(ends) == 7


def _plain_hits(text, items, window):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        s = words(t)
        m = min(window, len(s))
        grams = {tuple(s[i:i + m]) for i in range(len(s) - m + 1)} if s else set()
        for i in range(len(w) - m + 1 if m else 0):
            if tuple(w[i:i + m]) in grams:
                hit.update(range(i, i + m))
                found.add(item)
    return len(w), len(hit), sorted(found)


def test_hits_equal_brute_force(spark, monkeypatch):
    r = random.Random(5)
    vocab = ["a", "B", "c1", "é", "dd"]
    items = [(f"i{k}", " ".join(r.choice(vocab) for _ in range(r.choice([0, 1, 2, 3, 5, 9, 14])))) for k in range(9)] + [("i0", None), ("long", "x y z w " * 4)]
    docs = [(k, " ".join(r.choice(vocab + ["q"]) for _ in range(r.randint(0, 60)))) for k in range(60)] + [(60, None), (61, ""), (62, "x-Y.z w x y")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for window, shard in ((4, 8 << 20), (10, 8 << 20), (3, 60)):
        monkeypatch.setattr(decontam, "SHARD_BYTES", shard)
        got = {x.doc_id: (x.n_words, x.n_hit, x["items"]) for x in decontam.find_items(df, bench, window).collect()}
        for k, t in docs:
            assert got[k] == _plain_hits(t, items, window)
    only_long = [("a", "p q r s t u v w x y z"), ("b", "r s t u v w x y z q r")]
    got = decontam.find_items(spark.createDataFrame([(1, "p q r s t u v w x y z q r p"), (2, "p q r s")], "doc_id long, text string"),
                              spark.createDataFrame(only_long, "item_id string, text string"), 5).orderBy("doc_id").collect()
    assert [(g.n_hit, g["items"]) for g in got] == [(13, ["a", "b"]), (0, [])]
    assert decontam.find_items(df, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontam.find_items(df.limit(0), bench).count() == 0


def test_decontaminate_cuts_or_drops(spark):
    bench = spark.createDataFrame([("i", " ".join(f"w{k}" for k in range(12)))], "item_id string, text string")
    span = " ".join(f"W{k}" for k in range(12))
    rows = [(1, "clean text, it stays.", "s", 21), (2, "Before it. " + "x " * 20 + span + "; after it", "s", 1), (3, span + " x", None, 2), (4, None, "s", None)]
    out = {r.doc_id: r for r in decontam.decontaminate(spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long"), bench).collect()}
    assert sorted(out) == [1, 2, 4]
    assert out[1].text == rows[0][1] and out[1].n_chars == 21 and out[4].text is None
    assert out[2].text == "Before it. " + "x " * 20 + "; after it" and out[2].n_chars == len(out[2].text)


def test_licence_rules(spark):
    grant = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
             "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
             "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
             "furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be "
             "included in all copies or substantial\nportions of the Software.")
    rows = [(1, grant), (2, "x\n// SPDX-License-Identifier: MIT\nint main"), (3, "Licensed under the Apache License, Version 2.0.\nText. All rights reserved."),
            (4, None), (5, ""), (6, "Released under the MIT License. Licensed under CC BY-NC 4.0. Released under the MIT License."),
            (7, "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.")]
    got = {r.doc_id: (r.licences, r.n_unmatched) for r in license.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (["MIT"], 0), 2: (["MIT"], 0), 3: (["Apache-2.0"], 1), 4: ([], 0), 5: ([], 0), 6: (["MIT", "CC-BY-NC-4.0", "MIT"], 0), 7: ([], 1)}


def test_standard_notices_are_recognised(spark):
    tail = ("\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\n"
            "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU General Public License for more details.\n")
    gnu = ("This program is free software%s you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\n"
           "the Free Software Foundation%s either version %d of the License, or\n(at your option) any later version.")
    rows = [("GPL-2.0-or-later", gnu % (";", ";", 2) + tail), ("GPL-3.0-or-later", gnu % (":", ",", 3) + tail), ("GPL-2.0-or-later", gnu % (";", ";", 2)),
            ("GPL-3.0-or-later", gnu % (";", ";", 3) + tail),
            ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\n"
                        "file, You can obtain one at https://mozilla.org/MPL/2.0/."),
            ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\n'
                           "You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law")]
    rows += [(x, f"// SPDX-License-Identifier: {x}\n") for x in ("GPL-2.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "Unlicense")]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: (r.licences, r.n_unmatched) for r in license.scan_licences(df).collect()}
    assert got == {i: ([x], 0) for i, (x, _) in enumerate(rows)}


def test_archives_give_back_every_page(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SEGMENT_BYTES", 900)
    inner = warc.record(99, "u", b"inner payload", "d", None).decode() + "\r\n"
    rows = [(1, "http://a/\r\nX: y", "p" * 120), (2, None, "p" * 120), (3, "u", None), (4, "u", ""), (5, "u", "é" * 50), (6, "u", "é" * 50),
            (7, "u", "short"), (8, "u", "short"), (9, "u", inner), (10, "u", "x" + inner * 3 + "\r\n\r\n"), (None, "u", "null id"), (0, "u", "é" * 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(pages.repartition(2), str(tmp_path / "w"))
    got = {r.page_id: r for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert len(got) == len(rows)
    for i, url, html in rows:
        body = (html or "").encode()
        assert got[i].payload_bytes == len(body) and got[i].payload_digest == hashlib.sha256(body).hexdigest()
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {2: 1, 5: 0, 6: 0}
    warc.write_archives(pages.limit(0), str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0
