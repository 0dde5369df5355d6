"""The pipeline's stages on a small corpus with planted cases, and its run on
the smallest tables."""
import random
import re

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tidepool.llm.common import tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _corpus():
    r = random.Random(8)
    vocab = {"en": [f"the{c}{d}ing" for c in "bcdfghklmn" for d in "aeiou"], "de": [f"sch{c}{d}ung" for c in "bcdfghklmn" for d in "äöüei"]}
    word = lambda lang, n: " ".join(r.choice(vocab[lang]) for _ in range(n))
    texts = [("en" if i % 2 else "de", word("en" if i % 2 else "de", r.randint(60, 120))) for i in range(40)]
    passage, item = word("en", 52), word("en", 25)
    base = word("en", 100).split()
    near = base[:50] + ["thebaing"] + base[51:]
    texts += [("en", " ".join(base)), ("en", " ".join(near)), ("en", " ".join(base)),               # 40, 41, 42: one group
              ("en", word("en", 30) + " " + passage + " " + word("en", 30)), ("en", word("en", 20) + "\n" + passage),  # 43, 44
              ("en", word("en", 60) + " " + item + " " + word("en", 60)), ("en", item),              # 45, 46
              (None, "12 !! 34"), ("en", None), (None, "")]                                          # 47, 48, 49
    rows = [(i, t, lang, "s", None if t is None else len(t)) for i, (lang, t) in enumerate(texts)]
    return rows, passage, item


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, _, item = _corpus()
    path = f"file://{tmp_path_factory.mktemp('corpus')}"
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    rows, passage, item = _corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = []
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        got = docs.collect()
        docs = spark.createDataFrame(got, SCHEMA)
        kept.append({r.doc_id: r.text for r in got})
        assert all(r.n_chars == len(r.text) for r in got)
    language, joined, passages, clean = kept
    assert set(language) == set(range(47))
    assert set(joined) == set(language) - {41, 42}
    assert {i for i in joined if passages.get(i) != joined[i]} == {44} and passage in passages[43] and passage not in passages[44]
    assert set(passages) - set(clean) == {46} and item not in clean[45] and clean[45] != passages[45]
    assert all(clean[i] == rows[i][1] for i in clean if i not in (44, 45))
    lib = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    for r in cp.encode(spark, docs, folder).collect():
        assert r.ids == lib.encode(clean[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)
        assert re.sub("</w> ?", " ", r.decoded).count("<") == clean[r.doc_id].count("<")


def test_run_equals_the_stages_by_hand(spark, folder):
    out = cp.run(spark, folder)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"] and out.count() == 44


def test_empty_and_repeated_rows(spark, folder):
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, folder).count() == 0
    rows, *_ = _corpus()
    twice = spark.createDataFrame([rows[0], rows[0], rows[1], (None, rows[3][1], "en", "s", 1)], SCHEMA)
    assert sorted(str(r.doc_id) for r in cp.drop_near_duplicates(spark, twice, folder).collect()) == ["0", "1", "None"]


def test_language_stage_rejects_what_resembles_nothing(spark, folder):
    rows, *_ = _corpus()
    r = random.Random(4)
    odd = ["Это русский текст о погоде и о людях, которые живут в городе и ходят на работу каждый день",
           "これは日本語の文章です。天気がいいので散歩に行きましょう。今日はとても暖かいですね。明日も晴れるといいですね",
           "3fa9 bc81 ff00 dead beef 0a1b cafe babe 9c8d e7f6 a5b4 c3d2 e1f0 abcd ef01 fade " * 3,
           " ".join("".join(r.choice("qwxzjkvpfbmd") for _ in range(7)) for _ in range(12))]
    short = ["thebaing", "thebaing thedoing", "schbäung"]
    docs = spark.createDataFrame(rows + [(100 + k, t, None, "s", len(t)) for k, t in enumerate(odd + short)], SCHEMA)
    kept = {x.doc_id for x in cp.identify_language(spark, docs, folder).collect()}
    assert kept == set(range(47)) | {104, 105, 106}


def test_different_texts_under_one_id_stay(spark, folder):
    rows, *_ = _corpus()
    a, b = rows[0][1], rows[1][1]
    docs = spark.createDataFrame([(7, a, "en", "s", 1), (7, b, "en", "s", 2), (7, b, "en", "s", 2), (9, a, "en", "s", 3), (5, rows[2][1], "de", "s", 4),
                                  (None, a, "en", "s", 5), (8, "", "en", "s", 0), (8, "", "en", "s", 0), (-2 ** 63, rows[3][1], "de", "s", 6), (2 ** 63 - 1, b, "en", "s", 7)], SCHEMA)
    kept = sorted((x.doc_id if x.doc_id is not None else -1, x.text) for x in cp.drop_near_duplicates(spark, docs, folder).collect())
    assert kept == sorted([(7, a), (7, b), (5, rows[2][1]), (-1, a), (8, ""), (8, ""), (-2 ** 63, rows[3][1])])


def test_columns_that_clash_with_those_of_the_stages(spark, folder):
    rows, *_ = _corpus()
    names = ["score", "lang_pred", "_id", "_cuts", "_key", "_row", "id", "source_id", "words", "n"]
    docs = spark.createDataFrame([(*x, *range(len(names))) for x in rows], SCHEMA + "".join(f", `{c}` int" for c in names))
    plain = spark.createDataFrame(rows, SCHEMA)
    for name, stage in cp.STAGES:
        got, want = stage(spark, docs, folder), stage(spark, plain, folder)
        if name != "bpe_encoding":
            assert got.columns == docs.columns
            assert {tuple(x)[5:] for x in got.collect()} == {tuple(range(len(names)))}
        assert sorted(x.doc_id for x in got.select("doc_id").collect()) == sorted(x.doc_id for x in want.select("doc_id").collect())


def test_entry_without_the_optional_parts(tmp_path):
    """A copy of the repository without the two folders and the pipeline
    still registers the other queries."""
    import os
    import shutil
    import subprocess
    import sys
    root = os.path.dirname(os.path.abspath(cp.__file__))
    shutil.copytree(f"{root}/tidepool", tmp_path / "tidepool", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(k.startswith('op') or k == 'pipeline' for k in q); assert e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True).returncode == 0
