"""P9(a)/P12(a): a real tokenizer file through the Arrow-batched UDF path."""
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tidepool.functions.tokenizer import FileTokenizer
from tidepool.sources.readers import table

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def tok_path(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers
    texts = [r.text for r in table(spark, SF_SMALL, "documents").select("text").limit(50).collect()]
    words = sorted({w for t in texts for w in t.split()})
    tok = Tokenizer(models.WordLevel({w: i for i, w in enumerate(["[PAD]", "[UNK]", "[EOS]", *words])}, unk_token="[UNK]"))
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    path = os.path.join(tempfile.mkdtemp(prefix="tidepool-tok-"), "tokenizer.json")
    tok.save(path)
    return path


def test_file_tokenizer_matches_local(spark, tok_path):
    from tokenizers import Tokenizer
    local = Tokenizer.from_file(tok_path)
    ft = FileTokenizer(tok_path)
    df = table(spark, SF_SMALL, "documents").select("doc_id", "text").orderBy("doc_id").limit(40)
    got = {r.doc_id: list(r.ids) for r in df.select("doc_id", ft.encode(F.col("text")).alias("ids")).collect()}
    for r in df.collect():
        assert got[r.doc_id] == local.encode(r.text, add_special_tokens=False).ids


def test_file_tokenizer_decode(spark, tok_path):
    ft = FileTokenizer(tok_path)
    df = spark.createDataFrame([("alpha beta",), (None,)], "text string")
    enc = df.select(ft.encode(F.col("text")).alias("ids"))
    dec = enc.select(ft.decode(F.col("ids")).alias("t")).collect()
    assert dec[1].t is None
    assert isinstance(dec[0].t, str)


def test_mask_token_is_a_new_id(tok_path):
    from tokenizers import Tokenizer
    assert FileTokenizer(tok_path).mask_token_id == Tokenizer.from_file(tok_path).get_vocab_size()
