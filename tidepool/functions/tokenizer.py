"""Tokenizers as Column functions.

Two implementations share one small interface (``encode``, ``decode_table``
and the special ids):

* ``StandinTokenizer`` — a SQL-expressible tokenizer used by the registered
  queries and the DuckDB oracle.  Special tokens of the form ``<|name|>`` are
  isolated, the text is split on whitespace and each ordinary token maps to
  ``16 + (first 48 bits of md5(token)) mod 151904``, i.e. ids in
  ``[16, 151920)`` (151,920 = the vocabulary size the reference plans for).
  Everything runs in the JVM.
* ``FileTokenizer`` — a real BPE/WordPiece tokenizer loaded from a
  user-supplied ``tokenizer.json`` (``tokenizers`` library).  Encoding runs in
  an Arrow-batched iterator pandas UDF, one tokenizer instance per task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from os.path import commonprefix

import pandas as pd

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Stand-in special tokens and their ids.
STANDIN_SPECIALS = {
    "<|pad|>": 0,
    "<|startoftext|>": 1,
    "<|endoftext|>": 2,
    "<|mask|>": 3,
    "<|im_start|>": 4,
    "<|im_end|>": 5,
    "<|start_header_id|>": 6,
    "<|end_header_id|>": 7,
    "<|eot_id|>": 8,
    "<|mdm_mask|>": 9,
}
STANDIN_VOCAB_SIZE = 151920
STANDIN_FIRST_ORDINARY = 16
SPLIT_PATTERN = r"[ \t\n\r\f]+"
SPECIAL_PATTERN = r"(<\|[a-z_]+\|>)"


@dataclass(frozen=True)
class SpecialIds:
    """Special-token configuration with the reference's fallbacks:
    pad <- eos, eos <- pad, bos <- pad, mask added if missing, eot by family."""

    pad: int | None = None
    eos: int | None = None
    bos: int | None = None
    mask: int | None = None
    eot: int | None = None

    def resolved(self, vocab_size: int | None = None) -> "SpecialIds":
        """All ids.  A missing mask id becomes a new token behind a vocabulary
        of ``vocab_size`` ids; without that size it cannot be known."""
        if self.mask is None and vocab_size is None:
            raise ValueError("no mask id: name one, or the vocabulary's size to add a mask token behind it")
        pad = self.pad if self.pad is not None else self.eos
        eos = self.eos if self.eos is not None else pad
        return SpecialIds(pad=pad, eos=eos, bos=self.bos if self.bos is not None else pad,
                          mask=self.mask if self.mask is not None else vocab_size,
                          eot=self.eot if self.eot is not None else eos)


@dataclass
class StandinTokenizer:
    specials: dict = field(default_factory=lambda: dict(STANDIN_SPECIALS))
    pad_token_id: int = 0
    bos_token_id: int = 1
    eos_token_id: int = 2
    mask_token_id: int = 3
    eot_token_id: int = 5          # ChatML family: <|im_end|>
    bos_token: str = "<|startoftext|>"
    eos_token: str = "<|endoftext|>"

    # -- Spark -------------------------------------------------------------
    def token_id(self, tok: Column) -> Column:
        ordinary = F.lit(STANDIN_FIRST_ORDINARY) + F.pmod(
            F.conv(F.substring(F.md5(tok), 1, 12), 16, 10).cast("bigint"),
            F.lit(STANDIN_VOCAB_SIZE - STANDIN_FIRST_ORDINARY),
        )
        expr = None
        for s, i in self.specials.items():
            expr = (F.when(tok == F.lit(s), F.lit(i).cast("bigint")) if expr is None
                    else expr.when(tok == F.lit(s), F.lit(i).cast("bigint")))
        if expr is None:
            return ordinary
        # what all special tokens begin with tells ordinary ones apart at once
        return F.when(tok.startswith(commonprefix(list(self.specials))), expr.otherwise(ordinary)).otherwise(ordinary)

    def tokens(self, text: Column) -> Column:
        spaced = F.regexp_replace(text, SPECIAL_PATTERN, " $1 ")
        return F.filter(F.split(spaced, SPLIT_PATTERN), lambda x: x != F.lit(""))

    def encode(self, text: Column) -> Column:
        """array<bigint> of token ids for a string column (NULL -> NULL)."""
        return F.transform(self.tokens(text), self.token_id)

    def count(self, text: Column) -> Column:
        """Token count without computing ids (cheaper than size(encode))."""
        return F.size(self.tokens(text))

    # -- DuckDB oracle -----------------------------------------------------
    def sql_token_id(self, tok: str) -> str:
        cases = " ".join(f"WHEN {tok} = '{s}' THEN {i}" for s, i in self.specials.items())
        ordinary = (f"{STANDIN_FIRST_ORDINARY} + (('0x' || substr(md5({tok}), 1, 12))::BIGINT "
                    f"% {STANDIN_VOCAB_SIZE - STANDIN_FIRST_ORDINARY})")
        return f"(CASE {cases} ELSE {ordinary} END)::BIGINT"

    def sql_tokens(self, text: str) -> str:
        spaced = f"regexp_replace({text}, '{SPECIAL_PATTERN}', ' \\1 ', 'g')"
        return (f"list_filter(regexp_split_to_array({spaced}, '{SPLIT_PATTERN}'), "
                f"lambda x: x <> '')")

    def sql_encode(self, text: str) -> str:
        return f"list_transform({self.sql_tokens(text)}, lambda t: {self.sql_token_id('t')})"

    def special_ids(self) -> SpecialIds:
        return SpecialIds(self.pad_token_id, self.eos_token_id, self.bos_token_id,
                          self.mask_token_id, self.eot_token_id)


class FileTokenizer:
    """A real tokenizer from a ``tokenizer.json`` file (``tokenizers`` library).

    The JSON is read once on the driver and shipped inside the UDF closure
    (a few MB); each Python worker builds the tokenizer once per task and
    encodes whole Arrow batches with ``encode_batch``.
    """

    def __init__(self, path: str, specials: SpecialIds | None = None,
                 add_special_tokens: bool = False):
        with open(path, encoding="utf-8") as fh:
            self._json = fh.read()
        self.add_special_tokens = add_special_tokens
        from tokenizers import Tokenizer
        sp = (specials or SpecialIds()).resolved(Tokenizer.from_str(self._json).get_vocab_size())
        self.pad_token_id, self.eos_token_id = sp.pad, sp.eos
        self.bos_token_id, self.mask_token_id, self.eot_token_id = sp.bos, sp.mask, sp.eot

    def encode(self, text: Column) -> Column:
        blob, add_special = self._json, self.add_special_tokens

        @F.pandas_udf(T.ArrayType(T.LongType()))
        def _encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            from tokenizers import Tokenizer
            tok = Tokenizer.from_str(blob)
            for s in batches:
                mask = s.isna()
                enc = tok.encode_batch(s.fillna("").tolist(), add_special_tokens=add_special)
                yield pd.Series([None if m else e.ids for e, m in zip(enc, mask)], dtype=object)

        return _encode(text)

    def decode(self, ids: Column, skip_special_tokens: bool = True) -> Column:
        blob = self._json

        @F.pandas_udf(T.StringType())
        def _decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            from tokenizers import Tokenizer
            tok = Tokenizer.from_str(blob)
            for s in batches:
                yield pd.Series([None if v is None else tok.decode(list(v), skip_special_tokens=skip_special_tokens)
                                 for v in s], dtype=object)

        return _decode(ids)


DEFAULT_TOKENIZER = StandinTokenizer()
