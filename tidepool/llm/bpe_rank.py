"""Token counts by rank-synchronous merging of ragged numpy arrays.

Distinct pre-tokens of a batch lie one after another in one symbol array.  In
each round every sequence finds its lowest-ranked pair; all of these pairs are
merged at once (the left one where two overlap).  A sequence without a pair
that can be merged is finished, and its surviving symbols are counted.  The
pair table is read from a byte-level BPE file whose path is a parameter.

Defined results: null and empty texts have 0 tokens; strings of the file's
added tokens count as one token each wherever they stand, as in the library.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import in_batches

#: Fixed value: the pattern that splits text before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens whose counts a worker keeps; beyond that it starts anew.
CACHE = 200_000
_NEVER = np.iinfo(np.int32).max


def byte_symbols() -> list[str]:
    """The printable letter that stands for each byte in byte-level files:
    printable Latin-1 characters stand for themselves, the other bytes get
    the code points from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class RankMerger:
    """Counts symbols after all merges of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.base = np.array([vocab[c] for c in byte_symbols()], np.int64)
        self.size = len(vocab)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        code = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(code, kind="stable")
        self.code, self.rank = code[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.find = regex.compile(PATTERN).findall
        self.cache: dict[str, int] = {}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a * self.size + b
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where(self.code[at] == code, self.rank[at], _NEVER)

    def count_sequences(self, items: list[bytes]) -> np.ndarray:
        out = np.array([len(x) for x in items], np.int64)
        sym = self.base[np.frombuffer(b"".join(items), np.uint8)]
        ids, n = np.flatnonzero(out), out[out > 0]
        while len(ids):
            starts = np.concatenate(([0], np.cumsum(n)[:-1]))
            rank = np.append(self.ranks(sym[:-1], sym[1:]), np.int32(_NEVER))
            rank[starts[1:] - 1] = _NEVER
            low = np.minimum.reduceat(rank, starts)
            out[ids] = n
            live = low != _NEVER
            if not live.all():
                stay = np.repeat(live, n)
                sym, rank, ids, n, low = sym[stay], rank[stay], ids[live], n[live], low[live]
            if not len(ids):
                break
            seq = np.repeat(np.arange(len(ids)), n)
            at = np.flatnonzero(rank == low[seq])
            # of neighbours that overlap, every second one from the left
            first = np.concatenate(([True], np.diff(at) != 1))
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0]
            sym[at] = self.made[rank[at]]
            gone = np.ones(len(sym), bool)
            gone[at + 1] = False
            n = n - np.bincount(seq[at], minlength=len(ids))
            sym = sym[gone]
        return out

    def count_texts(self, texts: list[str | None]) -> list[int]:
        counts, parts = [], []
        for t in texts:
            pieces = self.added.split(t) if self.added and t else [t or ""]
            counts.append(len(pieces) - 1)
            parts.append([x for p in pieces for x in self.find(p)])
        new = list({x for p in parts for x in p if x not in self.cache})
        if len(self.cache) + len(new) > CACHE:
            self.cache = {}
            new = list({x for p in parts for x in p})
        self.cache.update(zip(new, self.count_sequences([x.encode() for x in new]).tolist()))
        known = self.cache.__getitem__
        return [c + sum(map(known, p)) for c, p in zip(counts, parts)]


def text_slices(column, size: int = 2 << 20, rows: int = 4096):
    """``(at, texts)`` for runs of about ``size`` bytes and at most ``rows``
    rows of an Arrow column of texts, at least one row each, so that a batch is
    never unpacked whole."""
    n = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        end = min(at + rows, max(at + 1, int(np.searchsorted(n, (n[at - 1] if at else 0) + size, "right"))))
        yield at, column.slice(at, end - at).to_pylist()
        at = end


def count_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of each row; a map over the documents."""
    def run(batches):
        merger = RankMerger(path)
        for b in batches:
            counts = [c for _, part in text_slices(b.column(1)) for c in merger.count_texts(part)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(counts, pa.int64())],
                                             ["doc_id", "n_bytes", "n_tokens"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"),
                         F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return in_batches(source).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
