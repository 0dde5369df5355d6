"""BPE encoding and decoding with a pair occurrence index.

All distinct pre-tokens of a slice of a partition are laid out as one linked
sequence of symbols.  An index maps each pair that the file can merge to all
positions at which it stands.  Active ranks are taken in ascending order; each
is applied at all its positions, left to right, and the lists of the pairs that
it makes and breaks are brought up to date.  The results are kept by
pre-token, so a document is put together from the ids of its pre-tokens.

The file's path is a parameter.  Handled is the word-end kind: NFC, lower
case, white space dropped, ``</w>`` at the end of a pre-token, no decoder (a
decoded text is its tokens joined by a space).

Defined results: null and empty texts have no ids and decode to an empty
string; strings of added tokens become their ids wherever they stand; null and
repeated ids are rows like others; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.bpe_rank import byte_symbols, text_slices
from tidepool.llm.common import SMALL_BATCH, in_batches, kept, let_go, trim

#: Fixed value: the pattern of the word-end file's pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: Pre-tokens whose ids a worker keeps; beyond that the older half goes.
CACHE = 150_000
#: Bytes of text whose new pre-tokens are merged at a time.
SLICE = 1 << 18


def normalise(text: str) -> str:
    """NFC, then lower case of each character by itself."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    # str.lower() treats a final sigma apart
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)


class PairIndex:
    """Encoder and decoder for one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        byte = byte_symbols()
        self.inner = np.array([vocab[c] for c in byte])
        self.final = np.array([vocab[c + WORD_END] for c in byte])
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.rank = {a << 32 | b: r for r, (a, b, _) in enumerate(self.merges)}
        codes = np.array(list(self.rank))
        self.ranks = np.argsort(codes, kind="stable")
        self.pairs = codes[self.ranks]
        self.ranks = np.array(list(self.rank.values()))[self.ranks]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        token = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.tokens = pa.array([token.get(i) for i in range(max(token) + 1)], pa.string())
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.find = regex.compile(PATTERN).findall
        self.cache: dict[str, bytes] = {}

    def merge_all(self, words: list[str]) -> list[bytes]:
        """The ids of each pre-token, as 32-bit numbers."""
        if not words:
            return []
        raw = [w.encode() for w in words]
        n = np.array(list(map(len, raw)))
        ends = np.cumsum(n)
        heads, tails = ends - n, ends - 1
        byte = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[byte]
        symbols[tails] = self.final[byte[tails]]
        left, right = np.arange(-1, len(byte) - 1), np.arange(1, len(byte) + 1)
        left[heads], right[tails] = -1, -1
        where = self._occurrences(symbols, tails)
        sym, left, right = symbols.tolist(), left.tolist(), right.tolist()
        rank, merges, push = self.rank.get, self.merges, heapq.heappush
        active = list(where)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            a, b, new = merges[r]
            for p in sorted(where.pop(r)):
                q = right[p]
                if q < 0 or sym[p] != a or sym[q] != b:
                    continue  # an earlier merge took it
                sym[p], sym[q] = new, -1
                after, before = right[q], left[p]
                right[p] = after
                # the pairs that the merge makes, to both sides
                if after >= 0:
                    left[after] = p
                    made = rank(new << 32 | sym[after])
                    if made is not None:
                        if made in where:
                            where[made].append(p)
                        else:
                            where[made] = [p]
                            push(active, made)
                if before >= 0:
                    made = rank(sym[before] << 32 | new)
                    if made is not None:
                        if made in where:
                            where[made].append(before)
                        else:
                            where[made] = [before]
                            push(active, made)
        done = np.array(sym)
        stays = done >= 0
        ids, cut = done[stays].astype(np.int32).tobytes(), (4 * np.cumsum(np.add.reduceat(stays, heads, dtype=np.int64))).tolist()
        return [ids[i:z] for i, z in zip([0, *cut], cut)]

    def _occurrences(self, symbols: np.ndarray, tails: np.ndarray) -> dict[int, list[int]]:
        """The index at the start: the places of each pair, by its rank."""
        pair = symbols[:-1].astype(np.int64) << 32 | symbols[1:]
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        known = self.pairs[at] == pair
        known[tails[:-1]] = False
        places = np.flatnonzero(known)
        ranks = self.ranks[at[places]]
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        cut = np.flatnonzero(np.diff(ranks)) + 1
        first = np.concatenate(([0], cut))[:len(ranks)]
        return {r: p.tolist() for r, p in zip(ranks[first].tolist(), np.split(places, cut))} if len(ranks) else {}

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text ends
        (with a leading 0)."""
        docs = []
        for t in texts:
            if t and self.cut and (parts := self.cut.split(t))[1:]:
                docs.append([w for k, p in enumerate(parts) for w in ([p] if k % 2 else self.find(normalise(p)))])
            else:
                docs.append(self.find(normalise(t)) if t else [])
        here = set().union(*docs)
        if len(self.cache) + len(here) > CACHE:
            self.cache = dict(islice(self.cache.items(), len(self.cache) // 2, None))
        # normalised text holds no string of an added token with its cut taken out
        plain = [w for w in here if w not in self.cache and w not in self.special]
        self.cache.update(zip(plain, self.merge_all(plain)))
        self.cache.update((t, np.int32(i).tobytes()) for t, i in self.special.items())
        ids = [b"".join(map(self.cache.__getitem__, d)) for d in docs]
        ends = np.cumsum([0, *map(len, ids)]) // 4
        return np.frombuffer(b"".join(ids), np.int32), ends

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The text of each run of ids: its tokens joined by a space."""
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), self.tokens.take(pa.array(ids))), " ")


@kept
def index_of(path: str) -> PairIndex:
    """One index for each file in a worker process, kept between its tasks."""
    index = PairIndex(path)
    trim()  # the parsed file
    return index


def encode_decode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids, decoded`` of each row; a map over the documents."""
    def run(batches):
        if not index_of.cache_info().currsize:
            let_go()
        index = index_of(path)
        for b in batches:
            for at, part in text_slices(b.column(1), SLICE):
                ids, ends = index.encode(part)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(at, len(part)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)),
                    index.decode(ids, ends)], ["doc_id", "ids", "decoded"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return in_batches(source, SMALL_BATCH).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
