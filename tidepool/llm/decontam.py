"""Benchmark decontamination with a generalised suffix automaton.

Words are maximal runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after
lower-casing A-Z.  A window is ``window`` consecutive words of an item; an
item with fewer words, but not none, is one window as a whole.  The automaton
of all items is built once per worker; each document's words are streamed
through it while the longest matching length is tracked, so that every
occurrence of every window is found in one pass.

Items are cut into shards of at most ``SHARD_BYTES`` of text.  Each shard is
one broadcast of bounded size, and every document is held against every shard,
so a large benchmark costs time but neither memory nor results.

Defined results: null or empty texts have no words and no hits; a null item
text has no window; an item with a null id marks words but is not listed; item
ids that occur twice count once; repeated documents are reported once a row.
An empty benchmark hits nothing.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.bpe_rank import text_slices
from tidepool.llm.common import SMALL_BATCH, in_batches, let_go

WINDOW = 10
SHARD_BYTES = 8 << 20
#: Text whose words a worker holds at a time (more where shards take turns).
SLICE_BYTES = 2 << 20
#: Pipeline: documents of which a greater share of the words is hit are
#: dropped whole; of the others the hit spans are cut.
MAX_COVERAGE = 0.5

_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_TO_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else 32 if c in _SEPARATORS else c for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TO_WORDS).split() if text else []


class ItemAutomaton:
    """Suffix automaton of many word sequences.

    ``items`` are ``(item_id, words)``.  ``scan(words)`` returns the hit
    words as a boolean array and the set of indexes of the items of which a
    window occurs.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        seqs = [[self.vocab.setdefault(w, len(self.vocab)) for w in words] for _, words in items]
        self.step, self.link, self.length = [{}], [-1], [0]
        for seq in seqs:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        self._name_windows(seqs)
        self.shortest = min([window, *(len(s) for s in seqs if s)])
        #: one bit for each hashed pair of neighbours that an item has
        self.pairs = np.zeros(1 << 20, bool)
        for s in seqs:
            a = np.array(s, np.int64)
            self.pairs[self._slot(a[:-1], a[1:])] = True

    @staticmethod
    def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 0x9E3779B1 + b * 0x85EBCA77 >> 7) & ((1 << 20) - 1)

    def _extend(self, last: int, w: int) -> int:
        step, link, length = self.step, self.link, self.length
        if w in step[last]:
            q = step[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        new = self._state(length[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in step[p]:
            step[p][w] = new
            p = link[p]
        if p >= 0:
            q = step[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return new

    def _state(self, length: int, step: dict, link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.step) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = copy
            p = self.link[p]
        return copy

    def _name_windows(self, seqs: list[list[int]]) -> None:
        """For each state: the ancestor that holds its last ``window`` words
        (``full``), the items with that window (``items_of``) and the short
        items that end there (``short``)."""
        n = len(self.step)
        self.full, own = [-1] * n, [[] for _ in range(n)]
        order = sorted(range(1, n), key=self.length.__getitem__)
        for v in order:
            up = self.link[v]
            self.full[v] = v if self.length[v] >= self.window > self.length[up] else self.full[up]
        self.items_of: list[set[int]] = [set() for _ in range(n)]
        for k, seq in enumerate(seqs):
            v = 0
            for i, w in enumerate(seq):
                v = self.step[v][w]
                if i + 1 >= self.window:
                    self.items_of[self.full[v]].add(k)
            if 0 < len(seq) < self.window:
                own[v].append((len(seq), k))
        self.short: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for v in order:
            up = self.short[self.link[v]]
            self.short[v] = up + own[v] if own[v] else up

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        hit, found = np.zeros(len(words), bool), set()
        if len(words) < self.shortest or len(self.step) == 1:
            return hit, found
        get = self.vocab.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        for lo, hi in self._stretches(ids):
            self._stream(ids[lo:hi].tolist(), lo, hit, found)
        return hit, found

    def _stretches(self, ids: np.ndarray):
        """Stretches outside which no window can lie: all neighbours in them
        are neighbours in some item."""
        known = ids >= 0
        if not known.any():
            return
        joined = known[:-1] & known[1:] & self.pairs[self._slot(ids[:-1], ids[1:])]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], joined, [False])).view(np.int8)))
        if self.shortest == 1:
            cut = np.concatenate(([True], ~joined, [True]))
            at = np.flatnonzero(cut)
            spans = zip(at[:-1], at[1:])
            yield from ((a, b) for a, b in spans if known[a])
        else:
            for a, b in zip(edge[::2], edge[1::2]):
                if b - a + 1 >= self.shortest:
                    yield a, b + 1

    def _stream(self, ids: list[int], base: int, hit: np.ndarray, found: set[int]) -> None:
        step, link, length, full, short = self.step, self.link, self.length, self.full, self.short
        v = size = 0
        for i, w in enumerate(ids):
            while v and w not in step[v]:
                v = link[v]
                size = length[v]
            v = step[v].get(w, 0)
            size = size + 1 if v else 0
            if size >= self.window:
                hit[base + i - size + 1:base + i + 1] = True
                # windows that end here; those that end earlier were met there
                found |= self.items_of[full[v]]
            for m, k in short[v]:
                if m <= size:
                    hit[base + i - m + 1:base + i + 1] = True
                    found.add(k)


def item_shards(bench: DataFrame, id_col: str, text_col: str) -> list:
    """Broadcasts of ``[(item_id, words)]``, each within ``SHARD_BYTES``."""
    sc = bench.sparkSession.sparkContext
    items = bench.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total * 2 // SHARD_BYTES))
    shard = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    return [sc.broadcast([(r.item, words_of(r.text.encode())) for r in items.where(shard == k).collect()]) for k in range(n)]


class _Shards:
    """The automata of a task, one in memory at a time."""

    def __init__(self, shards: list, window: int):
        self.shards, self.window, self.held = shards, window, (-1, None, None)

    def scan(self, docs: list[list[bytes]]):
        hits = [np.zeros(len(w), bool) for w in docs]
        items: list[set] = [set() for _ in docs]
        for k, shard in enumerate(self.shards):
            if self.held[0] != k:
                names = shard.value
                self.held = (k, ItemAutomaton(names, self.window), [n for n, _ in names])
            _, auto, names = self.held
            for d, words in enumerate(docs):
                hit, found = auto.scan(words)
                if found:
                    hits[d] |= hit
                    items[d].update(names[i] for i in found)
        return hits, [sorted(x - {None}) for x in items]


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def find_items(docs: DataFrame, bench: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text",
               item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_hit, spans`` (from, to in words) and ``items``
    (ids as strings) of each document; a map over the documents."""
    shards = item_shards(bench, item_id, item_text)
    slice_bytes = SLICE_BYTES if len(shards) == 1 else 64 * SLICE_BYTES

    def run(batches):
        state = _Shards(shards, window)
        for b in batches:
            for at, texts in text_slices(b.column(1).cast(pa.binary()), slice_bytes):
                words = [words_of(t) for t in texts]
                hits, items = state.scan(words)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(at, len(texts)), pa.array([len(w) for w in words], pa.int64()),
                    pa.array([int(h.sum()) for h in hits], pa.int64()),
                    pa.array([[{"from": a, "to": z} for a, z in _runs(h)] for h in hits],
                             pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))),
                    pa.array(items, pa.list_(pa.string()))], ["doc_id", "n_words", "n_hit", "spans", "items"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return in_batches(source).mapInArrow(run, "doc_id long, n_words long, n_hit long, spans array<struct<from:long,to:long>>, items array<string>")


def cut_spans(text: str, runs: list[tuple[int, int]]) -> str:
    """``text`` without the words of each run and what stands between them."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for a, z in runs:
        out.append(text[last:at[a][0]])
        last = at[z - 1][1]
    return "".join([*out, text[last:]])


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """``docs`` (all its columns) without benchmark passages: hit spans are
    cut from ``text`` (again, until none is left) and ``n_chars``, if there,
    is set anew; a document of which more than ``max_coverage`` of the words
    is hit goes.  Other documents stay as they are."""
    shards = item_shards(bench, "item_id", "text")
    names = docs.columns
    ti, ni = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    slice_bytes = SLICE_BYTES if len(shards) == 1 else 64 * SLICE_BYTES

    def clean(b, state, texts):
        keep = np.ones(len(texts), bool)
        todo, first, changed = list(range(len(texts))), True, set()
        while todo:
            hits, _ = state.scan([words_of((texts[i] or "").encode()) for i in todo])
            again = []
            for i, h in zip(todo, hits):
                if not h.any():
                    continue
                if first and h.sum() > max_coverage * len(h):
                    keep[i] = False
                    continue
                texts[i] = cut_spans(texts[i], _runs(h))
                changed.add(i)
                again.append(i)
            todo, first = again, False
        cols = b.columns
        if changed:
            cols[ti] = pa.array(texts, b.schema.field(ti).type)
            if ni is not None:
                n = b.column(ni).to_pylist()
                for i in changed:
                    n[i] = len(texts[i])
                cols[ni] = pa.array(n, b.schema.field(ni).type)
        return pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep))

    def run(batches):
        let_go()
        state = _Shards(shards, window)
        for b in batches:
            for at, texts in text_slices(b.column(ti), slice_bytes):
                yield clean(b.slice(at, len(texts)), state, texts)

    return in_batches(docs, SMALL_BATCH).mapInArrow(run, docs.schema)
