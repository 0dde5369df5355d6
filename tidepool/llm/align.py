"""Alignment of two tokenizers with counts of linked ids, by external spills.

A text is encoded by a byte-level file (A, with a space before the text) and a
piece model (B).  Where tokens of both end at the same byte, a group ends; all
A-B token pairs of a group are linked.  How many documents of the corpus hold a
pair of ids linked is counted in four steps, none of which moves a document:

1. Tasks turn texts into records of pair and document, partition them by the
   radix of the A id, sort them and write them as zstd *runs*.  For each radix
   a run has a *segment*: its pairs and in how many of its documents each is.
2. Segments of a radix are read as streams and merged by a heap, ``FAN`` at a
   time, round by round, until one is left.
3. Segments are ordered by A id first, so the last merge knows the highest
   count of an A id when its stretch of pairs ends, and marks the pairs that
   reach it.
4. Totals stream back, a radix at a time, against the segments of the runs; each
   run gets its answers and sums them over its documents.

A pair that stands in every document is one row of each segment, so no key is
hot, and memory is bounded by the size of a run, a chunk and the fan-in.

Defined results: texts that are null or empty, or whose tokens do not give the
bytes of a space and the text, have no tokens and zeros; null and repeated ids
are rows like others (each row is a document); an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import os
from hashlib import sha256
from itertools import chain, groupby, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.bpe_rank import PATTERN, byte_symbols, text_slices
from tidepool.llm.common import in_batches, kept, saved

#: Radix partitions of the A ids.
RADIX = 64
#: A run is closed when it holds so many records, or documents.
RECORDS = 1 << 21
DOCS_BITS = 15
#: Links that are expanded at a time.
LINKS = 1 << 20
#: Segments that one heap merges, about.
FAN = 32
#: Pieces of texts whose ids a worker keeps.
CACHE = 400_000
#: Pairs of one chunk of a merged segment.
CHUNK = 1 << 19

DOCS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string"
COUNTED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
_RUNS = f"run long, radix int, part int, segment binary, postings binary, docs array<struct<{DOCS.replace(' ', ': ').replace(',:', ',')}>>"


flat = chain.from_iterable


class Pair:
    """The two tokenizers, and the bytes of their tokens.

    A never merges across the pieces that its pattern splits a text into, so
    the library sees each piece once and ids are kept by piece; B gets whole
    texts."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: k for k, c in enumerate(byte_symbols())}
        vocab = {**spec["model"]["vocab"], **{t["content"]: t["id"] for t in spec.get("added_tokens", [])}}
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.len_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.len_b = np.array([len(x) for x in self.bytes_b], np.int64)
        # ids with the sign that follows them in the text of groups
        self.names = [f"{i}{c}" for n, signs in ((len(self.bytes_a), ",|"), (len(self.bytes_b), ",;")) for c in signs for i in range(n)]
        self.pieces, self.known = regex.compile(PATTERN).findall, {}
        self.exact_b = self._exact_b()

    def _exact_b(self) -> bool:
        """Whether B's tokens give the bytes of every text without B's own mark
        for a space: it alters nothing and has a token for each byte."""
        from sentencepiece import sentencepiece_model_pb2
        model = sentencepiece_model_pb2.ModelProto.FromString(self.b.serialized_model_proto())
        how, trained, kind = model.normalizer_spec, model.trainer_spec, [p.type for p in model.pieces]
        piece = model.SentencePiece
        return (not how.precompiled_charsmap and how.add_dummy_prefix and how.escape_whitespaces and not how.remove_extra_whitespaces
                and trained.byte_fallback and not trained.treat_whitespace_as_suffix and kind.count(piece.BYTE) == 256 and piece.USER_DEFINED not in kind)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def _ids(self, pieces: set[str]) -> dict[str, bytes | None]:
        """Ids of A by piece, as 32-bit numbers; None for one whose ids do not
        give its bytes."""
        if len(self.known) > CACHE:
            self.known = dict(islice(self.known.items(), CACHE // 2, None))  # the oldest half goes
        new = [p for p in pieces if p not in self.known]
        if not new:
            return self.known
        ids = [e.ids for e in self.a.encode_batch_fast(new, add_special_tokens=False)]
        every = list(flat(ids))
        packed, end = np.array(every, np.int32).tobytes(), np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        at = (4 * end).tolist()
        self.known.update(zip(new, [packed[i:j] for i, j in zip([0, *at], at)]))
        # the bytes of all tokens are those of all pieces, and end where a piece ends
        made, raw = b"".join(map(self.bytes_a.__getitem__, every)), "".join(new).encode()
        stop = np.cumsum(np.append(0, self.len_a[every]))[end]
        if made != raw or (stop != np.cumsum([len(p.encode()) for p in new])).any():
            cut = stop.tolist()
            self.known.update((p, None) for p, i, j in zip(new, [0, *cut], cut) if made[i:j] != p.encode())
        return self.known

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[list[int]]]:
        """Ids of both sides, of A as 32-bit numbers; none where they do not
        give the text's bytes."""
        spaced = [f" {t}" if t else "" for t in texts]
        pieces = list(map(self.pieces, spaced))
        get, out = self._ids(set(flat(pieces))).__getitem__, ([], [])
        for t, own, b in zip(spaced, pieces, self.b.encode([t[1:] for t in spaced], num_threads=1)):
            try:
                a = b"".join(map(get, own))
            except TypeError:  # None
                a = None
            if a is None or ("▁" in t if self.exact_b else b"".join(map(self.bytes_b.__getitem__, b)) != t.encode()):
                a, b = b"", []
            out[0].append(a)
            out[1].append(b)
        return out


@kept
def pair_of(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


class Codes:
    """Pairs of ids as numbers: by radix of the A id, A id, B id."""

    def __init__(self, size_a: int, size_b: int):
        self.size_b, self.each = size_b, -(-size_a // RADIX)
        self.span = self.each * size_b  # codes of one radix
        assert RADIX * self.span < 1 << (62 - DOCS_BITS)
        a = np.arange(size_a)
        self.side = (a % RADIX * self.each + a // RADIX) * size_b

    def code(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.side[a] + b

    def ids(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        side = code // self.size_b
        return side % self.each * RADIX + side // self.each, code % self.size_b


# ------------------------------------------------------------- one slice

def _spread(n: np.ndarray) -> np.ndarray:
    """0, 1, … within each of some runs of the given lengths."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def _within(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in ``y``; both ascend."""
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x if len(y) else np.zeros(len(x), bool)


class Slice:
    """Tokens, groups and links of some texts.  All valid texts lie one after
    another on one line of bytes, so that groups are found for all at once."""

    def __init__(self, pair: Pair, texts: list[str | None]):
        a, b = pair.encode(texts)
        self.pair, self.n = pair, len(texts)
        self.n_a, self.n_b = (np.array(list(map(len, side)), np.int64) for side in (a, b))
        self.n_a //= 4
        self.a, self.b = np.frombuffer(b"".join(a), np.int32).astype(np.int64), np.fromiter(flat(b), np.int64, int(self.n_b.sum()))
        end_a, end_b = np.cumsum(pair.len_a[self.a]), np.cumsum(pair.len_b[self.b])
        cut_a, cut_b = _within(end_a, end_b), _within(end_b, end_a)
        self.group_a, self.group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        count = int(cut_a.sum())
        self.of_a, self.of_b = np.bincount(self.group_a, minlength=count), np.bincount(self.group_b, minlength=count)
        self.start_a, self.start_b = np.cumsum(self.of_a) - self.of_a, np.cumsum(self.of_b) - self.of_b
        self.doc = np.repeat(np.arange(self.n), self.n_a)[self.start_a] if count else np.zeros(0, np.int64)
        self.n_groups = np.bincount(self.doc, minlength=self.n)
        self.n_links = np.zeros(self.n, np.int64)
        np.add.at(self.n_links, self.doc, self.of_a * self.of_b)

    def texts(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        size_a, size_b = len(self.pair.bytes_a), len(self.pair.bytes_b)
        code = np.empty(len(self.a) + len(self.b), np.int64)
        last_a, last_b = (np.diff(g, append=-1) != 0 for g in (self.group_a, self.group_b))
        if len(code):
            code[np.arange(len(self.a)) + self.start_b[self.group_a]] = self.a + last_a * size_a
            code[np.arange(len(self.b)) + (self.start_a + self.of_a)[self.group_b]] = self.b + last_b * size_b + 2 * size_a
        out, at = [], 0
        for n in (self.n_a + self.n_b).tolist():
            out.append("".join(map(self.pair.names.__getitem__, code[at:at + n].tolist()))[:-1])
            at += n
        return out

    def links(self, codes: Codes, first: int):
        """Arrays of ``code << DOCS_BITS | document`` of about ``LINKS`` links
        each, with how often each stands (None: once an entry)."""
        per = self.of_a * self.of_b
        one = np.flatnonzero(per == 1)
        if len(one):
            yield codes.code(self.a[self.start_a[one]], self.b[self.start_b[one]]) << DOCS_BITS | self.doc[one] + first, None
        todo = np.flatnonzero((per > 1) & (per <= LINKS))
        total, i = np.cumsum(per[todo]), 0
        while i < len(todo):
            z = max(i + 1, int(np.searchsorted(total, total[i] - per[todo[i]] + LINKS, "right")))
            g = todo[i:z]
            n_a, n_b = self.of_a[g], self.of_b[g]
            x = np.repeat(self.start_a[g], n_a) + _spread(n_a)
            times = np.repeat(n_b, n_a)
            y = np.repeat(np.repeat(self.start_b[g], n_a), times) + _spread(times)
            yield codes.code(np.repeat(self.a[x], times), self.b[y]) << DOCS_BITS | np.repeat(np.repeat(self.doc[g], n_a), times) + first, None
            i = z
        for g in np.flatnonzero(per > LINKS).tolist():  # by different ids, not by tokens
            ids_a, m_a = np.unique(self.a[self.start_a[g]:self.start_a[g] + self.of_a[g]], return_counts=True)
            ids_b, m_b = np.unique(self.b[self.start_b[g]:self.start_b[g] + self.of_b[g]], return_counts=True)
            for a, m in zip(ids_a, m_a):
                yield codes.code(np.full(len(ids_b), a), ids_b) << DOCS_BITS | int(self.doc[g]) + first, m_b * m


# ------------------------------------------------------------------- runs

def _pack(*arrays: np.ndarray) -> bytes:
    """Columns of one length as a zstd frame of rows of 64-bit numbers."""
    rows = np.stack([np.asarray(x, np.int64) for x in arrays], 1)
    return zstandard.ZstdCompressor(level=1, write_content_size=True).compress(rows.tobytes())


def _unpack(blob: bytes, width: int):
    """Blocks of the rows of a frame, read as a stream."""
    with zstandard.ZstdDecompressor().stream_reader(blob) as f:
        while raw := f.read(8 * width << 12):
            yield np.frombuffer(raw, np.int64).reshape(-1, width)


def _whole(blob: bytes, width: int) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.int64).reshape(-1, width)


def _columns(blobs: list[np.ndarray]) -> bytes:
    """Arrays of their own lengths and types as one zstd frame."""
    head = np.array([[len(x), x.itemsize] for x in blobs], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(x.tobytes() for x in blobs))


def _split(blob: bytes, count: int) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 16 * count, []
    for n, size in np.frombuffer(raw, np.int64, 2 * count).reshape(-1, 2).tolist():
        out.append(np.frombuffer(raw, f"u{size}", n, at))
        at += n * size
    return out


def _least(x: np.ndarray) -> np.ndarray:
    """The same numbers, none negative, in the narrowest type."""
    top = int(x.max()) if len(x) else 0
    return x.astype("u1" if top < 1 << 8 else "u2" if top < 1 << 16 else "u4" if top < 1 << 32 else "u8")


def _heads(x: np.ndarray) -> np.ndarray:
    """Where a run of equal values starts."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


class Run:
    """Records of pair and document, kept until the run is closed."""

    def __init__(self):
        self.parts, self.size, self.docs = [], 0, [[] for _ in range(6)]

    def add(self, keys: np.ndarray, times: np.ndarray | None) -> None:
        self.parts.append((keys, times))
        self.size += len(keys)
        if self.size > 2 * RECORDS:
            self.parts = [self.sorted()]
            self.size = len(self.parts[0][0])

    def sorted(self) -> tuple[np.ndarray, np.ndarray]:
        """Records by pair and document, equal ones added up."""
        keys = np.concatenate([np.zeros(0, np.int64), *(k for k, _ in self.parts)])
        if all(t is None for _, t in self.parts):  # each link by itself
            keys.sort()
            head = _heads(keys)
            return keys[head], np.diff(np.append(head, len(keys)))
        times = np.concatenate([np.ones(len(k), np.int64) if t is None else t for k, t in self.parts])
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
        head = _heads(keys)
        return keys[head], np.add.reduceat(times, head)

    def rows(self, number: int, codes: Codes):
        """The run as record batches: its segments, then its postings."""
        keys, times = self.sorted()
        pair = keys >> DOCS_BITS
        head = _heads(pair)
        each = np.diff(np.append(head, len(pair)))
        pair = pair[head]
        edge = np.searchsorted(pair, np.arange(RADIX + 1) * codes.span)
        some = [k for k in range(RADIX) if edge[k] < edge[k + 1]]
        docs = pa.StructArray.from_arrays([pa.array(x, pa.string() if k == 5 else pa.int64()) for k, x in enumerate(self.docs)],
                                          [c.split(" ")[0] for c in DOCS.split(", ")])
        if some:
            yield _batch([number] * len(some), some, [_pack(pair[edge[k]:edge[k + 1]], each[edge[k]:edge[k + 1]]) for k in some],
                         [None] * len(some), pa.nulls(len(some), pa.list_(docs.type)))
        postings = _columns([_least(each), _least(keys & ((1 << DOCS_BITS) - 1)), _least(times)])
        yield _batch([number], [None], [None], [postings], pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs))


def _batch(run, radix, segment, postings, docs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(run, pa.int64()), pa.array(radix, pa.int32()), pa.array([0] * len(run), pa.int32()),
                                       pa.array(segment, pa.binary()), pa.array(postings, pa.binary()), docs],
                                      ["run", "radix", "part", "segment", "postings", "docs"])


def runs(docs: DataFrame, path_a: str, path_b: str, digest: bool, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The runs of a corpus, written to the checkpoint folder.  A run's number
    holds its partition's, so that a task that runs again gives the same."""
    def make(batches):
        pair = pair_of(path_a, path_b)
        codes = Codes(len(pair.bytes_a), len(pair.bytes_b))
        number, run = TaskContext.get().partitionId() << 24, Run()
        for b in batches:
            for at, texts in text_slices(b.column(1), rows=1 << (DOCS_BITS - 3)):
                if run.size >= RECORDS or len(run.docs[0]) + len(texts) > 1 << DOCS_BITS:
                    yield from run.rows(number, codes)
                    number, run = number + 1, Run()
                part, first = Slice(pair, texts), len(run.docs[0])
                for keys, times in part.links(codes, first):
                    run.add(keys, times)
                groups = part.texts()
                if digest:
                    groups = [sha256(g.encode()).hexdigest() if g else "" for g in groups]
                for own, new in zip(run.docs, (b.column(0).slice(at, len(texts)).to_pylist(), part.n_a.tolist(), part.n_b.tolist(),
                                               part.n_groups.tolist(), part.n_links.tolist(), groups)):
                    own.extend(new)
        if run.docs[0]:
            yield from run.rows(number, codes)

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return saved(in_batches(source).mapInArrow(make, _RUNS), "runs")


# ------------------------------------------------------------------ merges

def _stream(parts: list[bytes], width: int = 2):
    """``(code, count)`` of a segment's chunks, in their order."""
    for blob in parts:
        for block in _unpack(blob, width):
            yield from zip(*(c.tolist() for c in block.T))


def _merged(segments: list[list[bytes]]):
    """Codes in order with their counts added up, by a heap over all
    segments' streams."""
    for code, same in groupby(heapq.merge(*map(_stream, segments)), itemgetter(0)):
        yield code, sum(n for _, n in same)


def _marked(pairs, size_b: int):
    """``(code, count, best)``; pairs of one A id come one after another, so
    its highest count is known before they are passed on."""
    for _, own in groupby(pairs, lambda p: p[0] // size_b):
        own = list(own)
        top = max(n for _, n in own)
        for code, n in own:
            yield code, n, int(n == top)


def _chunks(rows, width: int):
    """Packed chunks of rows."""
    kept = []
    for r in rows:
        kept.append(r)
        if len(kept) == CHUNK:
            yield _pack(*zip(*kept))
            kept = []
    if kept:
        yield _pack(*zip(*kept))


def _segments(cell) -> list[tuple[int, list[bytes]]]:
    """``(run, chunks)`` of a list of structs run, part, segment."""
    rows = sorted((x["run"], x["part"], x["segment"]) for x in cell.as_py())
    return [(run, [s for _, _, s in own]) for run, own in groupby(rows, itemgetter(0))]


def _gathered(segments: DataFrame, groups: int) -> DataFrame:
    """Segments of a radix in groups of about ``FAN`` runs."""
    group = F.pmod(F.xxhash64("run"), F.lit(groups)).alias("group")
    return segments.groupBy("radix", group).agg(F.collect_list(F.struct("run", "part", "segment")).alias("segments"))


def totals(segments: DataFrame, size_b: int) -> DataFrame:
    """``radix, part, segment``: chunks of ``(code, count, best)`` of all."""
    n = segments.agg(F.count_distinct("run")).first()[0]
    while True:
        groups = max(1, -(-n // FAN))
        last = groups == 1

        def merge(batches, last=last):
            for b in batches:
                for radix, group, cell in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                    rows = _merged([s for _, s in _segments(cell)])
                    for part, blob in enumerate(_chunks(_marked(rows, size_b) if last else rows, 3 if last else 2)):
                        yield pa.RecordBatch.from_arrays([pa.array([radix], pa.int32()), pa.array([group], pa.int64()), pa.array([part], pa.int32()), pa.array([blob], pa.binary())],
                                                         ["radix", "run", "part", "segment"])

        segments = saved(in_batches(_gathered(segments, groups)).mapInArrow(merge, "radix int, run long, part int, segment binary"), "merged")
        if last:
            return segments.select("radix", "part", "segment")
        n = groups


def _answers(segments: DataFrame, sums: DataFrame, groups: int) -> DataFrame:
    """``run, answers``: for each run its segments' totals, by radix."""
    def look(batches):
        for b in batches:
            for radix, cell, all_ in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                own = [(run, np.concatenate([_whole(s, 2)[:, 0] for s in parts])) for run, parts in _segments(cell)]
                found = [np.zeros((len(c), 2), np.int64) for _, c in own]
                for x in sorted(all_.as_py(), key=itemgetter("part")):
                    for block in _unpack(x["segment"], 3):  # each pair of a run is in one block
                        for (_, codes), got in zip(own, found):
                            lo, hi = np.searchsorted(codes, block[0, 0]), np.searchsorted(codes, block[-1, 0], "right")
                            got[lo:hi] = block[np.searchsorted(block[:, 0], codes[lo:hi]), 1:]
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in own], pa.int64()), pa.array([radix] * len(own), pa.int32()),
                                                  pa.array([_pack(*f.T) for f in found], pa.binary())], ["run", "radix", "segment"])

    sums = sums.groupBy("radix").agg(F.collect_list(F.struct("part", "segment")).alias("totals"))
    both = _gathered(segments, groups).join(sums, "radix").select("radix", "segments", "totals")
    found = in_batches(both).mapInArrow(look, "run long, radix int, segment binary")
    return found.groupBy("run").agg(F.collect_list(F.struct("radix", "segment")).alias("answers"))


def _summed(batches):
    """The documents of runs with the sums of their answers."""
    for b in batches:
        for postings, docs, answers in zip(b.column(0), b.column(1), b.column(2)):
            each, doc, times = _split(postings.as_py(), 3)
            got = [_whole(x["segment"], 2) for x in sorted(answers.as_py() or [], key=itemgetter("radix"))]
            got = np.repeat(np.concatenate(got) if got else np.zeros((0, 2), np.int64), each, axis=0) * times.astype(np.int64)[:, None]
            cols, n = docs.values, len(docs.values)
            sums = np.zeros((n, 2), np.int64)
            np.add.at(sums, doc.astype(np.int64), got)
            field = cols.field
            yield pa.RecordBatch.from_arrays(
                [field("doc_id"), field("n_a"), field("n_b"), field("n_groups"), field("n_links"),
                 pa.array(sums[:, 1]), pa.array(sums[:, 0]), field("groups")], [c.split(" ")[0] for c in COUNTED.split(", ")])


def _counted(docs: DataFrame, path_a: str, path_b: str, digest: bool, options: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    made = runs(docs, path_a, path_b, digest, **options)
    segments = made.where("segment is not null").select("run", "radix", "part", "segment")
    return made, segments, totals(segments, len(pair_of(path_a, path_b).bytes_b))


def align(docs: DataFrame, path_a: str, path_b: str, digest: bool = False, **options) -> DataFrame:
    """A row for each document: numbers of tokens, groups and links, the sum of
    its links' counts over the corpus (``count_sum``), how many links have the
    highest count of their A id (``n_best``), and ``groups``, the ids of both
    sides (with ``digest`` their SHA-256)."""
    made, segments, sums = _counted(docs, path_a, path_b, digest, options)
    groups = max(1, -(-made.where("postings is not null").count() // FAN))
    answers = _answers(segments, sums, groups)
    whole = made.where("postings is not null").select("run", "postings", "docs").join(answers, "run", "left")
    return in_batches(whole.select("postings", "docs", "answers")).mapInArrow(_summed, COUNTED)


def pair_counts(docs: DataFrame, path_a: str, path_b: str, **options) -> DataFrame:
    """``a, b, count, best``: in how many documents each pair of ids is linked,
    and whether that is the most for its A id."""
    sums = _counted(docs, path_a, path_b, True, options)[2]

    def run(batches):
        pair = pair_of(path_a, path_b)
        codes = Codes(len(pair.bytes_a), len(pair.bytes_b))
        for b in batches:
            for blob in b.column(0):
                for block in _unpack(blob.as_py(), 3):
                    a, c = codes.ids(block[:, 0])
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c), pa.array(block[:, 1]), pa.array(block[:, 2] > 0)], ["a", "b", "count", "best"])

    return in_batches(sums.select("segment")).mapInArrow(run, "a long, b long, count long, best boolean")
