"""Near-duplicate passages by compact windows.

Tokens are the hashes of a document's word shingles.  Under one min-hash
function every subsequence has the token of least hash as its signature; the
Cartesian tree of the hashes gives, for each token, the compact window in which
all subsequences with that token share it.  Only windows at least as long as a
passage matter.  Two copies of a passage share, for each hash function, a
window with the same token, so windows are joined by function and token: each
occurrence is tied to the earliest one (smallest id, then place).  Windows of a
pair of documents are intervals; where those of enough functions overlap, the
pair is verified on its whole texts: runs of equal shingles, chained over small
gaps, must reach the passage length and the Jaccard similarity.

An occurrence that its earliest one does not confirm (a common line within two
different passages) is tied a second time, by the token and the 24 shingles to
its right, or to its left: of an exact passage of more than 50 words, one of
the two lies within the passage.  What is then not covered is tied by the hash
of whole passages, so that every exact passage meets the earliest document that
has it.

Each task first ties the windows of its own batch, so that a token that many
documents share is shuffled once a batch.  Pairs grow with the copies, not
with their square.

Defined results: null and empty texts and those shorter than a passage have no
windows; repetition within one document (or under one id) is no finding; rows
with a null id are not compared; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.bpe_rank import text_slices
from tidepool.llm.common import SMALL_BATCH, free_name, in_batches, let_go, pieces, saved, small
from tidepool.llm.hashing import WordHashes, mix, shingle_hashes, word_hashes, words_of

SHINGLE = 5
PASSAGE = 50  # words
SIMILARITY = 0.8
HASHES = 4
#: Functions of which windows must overlap before a pair is verified.
ENOUGH = 2
#: Unequal shingles between two runs of a passage.
GAP = 2 * SHINGLE
CONTEXT = 24

_ROWS = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("pos", pa.int64()), ("near", pa.int64()), ("more", pa.bool_()), ("token", pa.int64()), ("source", pa.int64())])
_DDL = "key long, id long, pos long, near long, more boolean, token long, source long"
#: Shingles whose windows are looked for at a time (a longer text by itself).
SLICE = 1 << 16
SPANS = "doc_id long, first_word long, end_word long, source_id long, source_first long, source_end long, similarity double"


def _over(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each ``width`` values in a row."""
    size = 1
    while size * 2 <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return pick(x[:len(x) - rest], x[rest:]) if rest else x


def pivots(h: np.ndarray, start: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """Places that hold the least value of some ``width`` values in a row
    within their document; ``start`` and ``end`` give its extent, by place."""
    if len(h) < width:
        return np.zeros(0, np.int64)
    low = _over(h, width, np.minimum)
    at = np.arange(len(low))
    low[at + width > end[:len(low)]] = 0
    pad = np.zeros(width - 1, np.uint64)
    high = _over(np.concatenate((pad, low, pad)), width, np.maximum)
    return np.flatnonzero((high == h) & (h > 0))


def extents(h: np.ndarray, at: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Left and right ends of the compact windows of the places ``at``, by the
    Cartesian tree of their values (a smaller value next to a pivot's window
    is a pivot itself, so no other place is needed)."""
    if not len(at):
        return at, at
    doc = start[at]
    own = np.arange(len(at)) + np.cumsum(np.concatenate(([True], doc[1:] != doc[:-1])))
    value, place = np.zeros(own[-1] + 2, h.dtype), np.full(own[-1] + 2, -1)  # a zero before each document and after the last
    value[own], place[own] = h[at], at
    value = value.tolist()
    less, after = [0] * len(value), [0] * len(value)  # the next place to the left that is not above, to the right that is below
    for i in range(1, len(value)):
        v, j = value[i], i - 1
        while value[j] > v:
            after[j] = i
            j = less[j]
        less[i] = j
    left, right = place[np.array(less)[own]], place[np.array(after)[own]]
    return np.where(left < 0, doc, left + 1), np.where(right < 0, end[at], right) - 1


def _found(parts: list[np.ndarray], owner: list[int], width: int, hashes: int):
    """Windows of some texts: arrays of key, id, pos (place, and how far the
    window reaches to both sides) and near (hashes of both sides)."""
    n = np.array([len(p) for p in parts])
    s = np.concatenate(parts)
    start, end = np.repeat(np.cumsum(n) - n, n), np.repeat(np.cumsum(n), n)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(s)))
    doc = np.repeat(np.arange(len(n)), n)
    out = []
    for k in range(hashes):
        h = mix(s + np.uint64((k + 1) << 32))
        at = pivots(h, start, end, width)
        left, right = extents(h, at, start, end)
        keep = right - left + 1 >= width
        at, left, right = at[keep], left[keep], right[keep]
        key = mix(s[at] ^ mix(np.full(len(at), k + 1, np.uint64)))
        key = key & ~np.uint64(7) | np.uint64(k)  # the function can be read from the key
        ahead = mix(total[np.minimum(at + CONTEXT, end[at])] - total[at])
        behind = mix(total[at + 1] - total[np.maximum(at + 1 - CONTEXT, start[at])])
        near = ahead >> np.uint64(32) << np.uint64(32) | behind >> np.uint64(32)
        pos = at - start[at] << 32 | np.minimum(at - left, 65535) << 16 | np.minimum(right - at, 65535)
        out.append((key, np.array(owner)[doc[at]], pos, near))
    return map(np.concatenate, zip(*out))


def windows(docs: DataFrame, shingle: int, passage: int, hashes: int) -> DataFrame:
    """Windows by key.  Of those of a batch with one key the first is a row
    under it (``more``: it has others); each other is a row under a key of its
    own, with the ``token`` it shares and the ``source`` that is first."""
    width = passage - shingle + 1

    def rows(key, ids, pos, near, more, token, source):
        none = lambda x: pa.nulls(len(key), pa.int64()) if x is None else pa.array(x)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids), pa.array(pos), pa.array(near.view(np.int64)),
                                           pa.array(more), none(token), none(source)], schema=_ROWS)

    def run(batches):
        let_go()
        words = WordHashes()
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            parts, owner, size, found = [], [], 0, []
            for i in np.argsort(ids, kind="stable"):
                w = words_of(b.column(1)[int(i)].as_py())
                if len(w) < passage:
                    continue
                parts.append(words.shingles(w, shingle))
                owner.append(ids[i])
                size += len(w)
                if size >= SLICE:
                    found.append(tuple(_found(parts, owner, width, hashes)))
                    parts, owner, size = [], [], 0
            if parts:
                found.append(tuple(_found(parts, owner, width, hashes)))
            if not found:
                continue
            key, ids, pos, near = map(np.concatenate, zip(*found))
            order = np.argsort(key, kind="stable")  # of one key, in the order of id and place
            key, ids, pos, near = key[order], ids[order], pos[order], near[order]
            head = np.concatenate(([True], key[1:] != key[:-1]))
            group = np.cumsum(head) - 1
            yield from pieces(rows(key[head], ids[head], pos[head], near[head], np.bincount(group) > 1, None, None))
            rest = ~head
            if rest.any():
                own = mix(key[rest] ^ mix(ids[rest].view(np.uint64) + pos[rest].view(np.uint64)))
                yield from pieces(rows(own, ids[rest], pos[rest], near[rest], np.zeros(int(rest.sum()), bool), key[rest].view(np.int64), ids[head][group][rest]))

    return in_batches(docs, SMALL_BATCH).mapInArrow(run, _DDL)


def _reaching(at: np.ndarray, width: int, gap: int) -> np.ndarray:
    """Those of the places ``at`` (ascending) that lie in stretches without a
    step above ``gap + 1`` and at least ``width`` long; no passage has others."""
    if not len(at):
        return at
    cut = np.flatnonzero(np.diff(at) > gap + 1)
    first, last = np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(at) - 1]))
    return at[np.repeat(at[last] - at[first] + 1 >= width, last - first + 1)]


def _runs(a: np.ndarray, b: np.ndarray, width: int, gap: int, step: int = 1 << 20) -> list[list[int]]:
    """All longest runs ``[from, to, from_b, to_b]`` of equal shingles, on every
    diagonal, in the order of a; without those that no passage can hold."""
    _, codes = np.unique(np.concatenate((a, b)), return_inverse=True)
    one, two = codes[:len(a)], codes[len(a):]

    def among(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        has = np.zeros(len(codes), bool)
        has[y] = True
        return has[x]

    at, to = _reaching(np.flatnonzero(among(one, two)), width, gap), np.arange(len(b))
    while len(at):
        to = _reaching(np.flatnonzero(among(two, one[at])), width, gap)
        less = _reaching(at[among(one[at], two[to])], width, gap) if len(to) else at[:0]
        if len(less) == len(at):
            break
        at = less
    if not len(at):
        return []
    order = to[np.argsort(two[to], kind="stable")]
    count = np.bincount(two[to], minlength=len(codes))
    lo, n = (np.cumsum(count) - count)[one[at]], count[one[at]]
    total, found, i = np.cumsum(n), [], 0
    while i < len(at):  # matches of about ``step`` at a time, by diagonal and place
        z = max(i + 1, int(np.searchsorted(total, total[i] - n[i] + step, "right")))
        m = n[i:z]
        inner = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        x, y = np.repeat(at[i:z], m), order[np.repeat(lo[i:z], m) + inner]
        key = np.sort((y - x + len(a)) << 32 | x)
        cut = np.flatnonzero(np.diff(key) != 1)
        found.append(np.stack((key[np.concatenate(([0], cut + 1))], key[np.concatenate((cut, [len(key) - 1]))]), 1))
        i = z
    runs = np.concatenate(found)
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    head = np.concatenate(([True], runs[1:, 0] != runs[:-1, 1] + 1))
    first, last = runs[head, 0], runs[np.append(np.flatnonzero(head)[1:] - 1, len(runs) - 1), 1]
    shift, low = (first >> 32) - len(a), (1 << 32) - 1
    out = np.stack((first & low, last & low, (first & low) + shift, (last & low) + shift), 1)
    return out[np.lexsort((out[:, 2], out[:, 0]))].tolist()


def _chains(runs: list[list[int]], gap: int) -> list[list[list[int]]]:
    """Chains of runs over gaps in both texts: each run goes on from the open
    chain that holds most equal shingles, of equal ones the first.  Where two
    runs overlap, the second is cut.  Diagonals of runs that follow each other
    are at most ``gap`` apart, so open runs are kept by slices of diagonals."""
    score, back, part, used, live = [], [], [], [False] * len(runs), {}
    for k, (i, j, p, q) in enumerate(runs):
        n, since, slice_ = j - i + 1, i - gap - 1, (p - i) // (gap + 1)
        best, prev, own = 0, -1, [i, j, p, q]
        for s in (slice_ - 1, slice_, slice_ + 1):
            near = live.get(s)
            if not near:
                continue
            ended = False
            for x in near:
                _, e, _, f = runs[x]
                if e < since:
                    ended = True
                    continue
                cut = e + 1 - i if e - i > f - p else f + 1 - p
                if cut < 0:
                    cut = 0
                held = score[x] - cut
                if (held > best or held == best and x < prev) and cut < n and i + cut - e <= gap + 1 and p + cut - f <= gap + 1:
                    best, prev, own = held, x, [i + cut, j, p + cut, q]
            if ended:
                live[s] = [x for x in near if runs[x][1] >= since]
        score.append(best + n)
        back.append(prev)
        part.append(own)
        if prev >= 0:
            used[prev] = True
        live.setdefault(slice_, []).append(k)
    out = []
    for k in range(len(runs)):
        if not used[k]:
            chain, x = [], k
            while x >= 0:
                chain.append(part[x] if back[x] >= 0 else runs[x])
                x = back[x]
            out.append(chain[::-1])
    return out


def matching_spans(a: np.ndarray, b: np.ndarray, width: int, similarity: float, gap: int = GAP) -> list[tuple[int, int, int, int, float]]:
    """Passages ``(from, to, from_b, to_b, similarity)`` of two shingle
    sequences, ends included: the longest parts of chains of equal runs that
    have at least ``width`` and ``similarity``; none lies within another."""
    if len(a) == len(b) and (a == b).all():
        return [(0, len(a) - 1, 0, len(a) - 1, 1.0)] if len(a) >= width else []
    runs, found = _runs(a, b, width, gap), []
    # a run of the length of a passage is one by itself, whatever it is chained to
    for chain in [*_chains(runs, gap), *([r] for r in runs if r[1] - r[0] + 1 >= width)]:
        if chain[-1][1] - chain[0][0] + 1 < width:
            continue
        if len(chain) == 1:  # equal throughout
            found.append((*chain[0], 1.0))
            continue
        at, reach = np.array(chain), -1
        _, codes = np.unique(np.concatenate((a[at[0, 0]:at[-1, 1] + 1], b[at[0, 2]:at[-1, 3] + 1])), return_inverse=True)
        n = at[-1, 1] + 1 - at[0, 0]
        one, two, none = codes[:n], codes[n:], len(chain)
        for x in range(len(chain)):
            if at[-1, 1] - at[x, 0] + 1 < width or reach == len(chain) - 1:
                break
            # for each shingle, the first part of the chain that has it, in a and in b
            seen = []
            for side, own in ((0, one), (2, two)):
                part = own[at[x, side] - at[0, side]:]
                first = np.full(len(codes), len(part))
                first[part[::-1]] = np.arange(len(part) - 1, -1, -1)
                seen.append(np.searchsorted(at[x:, side + 1] - at[x, side], first))
            count = [np.cumsum(np.bincount(y, minlength=none + 1))[:none - x] for y in (*seen, np.maximum(*seen))]
            alike = count[2] / (count[0] + count[1] - count[2])
            fits = np.flatnonzero((at[x:, 1] - at[x, 0] + 1 >= width) & (alike >= similarity))
            if len(fits) and x + int(fits[-1]) > reach:
                reach = x + int(fits[-1])
                found.append((chain[x][0], chain[reach][1], chain[x][2], chain[reach][3], float(alike[fits[-1]])))
    out, far = [], -1
    for r in sorted(found, key=lambda r: (r[0], -r[1], -r[4], r[2])):
        if r[1] > far:
            far = r[1]
            out.append(r)
    return out


def verify(pairs: DataFrame, docs: DataFrame, shingle: int, passage: int, similarity: float) -> DataFrame | None:
    """Spans of ``pairs(doc, source)``, which are saved, by the whole texts;
    None without pairs."""
    width = passage - shingle + 1
    if pairs.isEmpty():
        return None
    one = docs.join(small(pairs), F.col("doc_id") == F.col("doc")).select("source", "doc", F.col("text").alias("text_a"))
    two = docs.join(small(pairs.select("source").distinct()), F.col("doc_id") == F.col("source")).select("source", F.col("text").alias("text_b"))

    def run(batches):
        let_go()
        last, kept = None, None
        names = [c.split(" ")[0] for c in SPANS.split(", ")]
        types = [pa.float64() if c.endswith("double") else pa.int64() for c in SPANS.split(", ")]
        for x in batches:
            rows = []
            for doc, source, ta, tb in zip(*x.columns):
                if (source.as_py(), tb) != last:
                    last, kept = (source.as_py(), tb), shingle_hashes(word_hashes(tb.as_py()), shingle)
                for i, j, p, q, alike in matching_spans(shingle_hashes(word_hashes(ta.as_py()), shingle), kept, width, similarity):
                    rows.append((doc.as_py(), i, j + shingle, source.as_py(), p, q + shingle, alike))
            cols = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    both = in_batches(one.join(two, "source").select("doc", "source", "text_a", "text_b"), SMALL_BATCH)
    return saved(both.mapInArrow(run, SPANS).distinct(), "spans")


def _pairs(tied: DataFrame, enough: int) -> DataFrame:
    """Pairs of documents with overlapping windows of ``enough`` functions.
    ``tied`` has the window's ``id``, ``pos`` and ``key`` and its ``source``."""
    place = F.shiftright("pos", 32)
    span = tied.where("id <> source").select(
        "id", "source", (F.col("key").bitwiseAND(F.lit(7))).alias("k"), (place - F.shiftright("pos", 16).bitwiseAND(F.lit(65535))).alias("lo"),
        (place + F.col("pos").bitwiseAND(F.lit(65535))).alias("hi"))
    if enough == 1:
        return span.select(F.col("id").alias("doc"), "source").distinct()
    # windows in the order of their left ends; one group as long as they overlap
    w = Window.partitionBy("id", "source").orderBy("lo", "hi")
    group = span.withColumn("new", (F.col("lo") > F.coalesce(F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int"))
    group = group.withColumn("g", F.sum("new").over(w))
    functions = F.bit_count(F.bit_or(F.expr("shiftleft(1, cast(k as int))")))
    return (group.groupBy("id", "source", "g").agg(functions.alias("n")).where(F.col("n") >= enough)
            .select(F.col("id").alias("doc"), "source").distinct())


def _uncovered(rows: DataFrame, spans: DataFrame, lo, end) -> DataFrame:
    """Those of ``rows(id, ...)`` of which no span of the same document holds
    the words from ``lo`` to before ``end``: of the spans that begin there or
    before, none reaches as far."""
    names = rows.columns
    rows = rows.withColumns({"_lo": lo.cast("long"), "_end": end.cast("long"), "_span": F.lit(None).cast("long")})
    more = spans.select(F.col("doc_id").alias("id"), F.col("first_word").alias("_lo"), F.col("end_word").alias("_span")).distinct()
    w = Window.partitionBy("id").orderBy("_lo").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.unionByName(more, allowMissingColumns=True).withColumn("_far", F.max("_span").over(w))
    return both.where("_span is null and (_far is null or _far < _end)").select(*names)


def repeated_passages(docs: DataFrame, passage: int = PASSAGE, similarity: float = SIMILARITY, shingle: int = SHINGLE,
                      hashes: int = HASHES, enough: int = ENOUGH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each passage of a document that an earlier one has too:
    ``doc_id``, its words from ``first_word`` to before ``end_word``, and the
    same of the earlier document."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    w = Window.partitionBy("key")
    rows = (windows(docs, shingle, passage, hashes)
            .withColumn("first", F.min("id").over(w)).withColumn("last", F.max("id").over(w))
            .where("first < last or more or token is not null"))
    rows = saved(rows.select(F.coalesce("token", "key").alias("key"), "id", "pos", "near", F.coalesce("source", "first").alias("source")), "windows")
    tried = saved(_pairs(rows, enough), "pairs")
    spans = verify(tried, docs, shingle, passage, similarity)
    if spans is None:
        spans = docs.sparkSession.createDataFrame([], SPANS)

    # tokens with an occurrence that no confirmed passage covers
    place = F.shiftright("pos", 32)
    left = rows.where("id <> source").select("key", "id", place.alias("place"))
    left = _uncovered(left, spans, F.col("place"), F.col("place") + 1).select("key").distinct()
    left = small(saved(left, "left"))  # few tokens; a hot one needs no shuffle of its rows
    # each side of the token is a key of its own
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.shiftrightunsigned("near", 32).alias("near")),
                              F.struct(F.lit(1).alias("side"), F.col("near").bitwiseAND(F.lit(0xFFFFFFFF)).alias("near"))))
    again = rows.join(left, "key").select("key", "id", "pos", "source", sides.alias("c")).select("key", "id", "pos", "source", "c.side", "c.near")
    again = saved(again, "sides")
    first = again.groupBy("key", "side", "near").agg(F.min("id").alias("other"), F.max("id").alias("last")).where("other < last").drop("last")
    tied = (again.join(first, ["key", "side", "near"]).where("other <> id")
            .select("key", "id", "pos", F.col("other").alias("source")))
    again = saved(_pairs(tied, 1).join(tried, ["doc", "source"], "left_anti"), "pairs")
    more = verify(again, docs, shingle, passage, similarity)
    tried, spans = tried.union(again), spans if more is None else spans.union(more)

    last = saved(exact_pairs(rows, spans, docs, shingle, passage).join(tried, ["doc", "source"], "left_anti"), "pairs")
    more = verify(last, docs, shingle, passage, similarity)
    return spans if more is None else spans.union(more)


def exact_pairs(rows: DataFrame, spans: DataFrame, docs: DataFrame, shingle: int, passage: int) -> DataFrame:
    """``doc, source`` of documents that share a whole passage word for word
    which no span covers; ``source`` is the smallest id that has it.

    Copies of a passage share its token under the first function, and the
    ``CONTEXT`` shingles on the side of the token that is longer within it.
    Where a group of these holds an occurrence that is not covered as far as
    its window reaches, every passage length around its members is hashed."""
    width = passage - shingle + 1
    assert width <= 2 * CONTEXT - 1
    place = F.shiftright("pos", 32)
    one = rows.where(F.col("key").bitwiseAND(F.lit(7)) == 0).select(
        "key", "id", place.alias("place"), F.greatest(place - F.shiftright("pos", 16).bitwiseAND(F.lit(65535)), place - (width - 1)).alias("lo"),
        F.least(place + F.col("pos").bitwiseAND(F.lit(65535)), place + (width - 1)).alias("hi"), "near")
    # what a side's passages reach: at least CONTEXT shingles to that side
    both = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.shiftrightunsigned("near", 32).alias("near"),
                                      F.greatest("lo", F.col("place") + (CONTEXT - width)).alias("lo"), F.col("hi").alias("hi")),
                             F.struct(F.lit(1).alias("side"), F.col("near").bitwiseAND(F.lit(0xFFFFFFFF)).alias("near"),
                                      F.col("lo").alias("lo"), F.least("hi", F.col("place") + (width - CONTEXT)).alias("hi"))))
    both = one.select("key", "id", "place", both.alias("c")).select("key", "id", "place", "c.*").where(F.col("hi") - F.col("lo") >= width - 1)
    group = both.groupBy("key", "side", "near").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    both = saved(both.join(group, ["key", "side", "near"]), "contexts")
    open_ = _uncovered(both.where("id > first"), spans, F.col("lo"), F.col("hi") + shingle).select("key", "side", "near").distinct()
    look = both.join(small(saved(open_, "open")), ["key", "side", "near"]).groupBy("id").agg(F.collect_set(F.struct("lo", "hi")).alias("look"))
    look = saved(look, "look")
    texts = docs.join(small(look, 50_000), F.col("doc_id") == F.col("id")).select("id", "text", "look")

    def run(batches):
        words = WordHashes()
        for b in batches:
            for i, t, look in zip(*b.columns):
                s = words.shingles(words_of(t.as_py()), shingle)
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(s)))
                start = np.zeros(len(s) + 1, bool)  # of rows that share an id, a text may be shorter
                for x in look.as_py():
                    start[x["lo"]:max(0, min(x["hi"] + 1, len(s)) - width + 1)] = True
                at = np.flatnonzero(start)
                if len(at):
                    h = np.unique(mix(total[at + width] - total[at] ^ s[at])).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), i.as_py(), np.int64))], ["h", "id"])

    hashes = saved(in_batches(texts, SMALL_BATCH).mapInArrow(run, "h long, id long"), "exact")
    first = hashes.groupBy("h").agg(F.min("id").alias("source"), F.max("id").alias("last")).where("source < last").drop("last")
    return hashes.join(first, "h").where("id <> source").select(F.col("id").alias("doc"), "source").distinct()


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of each span and what stands between them."""
    at = [m.span() for m in _WORD.finditer(text)]
    gone = np.zeros(len(at) + 2, bool)
    for a, z in spans:
        gone[a + 1:z + 1] = True
    edge = np.flatnonzero(np.diff(gone.view(np.int8)))
    out, last = [], 0
    for a, z in zip(edge[::2].tolist(), edge[1::2].tolist()):
        out.append(text[last:at[a][0]])
        last = at[z - 1][1]
    return "".join([*out, text[last:]])


def drop_repeats(docs: DataFrame, **options) -> DataFrame:
    """``docs`` (all its columns) with each repeated passage kept only where
    it stands first; ``n_chars``, if there, is set anew where text was cut.
    A document of which no word is left goes."""
    spans = repeated_passages(docs, **options)
    own, key = free_name(docs, "_cuts"), free_name(docs, "_id")
    cuts = spans.groupBy(F.col("doc_id").alias(key)).agg(F.collect_set(F.struct("first_word", "end_word")).alias(own))
    names = docs.columns
    ti, ni = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def clean(b, texts):
        cols, keep = b.columns[:-1], np.ones(len(texts), bool)
        todo = [(i, c) for i, c in enumerate(b.column(len(names)).to_pylist()) if c]
        if todo:
            chars = cols[ni].to_pylist() if ni is not None else None
            for i, spans in todo:
                texts[i] = cut_words(texts[i], [(c["first_word"], c["end_word"]) for c in spans])
                keep[i] = bool(_WORD.search(texts[i]))
                if chars:
                    chars[i] = len(texts[i])
            cols[ti] = pa.array(texts, b.schema.field(ti).type)
            if chars:
                cols[ni] = pa.array(chars, b.schema.field(ni).type)
        return pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep))

    def run(batches):
        for b in batches:
            for at, texts in text_slices(b.column(ti)):
                yield clean(b.slice(at, len(texts)), texts)

    cuts = saved(cuts, "cuts")
    joined = docs.join(small(cuts, 50_000), F.col("doc_id") == F.col(key), "left").drop(key)
    return in_batches(joined, SMALL_BATCH).mapInArrow(run, docs.schema)
