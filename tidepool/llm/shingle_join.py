"""N-gram Jaccard join with parity sketches.

A document's set holds its distinct word shingles.  XOR-hashing the set into a
bit sketch (every shingle flips one bit) gives sketches whose Hamming distance
is at most the symmetric difference of the sets.  Two sets with a Jaccard
similarity of at least t differ in at most (1 - t) / (1 + t) of the sum of
their sizes, so:

* sizes fall into bands such that linked sets lie in the same or in
  neighbouring bands, and each pair of bands has a largest difference ``d``;
* for each pair of bands the sketch is cut into ``d + 1 + spare`` blocks; of
  two linked sets at most ``d`` blocks differ, so at least ``1 + spare`` are
  equal.  A block is kept as the XOR of the codes of its set bits;
* blocks of one shingle or none say little.  A document with at most
  ``spare`` of those leaves them out: if all equal blocks of a pair were such
  blocks, both documents would have more than ``spare`` of them.

Each task first joins the blocks of its own batch, so that of a block that
many documents share one row a batch is shuffled.  A window over the block then
ties every document to the smallest id.  These pairs are verified on the whole
texts, first the one pair of each document that shares most blocks, then the
pairs that are still in different components.  In blocks whose documents are still in
several components, each document outside the largest of these is verified
against the nearest, by a 1024-bit sketch, of the members of that component that
its blocks name, as long as this finds links.  At last every document that is
still outside is held against all others of its block, filtered by size and
sketch, and what passes is verified.  So no link between different sets is lost,
while a group of near copies costs its size, not its square.

Shingles are compared by 64-bit hashes, whole sets for equality by 128 bits.

Defined results: a text with fewer words than a shingle has one shingle, the
whole sequence; null and empty texts and texts without words have none and are
linked with nothing; a row with a null id has a null component; rows that
share an id are one node.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.common import SMALL_BATCH, components, fits, in_batches, let_go, pieces, saved, small
from tidepool.llm.hashing import mix, shingle_hashes, word_hashes

SHINGLE = 4
#: Similarity as a fraction: 100 * intersection >= PERCENT * union.
PERCENT = 85
SKETCH = 1024
#: Rows with a sketch (about 200 bytes each) that are broadcast.
SKETCHES = 100_000

_INFO = pa.struct([("n", pa.int64()), ("h0", pa.int64()), ("h1", pa.int64()), ("sketch", pa.list_(pa.int64()))])
_ROWS = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("id", pa.int64()), ("info", _INFO)])
_DDL = "kind byte, key long, id long, info struct<n:long,h0:long,h1:long,sketch:array<long>>"
BLOCK, DOCUMENT, LOCAL = 0, 1, 2


def largest_difference(a, b, percent: int = PERCENT):
    """The most in which sets of sizes a and b can differ and be linked."""
    return (100 - percent) * (a + b) // (100 + percent)


class Bands:
    """Size bands and the blocks of each pair of neighbouring bands."""

    def __init__(self, percent: int = PERCENT):
        self.percent, self.low, self.blocks = percent, [1], []

    def schemes(self, n: int):
        """``(band, blocks, spare)`` of each scheme that a set of size n takes
        part in: that of its own band and of the band below."""
        while self.low[-1] <= n:
            low = self.low[-1]
            self.low.append(100 * low // self.percent + 1)
            top = self.low[-1] - 1
            d = largest_difference(top, 100 * top // self.percent, self.percent)
            spare = 1 + d * 8 // 100
            self.blocks.append((d and d + 1 + spare, spare))
        k = bisect_right(self.low, n) - 1
        return [(j, *self.blocks[j]) for j in (k - 1, k) if j >= 0 and self.blocks[j][0]]


def block_keys(s: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys of the sketch blocks of a sorted set of hashes."""
    out = []
    for band, m, spare in bands.schemes(len(s)):
        block = (s >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        parity = np.bitwise_xor.reduceat(s, starts)
        strong = np.diff(np.append(starts, len(s))) > 1
        if m - int(strong.sum()) <= spare:
            at, parity = block[starts][strong], parity[strong]
        else:
            full = np.zeros(m, np.uint64)
            full[block[starts].astype(np.int64)] = parity
            at, parity = np.arange(m, dtype=np.uint64), full
        out.append(mix(parity ^ mix(at + np.uint64((band + 1) << 40))))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _set(text: str | None, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(text), shingle))


def _sketch(s: np.ndarray) -> np.ndarray:
    odd = np.bincount((s & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Rows of three kinds: a document with its size, hash and sketch; a block
    key with the smallest id of a batch; a further id of the batch, with the
    block key and that smallest id in ``info``."""
    def run(batches):
        let_go()
        bands = Bands(percent)
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = b.column(1)
            info, keys, owner, seen = [], [], [], set()
            for i in np.argsort(ids, kind="stable"):
                s = _set(texts[int(i)].as_py(), shingle)
                h = xxhash.xxh3_128_intdigest(s.tobytes())
                info.append({"n": len(s), "h0": _signed(h >> 64), "h1": _signed(h & (1 << 64) - 1), "sketch": _sketch(s)})
                if len(s) and h not in seen:
                    seen.add(h)
                    keys.append(block_keys(s, bands))
                    owner.append(np.full(len(keys[-1]), ids[i]))
            ids = np.sort(ids, kind="stable")
            yield from pieces(_batch(DOCUMENT, mix(ids.view(np.uint64) + np.arange(len(ids), dtype=np.uint64)), ids, pa.array(info, _INFO)))
            if not any(map(len, keys)):
                continue
            key, own = np.concatenate(keys), np.concatenate(owner)
            order = np.argsort(key, kind="stable")
            key, own = key[order], own[order]
            head = np.concatenate(([True], key[1:] != key[:-1]))
            yield from pieces(_batch(BLOCK, key[head], own[head], pa.nulls(int(head.sum()), _INFO)))
            rep, rest = own[head][np.cumsum(head) - 1], ~head
            if rest.any():
                at = pa.StructArray.from_arrays([pa.nulls(int(rest.sum()), pa.int64()), pa.array(key[rest].view(np.int64)), pa.array(rep[rest]),
                                                 pa.nulls(int(rest.sum()), pa.list_(pa.int64()))], fields=list(_INFO))
                yield from pieces(_batch(LOCAL, mix(key[rest] + own[rest].view(np.uint64)), own[rest], at))

    return in_batches(docs, "8m").mapInArrow(run, _DDL)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _batch(kind: int, key: np.ndarray, ids: np.ndarray, info) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int8)), pa.array(key.view(np.int64)), pa.array(ids), info], schema=_ROWS)


def verify(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame | None:
    """Those of ``pairs(a, b)``, which are saved, that are linked by their
    whole texts (a link may come twice); None if none is.  The texts of ``a``
    meet that of ``b`` in a join on ``b`` (which AQE splits where one ``b`` has
    many)."""
    if pairs.isEmpty():
        return None
    pairs = small(pairs.select("a", "b"))
    one = docs.join(pairs, F.col("doc_id") == F.col("a")).select("b", "a", F.col("text").alias("text_a"))
    two = docs.join(pairs, F.col("doc_id") == F.col("b"), "left_semi").select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def run(batches):
        let_go()
        last, kept = None, None
        for x in batches:
            out = []
            for a, b, ta, tb in zip(*x.columns):
                if (b.as_py(), tb) != last:
                    last, kept = (b.as_py(), tb), _set(tb.as_py(), shingle)
                s = _set(ta.as_py(), shingle)
                both = len(np.intersect1d(s, kept, assume_unique=True))
                out.append(both > 0 and 100 * both >= percent * (len(s) + len(kept) - both))
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], ["a", "b"]).filter(pa.array(out, pa.bool_()))

    both = in_batches(one.join(two, "b").select("a", "b", "text_a", "text_b"), SMALL_BATCH)
    linked = saved(both.mapInArrow(run, "a long, b long"), "links")
    return None if linked.isEmpty() else linked


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    named = docs.where("doc_id is not null")
    rows = signatures(named, shingle, percent)
    rows = saved(rows.withColumn("rep", F.min("id").over(Window.partitionBy("kind", "key")))
                 .where(f"kind <> {BLOCK} or id <> rep"), "blocks")
    info = rows.where(f"kind = {DOCUMENT}").select("id", "info.n", "info.h0", "info.h1", "info.sketch")
    met = (rows.where(f"kind = {BLOCK}").select("key", F.col("id").alias("x"), "rep")
           .union(rows.where(f"kind = {LOCAL}").select("info.h0", "id", "info.h1")))
    # equal sets are one class, named by its smallest id
    equal = info.where("n > 0").groupBy("h0", "h1").agg(F.min("id").alias("cls"), F.max("id").alias("last"))
    equal = small(saved(equal.where("last > cls").select("h0", "h1", "cls"), "equal"))
    copies = saved(info.join(equal, ["h0", "h1"]).where("id <> cls").select("id", "cls").distinct(), "copies")
    few = fits(copies)

    def by_class(df, *cols):
        for c in cols:
            cls = copies.select(F.col("id").alias(c), F.col("cls").alias("_cls"))
            df = (df.join(F.broadcast(cls) if few else cls, c, "left")
                  .withColumn(c, F.coalesce("_cls", c)).drop("_cls"))
        return df

    def apart(df):
        """Adds the components of x and rep, and keeps where they differ."""
        for c in ("x", "rep"):
            df = (df.join(part.select(F.col("id").alias(c), F.col("component").alias(f"c_{c}")), c, "left")
                  .withColumn(f"c_{c}", F.coalesce(f"c_{c}", c)))
        return df.where("c_x <> c_rep")

    part = small(saved(components(copies.toDF("a", "b")), "parts"))

    def join_links(pairs) -> bool:
        """Verify pairs and bring the components up to date: those that a link
        joins are the nodes of a smaller graph."""
        nonlocal part
        new = verify(pairs, named, shingle, percent)
        if new is not None:
            ends = apart(new.select(F.col("a").alias("x"), F.col("b").alias("rep")))
            wider = small(saved(components(ends.select(F.col("c_x").alias("a"), F.col("c_rep").alias("b"))), "wider"))
            old = (part.join(wider.select(F.col("id").alias("component"), F.col("component").alias("_wider")), "component", "left")
                   .select("id", F.coalesce("_wider", "component").alias("component")))
            part = small(saved(old.union(wider.join(part, "id", "left_anti")), "parts"))
        return new is not None

    # pairs of classes, the larger id as x
    pairs = by_class(met, "x", "rep") if few else by_class(met.groupBy("x", "rep").agg(F.count("*").alias("shared")), "x", "rep")
    pairs = saved(pairs.where("x <> rep").groupBy(F.greatest("x", "rep").alias("x"), F.least("x", "rep").alias("rep"))
                  .agg((F.count("*") if few else F.sum("shared")).alias("shared")), "met")
    tried = saved(pairs.groupBy(F.col("x").alias("a")).agg(F.max_by("rep", F.struct("shared", -F.col("rep"))).alias("b")), "pairs")
    join_links(tried)

    # an id that stands for several sets has no size and no sketch of its own
    sets = F.struct("h0", "h1")
    once = info.groupBy("id").agg(F.min(sets).alias("least"), F.max(sets).alias("most"), F.min("n").alias("n"), F.min_by("sketch", "n").alias("sketch"))
    plain = small(saved(once.where("least = most").select("id", "n", "sketch"), "plain"), SKETCHES)
    again = apart(pairs).select(F.col("x").alias("a"), F.col("rep").alias("b")).join(small(tried), ["a", "b"], "left_anti")
    for c in ("a", "b"):
        again = again.join(plain.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")), c, "left")
    again = saved(again.where(_fits(percent)).select("a", "b"), "again")
    join_links(again)

    def still_open():
        """Members of the blocks that are in several components, and of them
        those outside the largest component of their block, with the member
        ``one`` of that component."""
        keys = small(saved(apart(by_class(met, "x", "rep").where("x <> rep")).select("key").distinct(), "still"))
        member = by_class(met.join(keys, "key"), "x", "rep")
        member = member.select("key", F.col("x").alias("id")).union(member.select("key", "rep")).distinct()
        member = saved(member.join(part, "id", "left").withColumn("component", F.coalesce("component", "id"))
                       .join(plain, "id", "left"), "member")
        main = (member.groupBy("key", "component").agg(F.count("*").alias("k"), F.min_by("id", F.xxhash64("key", "id")).alias("one"))
                .groupBy("key").agg(F.max_by(F.struct("component", "one"), F.struct("k", "component")).alias("m")).select("key", "m.*"))
        main = small(saved(main.withColumnRenamed("component", "main"), "main"))
        return member, member.join(main, "key").where("component <> main").drop("main")

    tested = tried.union(again)
    while True:
        member, minor = still_open()
        ones = plain.select(F.col("id").alias("id_b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))
        near = _side(minor, "a").withColumnRenamed("one_a", "id_b").join(ones, "id_b", "left").where(_fits(percent))
        near = near.groupBy("id_a").agg(F.min_by("id_b", F.struct(F.coalesce(_distance(), F.lit(0)), "id_b")).alias("id_b"))
        near = saved(_pair(near, "id_a", "id_b").join(small(tested), ["a", "b"], "left_anti"), "near")
        tested = tested.union(near)
        if not join_links(near):
            break
    cross = _side(minor, "a").join(_side(member, "b"), "key").where("component_a <> component_b").where(_fits(percent))
    join_links(saved(_pair(cross, "id_a", "id_b").join(small(tested), ["a", "b"], "left_anti"), "cross"))
    done = info.select("id", "n").join(part, "id", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                                                                  F.coalesce("component", "id").alias("component_id"))
    nameless = signatures(docs.where("doc_id is null").withColumn("doc_id", F.lit(0).cast("long")), shingle, percent)
    return done.union(nameless.where(f"kind = {DOCUMENT}").select(F.lit(None).cast("long"), "info.n", F.lit(None).cast("long")))


def _pair(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()


def _side(df: DataFrame, name: str) -> DataFrame:
    return df.toDF(*(c if c == "key" else f"{c}_{name}" for c in df.columns))


def _distance():
    return F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, x: s + x)


def _fits(percent: int):
    """Size and sketch allow a link; true where one of them is not known."""
    low, high = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    both = (high * percent <= low * 100) & (_distance() <= F.floor((low + high) * (100 - percent) / (100 + percent)))
    return F.coalesce(both, F.col("sketch_a").isNull() | F.col("sketch_b").isNull())
