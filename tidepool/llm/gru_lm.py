"""Scores of a gated recurrent language model with class-factored output.

Training counts every word (and one end for each text) over all documents of
the training fold.  The most frequent words, at most ``HEAD``, are broadcast; all
others are the tail, whose counts stay in a Spark table that is joined by word.

Words fall into classes: the end, the tail, and for the head a number of
topics, each cut into bands of equal frequency mass.  Topics come from the
words that occur in the same texts: the rows of a table of ``TOPIC_WORDS`` by
``MARKERS`` frequent words, clustered; words beyond those take a topic by their
letter pairs.  The probability of a word is that of its class, which the gated
recurrent unit gives from all words before it, times its share within the class
(a softmax of log counts, add-one smoothed in the tail).

The unit is trained by truncated backpropagation in numpy: texts lie one after
another in lanes, windows of ``WINDOW`` steps are unrolled, the state is
carried from window to window and set to zero where a text begins.  Every
training text is used, in ``ROUNDS`` folds: in each, every task goes on from the
shared weights over its share, and the weights are averaged by tokens in Spark.
Scoring runs the same lanes forward, over whole texts.

Defined results: null and empty texts are one end; without training texts the
base score is that of counts of zero and the model knows only the end and the
tail; a null id is not held out and not learned from; repeated rows are scored
each for itself.
"""

from __future__ import annotations

import copy
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.bpe_rank import text_slices
from tidepool.llm.common import in_batches, saved
from tidepool.llm.hashing import words_of
from tidepool.llm.langid import fold

HEAD = 300_000
TOPIC_WORDS, MARKERS, TOPICS, BANDS = 4096, 64, 8, 5
INPUTS = 1024  # words with an input vector of their own
HIDDEN = 24
WINDOW, LANES = 12, 512
ROUNDS = 2
RATE = 0.01
END = ""
END_CLASS, TAIL_CLASS = 0, 1


# ---- counts and vocabulary ------------------------------------------------

def count_words(docs: DataFrame) -> DataFrame:
    """``word, c`` over all texts, the end included; counted in each task
    before the shuffle."""
    def run(batches):
        for b in batches:
            counts: Counter = Counter()
            for t in b.column(0):
                counts.update(words_of(t.as_py()))
            counts[b""] += b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])

    rows = docs.select("text").mapInArrow(run, "word binary, c long")
    return rows.groupBy("word").agg(F.sum("c").alias("c")).where("c > 0")


def most_frequent(counts: DataFrame, head: int) -> tuple[list[bytes], list[int]]:
    """The words of at least the least frequency that at most ``head`` words
    reach (frequencies are cut at eighths of powers of 2, so that the driver
    sees a few hundred counts, and then those words; nothing is sorted)."""
    step = F.floor(F.log2("c") * 8).cast("int")
    left, least = head, None
    for r in sorted(counts.groupBy(step.alias("s")).count().collect(), key=lambda r: -r.s):
        if r["count"] > left:
            break
        left, least = left - r["count"], r.s
    rows = counts.where(step >= least).collect() if least is not None else []
    rows = sorted(rows, key=lambda r: (-r.c, r.word))
    return [bytes(r.word) for r in rows], [r.c for r in rows]


class _Index(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


class Vocabulary:
    """The head: index, counts and class of each of its words."""

    def __init__(self, words: list[bytes], counts: list[int], total: int, distinct: int, topic: np.ndarray | None = None):
        self.words = [b"", *(w for w in words if w)]
        self._given = words, counts, total, distinct
        by_word = dict(zip(words, counts))
        c = np.array([by_word.get(w, 0) for w in self.words], np.float64)
        self.index = _Index((w, i) for i, w in enumerate(self.words))
        self.total, self.distinct = total, distinct
        self.base = np.log10((c + 1) / (total + distinct + 1))
        self.known = c > 0
        #: denominator of the smoothed shares within the tail
        self.tail_mass = (total - c.sum()) + max(0, distinct - int(self.known.sum())) + 1
        topic = np.zeros(len(self.words), np.int64) if topic is None else topic
        self.cls = np.zeros(len(self.words) + 1, np.int64)
        self.cls[-1] = TAIL_CLASS  # index -1
        for t in range(TOPICS):
            mine = np.flatnonzero((topic == t) & (np.arange(len(topic)) > 0))
            if len(mine):
                mass = np.cumsum(c[mine]) - c[mine]
                self.cls[mine] = 2 + t * BANDS + np.minimum(BANDS - 1, (mass * BANDS / c[mine].sum()).astype(np.int64))
        self.classes = 2 + TOPICS * BANDS
        mass = np.bincount(self.cls[:-1], c, self.classes)
        mass[TAIL_CLASS] = self.tail_mass
        self.share = np.zeros(len(self.words) + 1)
        self.share[1:-1] = np.log10(np.maximum(c[1:], 1) / np.maximum(mass[self.cls[1:-1]], 1))
        self.prior = np.log((mass + 1) / (mass + 1).sum()).astype(np.float32)
        # input rows: the first words, then a row a class, then the start
        self.inputs = INPUTS + self.classes + 1
        self.input = np.append(np.minimum(np.arange(len(self.words)), INPUTS), 0)
        far = self.input >= INPUTS
        far[-1] = True
        self.input[far] = INPUTS + self.cls[far]

    def with_topics(self, topic: np.ndarray) -> Vocabulary:
        return Vocabulary(*self._given, topic)

    def without_words(self) -> Vocabulary:
        """What tasks over encoded texts need of it."""
        out = copy.copy(self)
        out.words = out.index = out._given = None
        return out

    def indexes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
        """Word indexes of all texts in a row (-1 in the tail), an end after
        each; the tokens of each text; the words of each."""
        words = [words_of(t) for t in texts]
        n = np.array([len(w) + 1 for w in words])
        out = np.zeros(int(n.sum()), np.int64)
        at, get = 0, self.index.__getitem__
        for w in words:
            out[at:at + len(w)] = np.fromiter(map(get, w), np.int64, len(w))
            at += len(w) + 1
        return out, n, words


def encoded(docs: DataFrame, broad) -> DataFrame:
    """``docs(doc_id, text)``, split and looked up once for all later passes: a
    row a text (numbered in ``row``) with its ``n`` tokens, the sums of the base
    over its head and its word indexes as int32 in ``ids``; and a row for each
    distinct tail ``word`` of it, which stands there ``n`` times."""
    names = ["row", "doc_id", "n", "word", "known", "base", "ids"]

    def run(batches):
        vocab = broad.value
        known, base = np.append(vocab.known, False).astype(np.int64), np.append(vocab.base, 0)
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            for at, part in text_slices(b.column(1), SLICE):
                ids, n, words = vocab.indexes(part)
                first = np.cumsum(n) - n
                rows = row + np.arange(len(n))
                row += len(n)
                data = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.append(first, len(ids)).astype(np.int32) * np.int32(4)),
                                                                   pa.py_buffer(ids.astype(np.int32))])
                yield pa.RecordBatch.from_arrays([pa.array(rows), b.column(0).slice(at, len(part)), pa.array(n.astype(np.int64)), pa.nulls(len(n), pa.binary()),
                                                  pa.array(np.add.reduceat(known[ids], first)), pa.array(np.add.reduceat(base[ids], first)), data], names)
                tail = [(r, w, k) for r, own, f, m in zip(rows.tolist(), words, first, n)
                        for w, k in Counter(own[j] for j in np.flatnonzero(ids[f:f + m] < 0).tolist()).items()]
                if tail:
                    r, w, k = zip(*tail)
                    yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.nulls(len(r), pa.int64()), pa.array(k, pa.int64()), pa.array(w, pa.binary()),
                                                      pa.array(np.zeros(len(r), np.int64)), pa.array(np.zeros(len(r))), pa.nulls(len(r), pa.binary())], names)

    return saved(docs.select("doc_id", "text").mapInArrow(run, "row long, doc_id long, n long, word binary, known long, base double, ids binary"), "encoded")


def id_slices(column, tokens: int, most: int | None = None):
    """``(at, ids, n)`` of slices of a column of encoded texts, of about
    ``tokens`` tokens and at most ``most`` texts."""
    n = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]).astype(np.int64) // 4
    at = 0
    while at < len(n):
        end = at + max(1, int(np.searchsorted(np.cumsum(n[at:]), tokens, "right")))
        end = min(end, len(n), at + (most or len(n)))
        yield at, np.frombuffer(b"".join(x.as_py() for x in column.slice(at, end - at)), np.int32).astype(np.int64), n[at:end]
        at = end


def shared_texts(coded: DataFrame, vocab: Vocabulary) -> np.ndarray:
    """How often each of the first ``TOPIC_WORDS`` words stands in a text with
    each of the first ``MARKERS`` words (a table of fixed size)."""
    rows, cols = min(TOPIC_WORDS, len(vocab.words)), min(MARKERS, len(vocab.words))

    def run(batches):
        total = np.zeros((rows, cols))
        for b in batches:
            for _, ids, n in id_slices(b.column(0), 1 << 18, 500):
                doc = np.repeat(np.arange(len(n)), n)
                near = (ids > 0) & (ids < rows)
                counts = np.bincount(doc[near] * rows + ids[near], minlength=len(n) * rows).reshape(len(n), rows).astype(np.float32)
                total += counts.T @ (counts[:, :cols] / np.maximum(counts[:, :cols].sum(1, keepdims=True), 1))
        yield pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int64()), *(pa.array(total[:, k]) for k in range(cols))],
                                         ["w", *(f"m{k}" for k in range(cols))])

    ddl = ", ".join(["w long", *(f"m{k} double" for k in range(cols))])
    out = np.zeros((rows, cols))
    for r in coded.select("ids").mapInArrow(run, ddl).groupBy("w").agg(*(F.sum(f"m{k}").alias(f"m{k}") for k in range(cols))).collect():
        out[r[0]] = r[1:]
    return out


def topics_of(vocab: Vocabulary, together: np.ndarray, seed: int = 9) -> np.ndarray:
    """A topic for each word of the head: k-means on the rows of ``together``
    (square roots of shares), then letter pairs for the other words."""
    topic = np.zeros(len(vocab.words), np.int64)
    x = together / np.maximum(together.sum(1, keepdims=True), 1e-9)
    x = np.sqrt(np.maximum(x, 0))
    used = np.flatnonzero(together.sum(1) > 0)
    if len(used) <= TOPICS:
        topic[used] = np.arange(len(used))
        return topic
    y, rng = x[used], np.random.default_rng(seed)
    centre = [y[0]]
    while len(centre) < TOPICS:  # the farthest row from those chosen
        centre.append(y[np.argmin((y @ np.array(centre).T).max(1))])
    centre = np.array(centre)
    for _ in range(25):
        near = (y @ centre.T).argmax(1)
        for t in range(TOPICS):
            centre[t] = y[near == t].mean(0) if (near == t).any() else y[rng.integers(len(y))]
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
    topic[used] = near
    pairs = np.ones((1 << 12, TOPICS))

    def slots(w: bytes) -> list[int]:
        w = b"^" + w + b"$"
        return [(a * 61 + b * 7919) & 4095 for a, b in zip(w, w[1:])]

    for i, t in zip(used.tolist(), near.tolist()):
        for s in slots(vocab.words[i]):
            pairs[s, t] += 1
    weight = np.log(pairs / pairs.sum(0))
    for i in range(len(together), len(vocab.words)):
        topic[i] = weight[slots(vocab.words[i])].sum(0).argmax()
    return topic


# ---- the recurrent unit ---------------------------------------------------

def first_weights(vocab: Vocabulary, seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    small = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
    return {"G": small(vocab.inputs, 3 * HIDDEN), "U": small(HIDDEN, 3 * HIDDEN), "W": small(HIDDEN, vocab.classes), "b": vocab.prior.copy()}


def _sigmoid(x):
    """In place."""
    np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Lanes:
    """Texts of a slice, dealt over lanes of nearly equal length."""

    def __init__(self, vocab: Vocabulary, ids: np.ndarray, n: np.ndarray):
        first = np.cumsum(n) - n
        self.target = vocab.cls[ids]
        self.fresh = np.zeros(len(ids), bool)
        self.fresh[first] = True
        self.input = np.concatenate(([0], vocab.input[ids[:-1]]))
        self.input[first] = vocab.inputs - 1
        lanes = min(LANES, len(n))
        lane = first * lanes // len(ids)
        head = np.concatenate(([True], lane[1:] != lane[:-1]))
        self.start = first[head]
        self.end = np.append(self.start[1:], len(ids))
        order = np.argsort(self.start - self.end, kind="stable")
        self.start, self.end = self.start[order], self.end[order]

    def windows(self):
        """``(at, mask)`` of each window: places of shape (steps, lanes)."""
        at = 0
        while True:
            live = int((self.end - self.start > at).sum())
            if not live:
                return
            steps = min(WINDOW, int((self.end - self.start).max()) - at)
            place = self.start[None, :live] + at + np.arange(steps)[:, None]
            mask = place < self.end[None, :live]
            yield np.where(mask, place, self.start[None, :live]), mask
            at += steps


class Unit:
    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: v.astype(np.float32) for k, v in weights.items()}
        self.m = {k: np.zeros_like(v) for k, v in self.w.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.w.items()}
        self.t = 0

    def bound(self) -> float:
        """What no logit exceeds."""
        return float((np.abs(self.w["W"]).sum(0) + np.abs(self.w["b"])).max())

    def forward(self, lanes: Lanes, place: np.ndarray, h: np.ndarray, keep: bool):
        g, u, n = self.w["G"], self.w["U"], HIDDEN
        x = g.take(lanes.input.take(place), 0)
        fresh = lanes.fresh.take(place)
        states = np.empty((len(place), place.shape[1], n), np.float32)
        tape = []
        for t in range(len(place)):
            if fresh[t].any():
                h = np.where(fresh[t][:, None], np.float32(0), h)
            a = h @ u
            # each gate by itself: whole arrays take half the time of slices
            z, r, s = _sigmoid(x[t, :, :n] + a[:, :n]), _sigmoid(x[t, :, n:2 * n] + a[:, n:2 * n]), a[:, 2 * n:].copy()
            c = r * s
            c += x[t, :, 2 * n:]
            np.tanh(c, out=c)
            if keep:
                tape.append((h, z, r, c, s))
            h = np.subtract(h, c, out=states[t])
            h *= z
            h += c
        logits = states.reshape(-1, n) @ self.w["W"]
        logits += self.w["b"]
        if self.bound() > 60:  # states lie within -1 and 1: otherwise no exponential overflows
            logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        norm = p.sum(1, keepdims=True)
        return h, states, logits, p, norm, fresh, tape

    def score(self, lanes: Lanes) -> np.ndarray:
        """log10 of the class probability at each place."""
        out = np.zeros(len(lanes.target))
        h = np.zeros((len(lanes.start), HIDDEN), np.float32)
        for place, mask in lanes.windows():
            h, _, logits, _, norm, _, _ = self.forward(lanes, place, h[:place.shape[1]], False)
            own = logits.ravel().take(lanes.target.take(place).ravel() + np.arange(0, logits.size, logits.shape[1])) - np.log(norm[:, 0])
            out[place[mask]] = own.reshape(place.shape)[mask] / np.log(10)
        return out

    def train(self, lanes: Lanes) -> None:
        h = np.zeros((len(lanes.start), HIDDEN), np.float32)
        for place, mask in lanes.windows():
            h = self._learn(lanes, place, mask, h[:place.shape[1]])

    def _learn(self, lanes: Lanes, place, mask, h):
        n, w = HIDDEN, self.w
        h, states, _, p, norm, fresh, tape = self.forward(lanes, place, h, True)
        d, live = p, int(mask.sum())
        d /= norm
        d.ravel()[lanes.target.take(place).ravel() + np.arange(0, d.size, d.shape[1])] -= 1
        d *= np.float32(1 / live) if live == mask.size else (mask.ravel()[:, None] / max(1, live)).astype(np.float32)
        grad = {"W": states.reshape(-1, n).T @ d, "b": d.sum(0)}
        out = (d @ w["W"].T).reshape(states.shape)
        dx = np.empty((*place.shape, 3 * n), np.float32)
        back, ut = np.zeros_like(h), w["U"].T.copy()
        past, dn = np.empty((*place.shape, n), np.float32), np.empty((*place.shape, n), np.float32)
        for t in range(len(place) - 1, -1, -1):
            prev, z, r, c, a = tape[t]
            dh, da = np.add(out[t], back, out=back), dx[t]
            rest = 1 - z
            dc = dn[t]
            np.multiply(dh, rest, out=dc)
            slope = c * c
            dc *= np.subtract(1, slope, out=slope)
            dr = dc * r
            da[:, 2 * n:] = dr
            dr *= a
            np.multiply(dr, np.subtract(1, r, out=r), out=da[:, n:2 * n])
            np.subtract(prev, c, out=c)
            c *= dh
            c *= z
            np.multiply(c, rest, out=da[:, :n])
            past[t] = prev
            dh *= z
            back = np.add(dh, da @ ut, out=dh)
            if fresh[t].any():
                back[fresh[t]] = 0
        grad["U"] = past.reshape(-1, n).T @ dx.reshape(-1, 3 * n)
        dx[:, :, 2 * n:] = dn
        rows = lanes.input.take(place).ravel()
        order = np.argsort(rows.astype(np.uint16) if len(w["G"]) <= 1 << 16 else rows, kind="stable")  # of 16 bits by radix
        used = rows[order]
        head = np.flatnonzero(np.concatenate(([True], used[1:] != used[:-1])))
        grad["G"] = np.zeros_like(w["G"])
        grad["G"][used[head]] = np.add.reduceat(dx.reshape(-1, 3 * n).take(order, 0), head)
        self._step(grad)
        return h

    def _step(self, grad) -> None:
        """Adam with a bound on the length of the gradient."""
        self.t += 1
        length = float(np.sqrt(sum((g * g).sum() for g in grad.values())))
        cut, root = min(1.0, 1.0 / max(length, 1e-9)), float(np.sqrt(1 - 0.999 ** self.t))
        for k, g in grad.items():
            m, v = self.m[k], self.v[k]
            m *= 0.9
            m += (0.1 * cut) * g
            v *= 0.999
            g *= g
            g *= 0.001 * cut * cut
            v += g
            step = np.sqrt(v)
            step += 1e-8 * root
            np.divide(m, step, out=step)
            step *= RATE * root / (1 - 0.9 ** self.t)
            self.w[k] -= step


SLICE = 8 << 20  # bytes of text that are unpacked at a time
TOKENS = 1 << 21  # tokens whose lanes are in memory at a time


def train_round(coded: DataFrame, broad, weights: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The mean of the weights that each task reaches over its texts, weighted
    by their tokens; summed in Spark, so the driver gets one set."""
    shapes = {k: v.shape for k, v in weights.items()}
    size = sum(v.size for v in weights.values())

    def run(batches):
        vocab, unit, tokens = broad.value, Unit(weights), 0
        for b in batches:
            for _, ids, n in id_slices(b.column(0), TOKENS):
                unit.train(Lanes(vocab, ids, n))
                tokens += len(ids)
        if tokens:
            flat = np.concatenate([unit.w[k].ravel() for k in shapes]).astype(np.float64) * tokens
            yield pa.RecordBatch.from_arrays([pa.array(range(size + 1), pa.int32()), pa.array(np.append(flat, tokens))], ["i", "x"])

    flat = np.zeros(size + 1)
    for r in coded.select("ids").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        flat[r.i] = r.x
    if not flat[-1]:
        return weights
    out, at = {}, 0
    for k, s in shapes.items():
        n = int(np.prod(s))
        out[k] = (flat[at:at + n] / flat[-1]).reshape(s).astype(np.float32)
        at += n
    return out


def counted(train: DataFrame, head: int) -> tuple[DataFrame, Vocabulary]:
    """The counts of the texts of ``train``, and the head without topics."""
    counts = saved(count_words(train), "counts")
    total, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    return counts, Vocabulary(*most_frequent(counts, head), total or 0, distinct)


def fit(coded: DataFrame, vocab: Vocabulary, rounds: int) -> tuple[Vocabulary, dict[str, np.ndarray]]:
    """``(vocabulary with topics, weights)`` by the texts of ``coded``."""
    coded, sc = coded.where("ids is not null"), coded.sparkSession.sparkContext
    vocab = vocab.with_topics(topics_of(vocab, shared_texts(coded, vocab)))
    broad, weights = sc.broadcast(vocab.without_words()), first_weights(vocab)
    for k in range(rounds):
        weights = train_round(coded.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == k), broad, weights)
    return vocab, weights


def learn(train: DataFrame, head: int = HEAD, rounds: int = ROUNDS):
    """``(counts, vocabulary, weights)`` of the texts in ``train(doc_id,
    text)``."""
    sc = train.sparkSession.sparkContext
    counts, vocab = counted(train, head)
    vocab, weights = fit(encoded(train, sc.broadcast(vocab)), vocab, rounds)
    return counts, sc.broadcast(vocab), weights


def score(docs: DataFrame, counts: DataFrame, broad, weights: dict[str, np.ndarray]) -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` of each row of
    ``docs(doc_id, text)``."""
    return score_encoded(encoded(docs, broad), counts, broad.value, weights)


def score_encoded(coded: DataFrame, counts: DataFrame, vocab: Vocabulary, weights: dict[str, np.ndarray]) -> DataFrame:
    """:func:`score` of texts that were encoded before."""
    broad = coded.sparkSession.sparkContext.broadcast(vocab.without_words())

    def run(batches):
        vocab, unit = broad.value, Unit(weights)
        for b in batches:
            for at, ids, n in id_slices(b.column(5), TOKENS):
                p = np.add.reduceat(unit.score(Lanes(vocab, ids, n)) + vocab.share[ids], np.cumsum(n) - n)
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(at, len(n)) for k in range(5)), pa.array(p)], names)

    names = ["row", "doc_id", "n", "known", "base", "score"]
    rows = (coded.where("ids is not null").select("row", "doc_id", "n", "known", "base", "ids")
            .mapInArrow(run, "row long, doc_id long, n long, known long, base double, score double"))
    rows = saved(rows, "scored")
    c = F.coalesce(F.col("c"), F.lit(0))
    tail = (coded.where("word is not null").select("row", "n", "word").join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("tail_known"),
        F.sum(F.col("n") * F.log10((c + 1) / F.lit(float(vocab.total + vocab.distinct + 1)))).alias("tail_base"),
        F.sum(F.col("n") * F.log10((c + 1) / F.lit(float(vocab.tail_mass)))).alias("tail_score")))
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    return rows.join(tail, "row", "left").select(
        "doc_id", F.col("n").alias("n_tokens"), (F.col("known") + zero("tail_known")).alias("n_known"),
        (F.col("base") + zero("tail_base")).alias("base_score"), (F.col("score") + zero("tail_score")).alias("score"))


def language_model_scores(docs: DataFrame, folds: int = 7, held: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Learn from the documents of which crc32 of the id modulo ``folds`` is
    not ``held``, and score all."""
    docs = in_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    train = fold(F.col("doc_id"), folds) != held
    counts, vocab = counted(docs.where(train), HEAD)
    coded = encoded(docs, docs.sparkSession.sparkContext.broadcast(vocab))
    vocab, weights = fit(coded.where(train), vocab, ROUNDS)
    out = score_encoded(coded, counts, vocab, weights)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "n_tokens", "n_known",
                      F.lit(vocab.total).cast("long").alias("train_tokens"), "base_score", "score")
