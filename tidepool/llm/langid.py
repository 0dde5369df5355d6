"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  The vector of a three-letter
n-gram is the elementwise product of its letters' vectors, each rotated by its
place.  A text's vector is the sum of its n-grams' vectors; a language's
prototype is the sum over its training texts; a text gets the language whose
prototype has the greatest cosine.

An n-gram is a letter with what stands before and after it, where anything
that is not a letter counts as one boundary sign.  Letters beyond U+00FF share
the 255 letter vectors by a hash of their code point.

Only whole texts are used, in pieces of at most ``PIECE`` characters that are
cut between words (a word longer than that is cut).  Training adds up vectors
of whole numbers in each task; one row per language and dimension is shuffled.

Defined results: ``und`` with score 0 for a null text, one without a letter,
and when there is nothing to learn from; equal cosines go to the language that
sorts first; repeated rows are predicted alike; rows with a null id are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.bpe_rank import text_slices
from tidepool.llm.common import SMALL_BATCH, in_batches, let_go

DIMENSIONS = 1024
SEED = 20
UNKNOWN = "und"
PIECE = 1 << 18
#: n-gram vectors that a worker holds at a time
HELD = 16_384
#: n-gram vectors that are made floats at a time (a byte each is held)
CHUNK = 1024
_NONE = np.uint16(65_535)


def _letter_slots() -> np.ndarray:
    slots = np.zeros(1 << 16, np.uint8)
    for cp in range(1 << 16):
        if chr(cp).isalpha():
            slots[cp] = _slot(cp)
    return slots


def _slot(cp: int) -> int:
    return cp if cp < 256 else 1 + (cp * 0x9E3779B1 >> 8) % 255


class Profiles:
    """Makes text vectors."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        letters = np.random.default_rng(seed).integers(0, 2, (256, dimensions), np.int8) * 2 - 1
        self.letters = [np.roll(letters, k, axis=1) for k in (2, 1, 0)]
        self.slots = _letter_slots()
        self.place = np.full(1 << 24, _NONE, np.uint16)
        self.vectors = np.zeros((HELD, dimensions), np.int8)
        self.held = np.zeros(0, np.int64)

    def _hold(self, grams: np.ndarray) -> None:
        at = len(self.held)
        self.held = np.concatenate((self.held, grams))
        self.place[grams] = np.arange(at, len(self.held), dtype=np.uint16)
        a, b, c = self.letters
        self.vectors[at:len(self.held)] = a[grams >> 16] * b[grams >> 8 & 255] * c[grams & 255]

    def _drop(self) -> None:
        self.place[self.held] = _NONE
        self.held = self.held[:0]

    def _slots_of(self, text: str) -> np.ndarray:
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        slots = self.slots[np.minimum(cp, 0xFFFF)]
        for far in np.unique(cp[cp > 0xFFFF]).tolist():
            slots[cp == far] = _slot(far) if chr(far).isalpha() else 0
        return slots

    def add(self, out: np.ndarray, pieces: list[tuple[int, str]]) -> None:
        """Add each piece's vector to its row of ``out``."""
        rows = sorted({r for r, _ in pieces})
        text = " ".join(t.lower() for _, t in pieces)
        slots = np.concatenate(([0], self._slots_of(text), [0])).astype(np.int64)
        lengths = np.array([len(t.lower()) + 1 for _, t in pieces])
        row = np.repeat(np.searchsorted(rows, [r for r, _ in pieces]), lengths)[:len(slots) - 2]
        mid = np.flatnonzero(slots[1:-1])
        gram = slots[mid] << 16 | slots[mid + 1] << 8 | slots[mid + 2]
        row = row[mid]
        new = gram[self.place[gram] == _NONE]
        if len(new):
            new = np.unique(new)
            if len(self.held) + len(new) > HELD:
                self._drop()
                new = np.unique(gram)
        if len(new) <= HELD:
            self._hold(new)
            self._bundle(out, rows, row, gram)
        else:
            for at in range(0, len(new), HELD):
                self._hold(new[at:at + HELD])
                here = self.place[gram] != _NONE
                self._bundle(out, rows, row[here], gram[here])
                self._drop()

    def _bundle(self, out, rows, row, gram) -> None:
        n = len(self.held)
        counts = np.bincount(row * n + self.place[gram], minlength=len(rows) * n)
        counts = counts.reshape(len(rows), n).astype(np.float32)
        for at in range(0, n, CHUNK):  # whole numbers: the order of the sums does not matter
            out[rows] += counts[:, at:at + CHUNK] @ self.vectors[at:min(n, at + CHUNK)].astype(np.float32)

    def vectors_of(self, texts: list[tuple[int, str]], n: int) -> np.ndarray:
        """``n`` rows of text vectors; ``texts`` are (row, text)."""
        out = np.zeros((n, self.vectors.shape[1]))
        held, size = [], 0
        for row, text in texts:
            for piece in pieces_of(text):
                held.append((row, piece))
                size += len(piece)
                if size >= PIECE or len(held) >= 64:
                    self.add(out, held)
                    held, size = [], 0
        if held:
            self.add(out, held)
        return out


def pieces_of(text: str):
    """``text`` in pieces that end between words."""
    at = 0
    while len(text) - at > PIECE:
        end = at + PIECE
        while end > at and text[end].isalpha():
            end -= 1
        end = end if end > at else at + PIECE
        yield text[at:end]
        at = end
    yield text[at:]


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS, seed: int = SEED) -> dict[str, np.ndarray]:
    """A prototype for each language of ``labelled`` (rows with a null text
    or language are ignored).  What reaches the driver is one vector for each
    language."""
    def run(batches):
        let_go()
        p, total = Profiles(dimensions, seed), {}
        for b in batches:
            for at, texts in text_slices(b.column(0)):
                langs = b.column(1).slice(at, len(texts)).to_pylist()
                names = sorted(set(langs))
                made = p.vectors_of(list(zip(map(names.index, langs), texts)), len(names))
                for name, v in zip(names, made):
                    total[name] = total.get(name, 0) + v
        for name, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dimensions), pa.array(range(dimensions), pa.int32()), pa.array(v)],
                                             ["lang", "dimension", "value"])

    rows = (in_batches(labelled, SMALL_BATCH).where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text), F.col(lang).cast("string"))
            .mapInArrow(run, "lang string, dimension int, value double")
            .groupBy("lang", "dimension").agg(F.sum("value").alias("value")).collect())
    out: dict[str, np.ndarray] = {}
    for r in rows:
        out.setdefault(r.lang, np.zeros(dimensions))[r.dimension] = r.value
    return {name: v for name, v in sorted(out.items()) if v.any()}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", dimensions: int = DIMENSIONS, seed: int = SEED,
            lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """All columns of ``docs`` with the language and the score (the cosine, 0
    if below); a map over the documents.  ``docs`` may not have columns of the
    two names yet."""
    for c in (lang_out, score_out):
        if c in docs.columns:
            raise ValueError(f"the table has a column {c!r}; name another for the result")
    names = list(prototypes)
    unit = np.array([v / np.linalg.norm(v) for v in prototypes.values()]).reshape(len(names), dimensions)
    columns, at = docs.columns, docs.columns.index(text)

    def run(batches):
        let_go()
        p = Profiles(dimensions, seed)
        for b in batches:
            for start, texts in text_slices(b.column(at), rows=256):
                made = p.vectors_of([(i, t) for i, t in enumerate(texts) if t], len(texts))
                size = np.linalg.norm(made, axis=1)
                cos = (made @ unit.T) / np.where(size, size, 1)[:, None] if names else np.zeros((len(texts), 1))
                best = cos.argmax(axis=1)
                known = [bool(s) and bool(names) for s in size]
                yield pa.RecordBatch.from_arrays([
                    *b.slice(start, len(texts)).columns, pa.array([names[k] if ok else UNKNOWN for k, ok in zip(best, known)], pa.string()),
                    pa.array([float(min(1.0, max(0.0, c[k]))) if ok else 0.0 for c, k, ok in zip(cos, best, known)], pa.float64())],
                    names=[*columns, lang_out, score_out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return in_batches(docs, SMALL_BATCH).mapInArrow(run, f"{fields}, `{lang_out}` string, `{score_out}` double")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds
