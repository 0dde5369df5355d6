"""Personal data by patterns, and terms that disclose it by co-occurrence.

Patterns find e-mail addresses, IP addresses, card and phone numbers; each
different value is a protected entity.  A term that stands near an entity may
reveal it even where the value is taken out.  How strongly is estimated from
the whole corpus of N documents::

    IC(c)    = log2(N / n(c))                    information of the entity
    PMI(c;t) = log2(N n(c,t) / (n(c) n(t)))      what the term tells of it
    disclosure = PMI(c;t) / IC(c)                1: the term gives it away

with n(c), n(t) the documents that hold the entity and the term anywhere and
n(c,t) those that hold the term within ``WINDOW`` terms of the entity.  A pair counts
only if it was seen in ``CONTEXTS`` different surroundings (told apart by the
least hash of their terms, so that copies are one).  In a document, the terms
whose disclosure of one of its entities reaches the threshold are generalised
to a prefix if that is below the threshold, and removed otherwise.

One scan finds entities and their surroundings; a second counts the terms that
can still matter.  The set of these goes to the tasks as a filter of fixed size
(what it lets through by chance is taken out by the join that follows).  Pairs
are counted by partial aggregation, so that no entity or term is hot.  Entities
and terms are compared by 64-bit hashes.

Defined results: null and empty texts have no spans; repeated and null ids are
rows like others, each a document; an entity in all documents has no
information and is revealed by nothing; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.bpe_rank import text_slices
from tidepool.llm.common import in_batches, saved, small

#: Kinds of the patterns, in their order.
KINDS = ("email", "ip", "card", "phone")
WINDOW = 10
CONTEXTS = 3
THRESHOLD = 0.75
#: Bits of the filter of terms that are counted.
FILTER = 1 << 23

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: a match always starts where a run of digits does, as the rest of a run leads to the same
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W_]+")

SPAN = "struct<kind: string, start: int, end: int>"
_FOUND = f"doc_id long, spans array<{SPAN}>, entities array<long>, pairs array<struct<c: long, t: long, sign: long, once: int>>, text string"
_RESULT = f"doc_id long, spans array<{SPAN}>, sanitised string"


def _emails(text: str):
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` by kind as listed, then start."""
    out = [("email", s, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) < 4 and int(p or "0") <= 255 for part in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s.encode()) - (1 << 63)


def entity(kind: str, value: str) -> int:
    """The hash of a value: of its digits where only they matter."""
    return _hash(f"{kind}:{value.lower() if kind == 'email' else value if kind == 'ip' else _digits(value)}")


def general(term: str) -> str:
    """The more general form of a term: its first half, and a star."""
    return term[:max(1, len(term) // 2)] + "*"


def _terms(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """``(term, start, end)`` outside the spans, in lower case."""
    out, at = [], 0
    for s, e in [*sorted((s, e) for _, s, e in spans), (len(text), len(text))]:
        out += [(m.group().lower(), *m.span()) for m in _TERM.finditer(text, at, s)] if s > at else []
        at = max(at, e)
    return out


def surroundings(text: str, spans: list[tuple[str, int, int]]) -> tuple[list[int], list[tuple[int, int, int, int]]]:
    """The different entities of a text, and ``(entity, term, sign, once)``:
    each term near an entity with the sign of the surroundings; ``once`` is 1
    for the first row of a pair, so that its sum counts documents."""
    terms = _terms(text, spans)
    keys = [(_hash(t), _hash(general(t))) for t, _, _ in terms]
    starts = np.array([s for _, s, _ in terms], np.int64)
    entities, seen, rows = {}, set(), {}
    for kind, s, e in spans:
        c = entity(kind, text[s:e])
        entities[c] = None
        lo, hi = np.searchsorted(starts, s), np.searchsorted(starts, e)
        near = keys[max(0, lo - WINDOW):lo] + keys[hi:hi + WINDOW]
        if near:
            sign = min(k for k, _ in near)
            for t in {t for pair in near for t in pair}:
                if (c, t, sign) not in rows:
                    rows[c, t, sign] = int((c, t) not in seen)
                    seen.add((c, t))
    return list(entities), [(*k, once) for k, once in rows.items()]


def _find(batches):
    """Spans, entities and surroundings of each row; the text only where it
    holds an entity."""
    for b in batches:
        for at, texts in text_slices(b.column(1)):
            spans, entities, pairs, kept = [], [], [], []
            for t in texts:
                found = base_spans(t) if t else []
                c, p = surroundings(t, found) if found else ([], [])
                spans.append([dict(zip(("kind", "start", "end"), s)) for s in found])
                entities.append(c)
                pairs.append([dict(zip(("c", "t", "sign", "once"), x)) for x in p])
                kept.append(t if found else None)
            span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
            pair = pa.struct([("c", pa.int64()), ("t", pa.int64()), ("sign", pa.int64()), ("once", pa.int32())])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(at, len(texts)), pa.array(spans, pa.list_(span)), pa.array(entities, pa.list_(pa.int64())),
                 pa.array(pairs, pa.list_(pair)), pa.array(kept, pa.string())], ["doc_id", "spans", "entities", "pairs", "text"])


def _passing(words: set[str], bits: np.ndarray) -> dict[str, tuple[int, ...]]:
    """The hashes of those forms of each word that pass the filter; only
    words that have one."""
    low = [(w, w.lower()) for w in words]
    forms = [[_hash(t) for _, t in low], [_hash(general(t)) for _, t in low]]
    out: dict[str, tuple[int, ...]] = {}
    for each in forms:
        place = np.array(each, np.int64) & (FILTER - 1)
        hit = np.flatnonzero(bits[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1))
        for k in hit.tolist():
            out[low[k][0]] = (*out.get(low[k][0], ()), each[k])
    return out


def document_counts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``t, n``: how many of ``texts(text)`` hold each form ``wanted(t)``, and
    some others that pass the filter by chance.  Words are hashed once for each
    slice of texts, and counted within a task's batches first."""
    place = F.pmod("t", F.lit(FILTER))
    words = wanted.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(t & 63 AS INT))")).alias("b")).toPandas()
    bits = np.zeros(FILTER >> 6, np.uint64)
    bits[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).view(np.uint64)
    sent = texts.sparkSession.sparkContext.broadcast(bits)

    def count(batches):
        for b in batches:
            n: dict[int, int] = {}
            for _, part in text_slices(b.column(0)):
                own = [set(_TERM.findall(t)) for t in part if t]
                forms = _passing(set().union(*own), sent.value)
                for here in own:
                    for h in {h for w in here & forms.keys() for h in forms[w]}:
                        n[h] = n.get(h, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.int64()), pa.array(n.values(), pa.int64())], ["t", "n"])

    return in_batches(texts).mapInArrow(count, "t long, n long").groupBy("t").agg(F.sum("n").alias("n"))


def disclosure(n_c: Column, n_t: Column, n_both: Column, total: int) -> Column:
    """PMI over IC; 0 where the entity has no information."""
    n = F.lit(float(total))
    return F.when(n_c < n, F.log2(n * n_both / n_c / n_t) / F.log2(n / n_c)).otherwise(0.0)


def _apply(batches):
    """Spans and sanitised texts of rows with the terms that disclose."""
    for b in batches:
        spans, texts = [], []
        for base, text, terms in zip(b.column(1), b.column(2), b.column(3)):
            base = [(x["kind"], x["start"], x["end"]) for x in base.as_py()]
            text = text.as_py()
            if text is None:
                spans.append([])
                texts.append(None)
                continue
            gone = set(terms.as_py() or [])
            found = [("term", s, e) for t, s, e in _terms(text, base) if _hash(t) in gone] if gone else []
            spans.append([dict(zip(("kind", "start", "end"), s)) for s in [*base, *found]])
            out, at = [], 0
            for kind, s, e in sorted([*base, *found], key=lambda x: (x[1], -x[2])):
                if s >= at:
                    form = general(text[s:e].lower())
                    out += [text[at:s], f"[{kind.upper()}]" if kind != "term" else form if _hash(form) not in gone else ""]
                at = max(at, e)
            texts.append("".join([*out, text[at:]]))
        span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.list_(span)), pa.array(texts, pa.string())], ["doc_id", "spans", "sanitised"])


def revealing(found: DataFrame, texts: DataFrame, total: int, contexts: int = CONTEXTS, threshold: float = THRESHOLD) -> DataFrame:
    """``c, t, disclosure`` of the pairs that reach the threshold."""
    pairs = found.select(F.explode("pairs").alias("p")).select("p.*")
    pairs = pairs.groupBy("c", "t", "sign").agg(F.sum("once").alias("n")).groupBy("c", "t").agg(F.sum("n").alias("n_both"), F.count(F.lit(1)).alias("signs"))
    pairs = saved(pairs.where(F.col("signs") >= contexts).select("c", "t", "n_both"), "pairs")
    wanted = saved(pairs.select("t").distinct(), "terms")
    n_t = saved(document_counts(texts, wanted), "counts").join(wanted, "t", "left_semi").withColumnRenamed("n", "n_t")
    n_c = found.select(F.explode("entities").alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n_c"))
    known = pairs.join(n_t, "t").join(n_c, "c")
    n_t = F.greatest("n_t", "n_both")  # next to a value a term may be cut off from a longer word
    known = known.select("c", "t", disclosure(F.col("n_c"), n_t, F.col("n_both"), total).alias("disclosure"))
    return saved(known.where(F.col("disclosure") >= threshold), "revealing")


def sanitise(docs: DataFrame, contexts: int = CONTEXTS, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``spans`` (kind, start, end in code points; those of the
    patterns by kind, then the terms) and ``sanitised``, the text after
    replacement (null: nothing to replace)."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = in_batches(source).mapInArrow(_find, _FOUND).withColumn("uid", F.monotonically_increasing_id())
    found = saved(found, "entities")
    known = revealing(found, source.select("text"), found.count(), contexts, threshold)
    own = found.select("uid", F.explode("pairs").alias("p")).select("uid", "p.c", "p.t").join(small(known.select("c", "t")), ["c", "t"], "left_semi")
    own = saved(own.groupBy("uid").agg(F.collect_set("t").alias("terms")), "gone")
    rows = found.join(own, "uid", "left")
    return in_batches(rows.select("doc_id", "spans", "text", "terms")).mapInArrow(_apply, _RESULT)
