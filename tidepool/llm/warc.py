"""WARC archives: writing with revisits, reading by boundary-chain verification.

``write_archives`` packs whole records into segments of about
``SEGMENT_BYTES``; Spark's text sink writes one file for each, so that a file
never holds more than a segment (or one larger record).  The digest groups are
found on narrow rows; the payload itself is not shuffled.

``read_archives`` looks for the magic line anywhere in a file.  Each place
where it stands is a candidate; its header gives the offset of the successor.
The candidates (a few numbers each) are brought together by file, and pointer
jumping from offset 0 keeps those that the chain of records reaches.  Magic
inside a payload is a candidate too, but nothing reaches it.

Defined results: a null payload is empty; a null url has no target line; a
page id that is null is written as such and read back as null; rows with equal
id and payload are the same record written again, all with the same type; an
empty table gives no file and no rows.  Line ends in a url are percent-coded.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import small

SEGMENT_BYTES = 16 << 20
#: Payloads of fewer bytes are always written in full.
MIN_REVISIT = 100

MAGIC = b"WARC/1.0\r\n"
_END = b"\r\n\r\n"
_FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)")
RECORDS = ("file string, offset long, successor long, size long, page_id long, record_type string, url string, "
           "payload_bytes long, payload_digest string, refers_to long")


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """``page_id, url, payload, digest, refers_to``: the last is the smallest
    page id with an equal payload of at least ``min_bytes``, if another."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                        F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    long = base.where(F.octet_length("payload") >= min_bytes).select("page_id", F.sha2("payload", 256).alias("digest"))
    first = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    again = (long.join(first.where("last > first").select("digest", "first"), "digest")
             .where("page_id > first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct())
    base = base.withColumn("digest", F.sha2("payload", 256))
    return base.join(small(again), ["page_id", "digest"], "left")


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record, without its last line end (the sink adds that)."""
    kind = "response" if refers_to is None else "revisit"
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
            "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is None:
        body = payload
        head.append("Content-Type: text/html; charset=utf-8")
    else:
        body = b""
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"X-Payload-Length: {len(payload)}",
                 "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(body)}")
    return MAGIC + "\r\n".join(head).encode() + _END + body + b"\r\n"


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT) -> None:
    """Write a record for each page under ``path``."""
    def pack(batches):
        held, size = [], 0
        for b in batches:
            for page_id, digest, url, payload, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                held.append(record(page_id, url, payload, digest, refers_to))
                size += len(held[-1]) + 2
                if size >= SEGMENT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"\r\n".join(held)], pa.binary())], ["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"\r\n".join(held)], pa.binary())], ["value"])

    rows = with_revisits(pages, min_bytes).select("page_id", "digest", "url", "payload", "refers_to")
    (rows.mapInArrow(pack, "value binary").select(F.col("value").cast("string").alias("value"))
     .write.option("lineSep", "\r\n").option("maxRecordsPerFile", 1).text(path))


def _number(urn: str | None):
    digits = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(digits[1]) if digits else None


def candidates(file: str, data: bytes) -> list[tuple]:
    """A row for each place in ``data`` where a record may begin."""
    out, at = [], data.find(MAGIC)
    while at >= 0:
        stop = data.find(_END, at)
        fields = {k.strip().lower(): v.decode("utf-8", "replace") for k, v in _FIELD.findall(data, at + len(MAGIC), stop)} if stop >= 0 else {}
        length = fields.get(b"content-length", "")
        if length.isascii() and length.isdigit():
            body, end = stop + 4, stop + 4 + int(length)
            if data[end:end + 4] == _END:
                kind = fields.get(b"warc-type", "")
                if kind == "revisit":
                    size, digest = fields.get(b"x-payload-length", ""), fields.get(b"warc-payload-digest", "")
                    size, digest = int(size) if size.isdigit() else 0, digest.rpartition(":")[2]
                else:
                    size, digest = int(length), hashlib.sha256(memoryview(data)[body:end]).hexdigest()
                out.append((file, at, end + 4, len(data), _number(fields.get(b"warc-record-id")), kind,
                            fields.get(b"warc-target-uri"), size, digest, _number(fields.get(b"warc-refers-to"))))
        at = data.find(MAGIC, at + 1)
    return out


def reachable(offset: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """Which candidates (sorted by offset) the chain from offset 0 reaches:
    in round k every reached one marks the one 2**k steps on."""
    n = len(offset)
    to = np.searchsorted(offset, successor)
    ok = (to < n) & (offset[np.minimum(to, n - 1)] == successor)
    to = np.append(np.where(ok, to, n), n)
    seen = np.zeros(n + 1, bool)
    seen[0] = n > 0 and offset[0] == 0
    while True:
        nxt = seen.copy()
        nxt[to[seen]] = True
        if (nxt == seen).all():
            return seen[:n]
        seen, to = nxt, to[to]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all files under ``path`` (see ``RECORDS``)."""
    def scan(batches):
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1)):
                rows = candidates(file, data.as_py())
                if rows:
                    yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=names), schema=arrow, preserve_index=False)

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("offset", kind="stable")
        return rows[reachable(rows["offset"].to_numpy(), rows["successor"].to_numpy())]

    names = [f.split(" ")[0] for f in RECORDS.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64()}
    arrow = pa.schema([(f.split(" ")[0], kinds[f.split(" ")[1]]) for f in RECORDS.split(", ")])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(scan, RECORDS).groupBy("file").applyInPandas(chain, RECORDS)
