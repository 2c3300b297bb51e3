"""2, Document fingerprints: a quartile bucket digest of hashed byte triplets, and a bounded difference score.

Over every five-byte window of the text's UTF-8 bytes, the six triplets that hold the window's last byte are
hashed, each with a salt of its own, into 128 buckets (texts under five bytes: what triplets there are). The
digest, in hex, is: the length on a log scale (2 digits), the two quartile ratios q1/q3 and q2/q3 in
sixteenths (2 digits), the buckets' quartile codes of two bits each (64 digits). A text of no triplets has
all-zero codes. Equal texts have equal digests.

The difference of two digests adds: per bucket the distance of the codes (0 to 3, and 6 for 3), the
difference in length (12 for each step past one) and in the ratios (12 for each step past one). `likeness` is
1 - difference / BOUND, at least 0; equal digests have 1.

The edited text needs the next document: documents are dealt by ranges of doc_id, each range is streamed in
order, and the texts at the ranges' ends are joined afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gravelock.llm.common import doc_text, stored

BUCKETS = 128
#: A difference that counts as none alike.
BOUND = 300
#: Odd multipliers of the triplets' bytes and of the salts.
A, B, C, SALT = (np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F))
#: The six triplets of a window, as places counted back from its last byte.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 2, 4), (0, 1, 4), (0, 3, 4))
BLOCK = 1 << 20
#: Characters of a text that its range goes by, among rows of one doc_id.
OPENING = 64


def bucket_counts(data: bytes) -> np.ndarray:
    """How many hashed triplets fall into each bucket; in blocks, so that memory is bounded."""
    counts = np.zeros(BUCKETS, np.int64)
    whole = np.frombuffer(data, np.uint8)
    for at in range(0, len(whole), BLOCK):
        x = whole[max(0, at - 4) : at + BLOCK].astype(np.uint32)
        fresh = at - max(0, at - 4)
        first, second, third = x * A, x * B, x * C
        for k, (i, j, m) in enumerate(TRIPLETS):
            start = max(fresh, m)
            if len(x) > start:
                n = len(x)
                h = first[start - i : n - i] ^ second[start - j : n - j]
                h += third[start - m : n - m]
                h += SALT * np.uint32(k)
                h ^= h >> np.uint32(15)
                h *= A
                counts += np.bincount(h >> np.uint32(25), minlength=BUCKETS)
    return counts


def length_code(n: int) -> int:
    """Steps of about 15 percent, up to 255."""
    return min(255, int(np.log1p(n) / np.log(1.15)))


def fingerprint(text: str | bytes) -> str:
    data = text if isinstance(text, bytes) else text.encode()
    counts = bucket_counts(data)
    q1, q2, q3 = (int(x) for x in np.partition(counts, (31, 63, 95))[[31, 63, 95]])
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = codes[0::4] << 6 | codes[1::4] << 4 | codes[2::4] << 2 | codes[3::4]
    ratios = (16 * q1 // q3 if q3 else 0, 16 * q2 // q3 if q3 else 0)
    return f"{length_code(len(data)):02x}{min(15, ratios[0]):x}{min(15, ratios[1]):x}{packed.astype(np.uint8).tobytes().hex()}"


def unpacked(digest: str) -> tuple[int, int, int, np.ndarray]:
    p = np.frombuffer(bytes.fromhex(digest[4:]), np.uint8)
    return int(digest[:2], 16), int(digest[2], 16), int(digest[3], 16), np.stack([p >> 6, p >> 4 & 3, p >> 2 & 3, p & 3]).astype(np.int64)


def difference(a: str, b: str) -> int:
    (la, *ra, ca), (lb, *rb, cb) = unpacked(a), unpacked(b)
    apart = np.abs(ca - cb)
    step = lambda d: d if d <= 1 else 12 * (d - 1)
    return int(apart.sum()) + 3 * int((apart == 3).sum()) + step(abs(la - lb)) + sum(step(abs(x - y)) for x, y in zip(ra, rb, strict=True))


def likeness(a: str, b: str) -> float:
    return max(0.0, 1.0 - difference(a, b) / BOUND)


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as many (or all) of the first characters of `following`."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
#: What a range gives: its finished rows (side null), and the texts at its two ends, whose neighbours are elsewhere.
HEAD, TAIL = 0, 1
ENDS = SCHEMA + ", part int, side int, text string"


def batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = pa.schema([(x.split()[0], KINDS[x.split()[1]]) for x in schema.split(", ")])
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), fields.types, strict=True)], schema=fields)


def compared(doc_id: int | None, text: str, digest: str, after: str, after_digest: str) -> tuple:
    """The row (SCHEMA) of a text that `after` follows."""
    other = edited(text, after)
    own = fingerprint(other)
    return doc_id, len(text), hashlib.sha256(other.encode()).hexdigest(), digest, own, likeness(digest, own), likeness(digest, after_digest)


def fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """One row for each row of docs (doc_id, text): SCHEMA; the next document is that of the next smaller doc_id, after the last the first.

    Null texts count as empty; a null doc_id comes last; rows of equal doc_id (or none) follow each other by text, so
    repeated rows are each other's next document; a single row is its own next; an empty table gives an
    empty result; other columns are ignored. One shuffle of the texts, by ranges of doc_id and the text's first
    characters; a task streams its range and holds two documents and one batch, however long they are. The first and
    last text of each range meet those of their neighbours in a join by range number; the driver only sees which
    ranges have rows.
    """
    spark = docs.sparkSession
    d = doc_text(docs)
    n = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), d.rdd.getNumPartitions())
    by = F.col("doc_id").desc_nulls_last()
    dealt = d.repartitionByRange(n, by, F.substring("text", 1, OPENING)).sortWithinPartitions(by, "text").withColumn("part", F.spark_partition_id())

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part = None, 0  # doc_id, text, fingerprint of the row before
        for b in found:
            out = []
            for i, t, p in zip(b.column("doc_id"), b.column("text"), b.column("part"), strict=True):
                doc_id, text, part = i.as_py(), t.as_py(), p.as_py()
                digest = fingerprint(text)
                out.append((*compared(*last, text, digest), part, None, None) if last else (*[None] * 7, part, HEAD, text))
                last = doc_id, text, digest
            if out:
                yield batch(out, ENDS)
        if last:
            yield batch([(last[0], *[None] * 6, part, TAIL, last[1])], ENDS)

    def close(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            for doc_id, text, after in zip(*b.columns, strict=True):  # a row at a time: an end may be very long
                text, after = text.as_py(), after.as_py()
                yield batch([compared(doc_id.as_py(), text, fingerprint(text), after, fingerprint(after))], SCHEMA)

    table = stored(dealt.mapInArrow(run, ENDS), "fingerprints")
    parts = sorted(r["part"] for r in table.where(F.col("side") == HEAD).select("part").collect())  # a number for each range
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next int")
    heads = table.where(F.col("side") == HEAD).select(F.col("part").alias("next"), F.col("text").alias("after"))
    ends = table.where(F.col("side") == TAIL).select("part", "doc_id", "text").join(follows, "part").join(heads.hint("merge"), "next").select("doc_id", "text", "after")
    return table.where("side IS NULL").select(*(x.split()[0] for x in SCHEMA.split(", "))).union(ends.mapInArrow(close, SCHEMA))
