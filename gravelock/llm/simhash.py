"""5, SimHash near-dedup: segment-popcount embedding, grid range-join under Manhattan distance, exact check.

A 64-bit fingerprint maps to the bit counts of its 32 two-bit segments. Two fingerprints that differ in d
bits have embeddings at Manhattan distance d at most, so the distance is a lower bound. The grid: the 32
coordinates form GROUPS groups; if the distance is at most MAX_BITS, at least GROUPS - MAX_BITS groups agree
in all coordinates, so the points are dealt to one cell for each choice of that many groups, and every pair
within the distance meets in a cell. Pairs of a cell pass by the Manhattan distance, then by the bits.

Only different fingerprints enter (copies share theirs). A cell of more than DENSE points is not paired:
its fingerprints are linked through the 65 values at most one bit away from each. Two fingerprints that
differ in two bits or fewer share such a value, and all that share one differ in two bits or fewer, so a
star inside each gives the same components from a number of rows in proportion to the points.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gravelock.llm.common import batches, discard, doc_text, stored
from gravelock.llm.copies import copy_links
from gravelock.llm.graphs import components

WORDS, SEED, MAX_BITS, GROUPS, DENSE = 3, 42, 2, 6, 64
BLOCK, PART = 1 << 16, 256


def shingle_hashes(text: str, k: int = WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of each k-word shingle of the text, A-Z lowered; of all words, if there are fewer; repeats included."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, len(words) - k + 1)


def simhash(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[at : at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprinted(docs: DataFrame, k: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) for each row."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, texts in batches(found):
            fps = [signed(simhash(shingle_hashes(t, k, seed))) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return doc_text(docs).mapInArrow(run, "doc_id long, fp long")


def embedding(fp: Column) -> Column:
    """The bit counts of the 32 two-bit segments, each in the two bits of its segment."""
    pairs, above = F.lit(0x5555555555555555), F.shiftrightunsigned(fp, 1)
    # 2 where both bits are set, 1 where one is (without adding, which may overflow).
    return F.shiftleft(fp.bitwiseAND(above).bitwiseAND(pairs), 1).bitwiseOR(fp.bitwiseXOR(above).bitwiseAND(pairs))


def manhattan(a: Column, b: Column) -> Column:
    """Of two embeddings: bits of a field above and below the other's; fields hold 0, 1 or 2."""
    # 0, 1, 2 in thermometer code are 00, 01, 11: the distance is the number of bits that differ.
    def thermometer(e: Column) -> Column:
        return e.bitwiseOR(F.shiftrightunsigned(e, 1).bitwiseAND(F.lit(0x5555555555555555)))

    return F.bit_count(thermometer(a).bitwiseXOR(thermometer(b)))


def cell_masks(max_bits: int = MAX_BITS, groups: int = GROUPS) -> list[int]:
    """For each choice of groups - max_bits groups, the mask of their segments."""
    parts = [sum(3 << (2 * s) for s in part.tolist()) for part in np.array_split(np.arange(32), groups)]
    return [signed(sum(choice)) for choice in combinations(parts, groups - max_bits)]


def links(fps: DataFrame, dense: int = DENSE) -> DataFrame:
    """fps: different fingerprints (fp). (u, v): links that join exactly what bits up to MAX_BITS apart joins."""
    points = fps.select("fp", embedding(F.col("fp")).alias("e"))
    cells = stored(points.select("fp", "e", F.posexplode(F.array(*[F.col("e").bitwiseAND(F.lit(m)) for m in cell_masks()])).alias("choice", "cell")), "cells")
    counted = stored(cells.groupBy("choice", "cell").agg(F.count("*").alias("n")).where("n > 1"), "counted")
    met = cells.join(counted, ["choice", "cell"])
    few = met.where(F.col("n") <= dense).groupBy("choice", "cell").agg(F.collect_list(F.struct("fp", "e")).alias("p"))  # dense at most
    few = few.select("p", F.explode("p").alias("a"))
    close = lambda a, b: (a["fp"] < b["fp"]) & (manhattan(a["e"], b["e"]) <= MAX_BITS) & (F.bit_count(a["fp"].bitwiseXOR(b["fp"])) <= MAX_BITS)
    pairs = few.select(F.col("a.fp").alias("u"), F.explode(F.filter("p", lambda b: close(F.col("a"), b))).alias("b")).select("u", F.col("b.fp").alias("v"))
    many = met.where(F.col("n") > dense).select("fp").distinct()
    one_off = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(signed(1 << i))) for i in range(64)])
    balls = many.select("fp", F.explode(one_off).alias("ball")).groupBy("ball").agg(F.collect_set("fp").alias("p")).where(F.size("p") > 1)  # 65 at most
    stars = balls.select(F.array_min("p").alias("u"), F.explode("p").alias("v")).where("u <> v")
    return pairs.union(stars)


def near_groups(docs: DataFrame, k: int = WORDS, seed: int = SEED) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, fp, component_id (the least doc_id that can be reached).

    Null, empty and blank texts have fingerprint zero, which links as any other; a null doc_id gets its row
    but names a component only if nothing else is in it (then null); repeated rows each get a row; an empty
    table gives an empty result; other columns are ignored. Texts are read once and not shuffled.
    """
    found = stored(fingerprinted(docs, k, seed), "fingerprints")
    fps = stored(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "different")
    rooted = components(links(fps))
    named = fps.join(rooted, fps["fp"] == rooted["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = stored(named, "rooted")
    least = stored(named.groupBy("root").agg(F.min("first").alias("component_id")), "named")
    named = stored(named.join(least, "root").select("fp", "component_id"), "classes")
    return found.join(named, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id; see near_groups."""
    return near_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Words of a shingle in near_copies.
COPY_WORDS = 5
FEATURES = "doc_id long, mark long, text_key long, fp long, shingles array<long>"


def features(docs: DataFrame) -> DataFrame:
    """For each row a digest of its text (mark), a key of its words, its fingerprint, and its different shingles in unsigned order."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, ids, texts in batches(found):
            for at in range(0, len(ids), PART):
                rows = []
                for t in texts[at : at + PART]:
                    h = shingle_hashes(t, COPY_WORDS)
                    rows.append((signed(xxhash.xxh64_intdigest(b" ".join(t.encode().lower().split()), 1)), signed(simhash(h)), np.unique(h).view(np.int64)))
                key, fp, shingles = zip(*rows, strict=True)
                ends = np.cumsum([0, *map(len, shingles)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(shingles)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, PART), b.column("mark").slice(at, PART), pa.array(key, pa.int64()), pa.array(fp, pa.int64()), lists], ["doc_id", "mark", "text_key", "fp", "shingles"])

    return doc_text(docs, F.xxhash64("text").alias("mark")).mapInArrow(run, FEATURES)


def copy_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key for each row of docs; text_key, root, first: each text's group and first row, as (no id, doc_id, mark))."""
    found = stored(features(docs), "features")
    texts = stored(found.groupBy("text_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first"), F.min("fp").alias("fp")), "texts")
    fps = stored(texts.groupBy("fp").agg(F.min("text_key").alias("key")), "different")
    same = texts.join(fps, "fp").select(F.col("text_key").alias("u"), F.col("key").alias("v"))
    close = links(fps).join(fps.select(F.col("fp").alias("u"), F.col("key").alias("ku")), "u").join(fps.select(F.col("fp").alias("v"), F.col("key").alias("kv")), "v").select("ku", "kv")
    known = stored(same.where("u <> v").union(close), "known")
    rooted = components(copy_links(found.select("text_key", "shingles"), known))
    named = stored(texts.join(rooted, texts["text_key"] == rooted["node"], "left").select("text_key", "first", F.coalesce("root", "text_key").alias("root")), "rooted")
    ids = stored(found.select("doc_id", "text_key"), "ids")
    discard(found, texts, fps, known)
    return ids, named


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, component_id for each row of docs: groups of near copies, for filtering.

    Links: five-word fingerprints MAX_BITS apart (the grid join above), and texts whose sets of five-word
    shingles have a Jaccard similarity of 0.8 or more (`copies`): a few edits scattered over a text move some
    ten bits, so fingerprints alone don't find them. Odd cases are as in near_groups.
    """
    ids, named = copy_groups(docs)
    least = stored(named.groupBy("root").agg(F.min("first")["doc_id"].alias("component_id")), "named")
    return ids.join(stored(named.join(least, "root").select("text_key", "component_id"), "classes"), "text_key").select("doc_id", "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each group of near_copies, with docs' columns: that of the least doc_id (null last), and of the
    least digest of its text if rows of one doc_id differ. Of repeated rows, the one with the least digest of
    all columns stays. Null, empty and blank texts are one group. Rows of one doc_id with texts that are no
    copies are in different groups, and each is judged by its own.
    """
    _, named = copy_groups(docs)
    kept = stored(named.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("_id"), F.col("first.mark").alias("_of")), "kept")
    d = docs.withColumn("_mark", F.xxhash64("text"))
    d = d.join(kept, d["doc_id"].cast("long").eqNullSafe(kept["_id"]) & (d["_mark"] == kept["_of"]))
    d = d.groupBy("_id", "_mark").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_row"))
    return d.select(*(F.col("_row")[c].alias(c) for c in docs.columns))
