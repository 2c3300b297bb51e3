"""Links between texts whose sets of five-word shingles have a Jaccard similarity of SIMILARITY or more.

A text of n shingles shares at least ceil(0.8 n) of them with such a partner, so under any one order of all
shingles the first n - ceil(0.8 n) + 1 of both (their prefixes) have one in common: pairs that meet in a prefix
are all there are. The order is by hash, with shingles of over DENSE rows last, so that a passage of
many documents brings texts together only if it is most of what they say. Of a pair, the number of shared
prefix shingles bounds what it can share in all; pairs under the bound go before any text is looked at.

Late shingles that are in prefixes even so are not paired at first: each text is held against one text of the
shingle's group, in ROUNDS rounds, and what is linked by then is one. Of the pairs that are left between different
components, those that share an early shingle have met by it; the others can only share late ones, and
those that have enough of them for that are held against each other. So no pair is missed, whatever the group.
Such a pair is made only if its parity bits allow it: every shingle flips one bit of its text's, so that two texts
differ in at most as many bits as there are shingles that only one of them has, which are few if they are alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gravelock.llm.common import discard, stored
from gravelock.llm.files import LongSet, Mapped
from gravelock.llm.graphs import components

DENSE, ROUNDS, SLICE = 16, 3, 512
#: A power of two.
TURNS = 4
#: Words of 64 parity bits.
PARITY = 8
PREFIX = "token long, key long, n long, h long, hot boolean"


def least_common(n: np.ndarray) -> np.ndarray:
    """How many of n shingles a partner must share: ceil(0.8 n)."""
    return (4 * n + 4) // 5


def prefix_marks(counts: np.ndarray, last: np.ndarray) -> np.ndarray:
    """counts: the texts' numbers of shingles, which stand one after another, each text's in order of hash; marks the prefixes if those marked in `last` come last."""
    starts = np.cumsum(counts) - counts
    text = np.repeat(np.arange(len(counts)), counts)

    def rank(mask: np.ndarray) -> np.ndarray:
        upto = np.concatenate(([0], np.cumsum(mask)))
        return upto[:-1] - upto[starts][text]

    room = counts - least_common(counts) + 1
    early = np.bincount(text, weights=~last, minlength=len(counts)).astype(np.int64)
    return np.where(last, rank(last) < (room - early)[text], rank(~last) < room[text])


def slices(found: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, shingles one after another, number of each text) of texts that have any."""
    for b in found:
        for at in range(0, b.num_rows, SLICE):
            part = b.slice(at, SLICE)
            lists = part.column("shingles")
            counts = np.diff(lists.offsets.to_numpy())
            some = counts > 0
            if some.any():
                yield part.column("text_key").to_numpy()[some], lists.flatten().to_numpy(), counts[some].astype(np.int64)
        pa.default_memory_pool().release_unused()


def prefixes(features: DataFrame, late: LongSet) -> DataFrame:
    """A row for each prefix shingle: its text's key, number of shingles, number of `late` ones in the prefix, and if it is one."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = Mapped()
        for keys, values, counts in slices(found):
            last = late.within(values, maps)
            marks = prefix_marks(counts, last)
            text, token, hot = np.repeat(np.arange(len(counts)), counts)[marks], values[marks], last[marks]
            h = np.bincount(text, weights=hot, minlength=len(counts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(keys[text]), pa.array(counts[text]), pa.array(h[text]), pa.array(hot)], ["token", "key", "n", "h", "hot"])

    return features.select("text_key", "shingles").mapInArrow(run, PREFIX)


def frequent(features: DataFrame, k: int) -> DataFrame:
    """The shingles (token) of more than DENSE rows, of the k-th of TURNS ranges: one range is shuffled at a time."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, values, _ in slices(found):
            own = values.view(np.uint64) >> np.uint64(64 - (TURNS - 1).bit_length()) == k
            yield pa.RecordBatch.from_arrays([pa.array(values[own])], ["token"])

    return features.select("text_key", "shingles").mapInArrow(run, "token long").groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") > DENSE).select("token")


def parities(features: DataFrame, keys: LongSet) -> DataFrame:
    """key, p0, p1, ... of the texts with these keys: their parity bits."""
    names, size = [f"p{k}" for k in range(PARITY)], 64 * PARITY

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = Mapped()
        for text, values, counts in slices(found):
            own = keys.within(text, maps)
            values, text, counts = values[np.repeat(own, counts)], text[own], counts[own]
            flips = np.repeat(np.arange(len(text)), counts) * size + (values & (size - 1))
            bits = np.bincount(flips, minlength=len(text) * size).astype(np.uint8) & 1
            words = np.packbits(bits).view(np.int64).reshape(-1, PARITY)
            yield pa.RecordBatch.from_arrays([pa.array(text), *(pa.array(np.ascontiguousarray(words[:, k])) for k in range(PARITY))], ["key", *names])

    schema = ", ".join(f"{x} long" for x in ("key", *names))
    return features.select("text_key", "shingles").mapInArrow(run, schema).dropDuplicates(["key"])


def bodies(features: DataFrame, keys: LongSet) -> DataFrame:
    """key, shingles of the texts with these keys, once each."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = Mapped()
        for b in found:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                yield part.filter(pa.array(keys.within(part.column("text_key").to_numpy(), maps)))
            pa.default_memory_pool().release_unused()

    kept = features.select("text_key", "shingles").mapInArrow(run, "text_key long, shingles array<long>")
    return kept.groupBy(F.col("text_key").alias("key")).agg(F.first("shingles").alias("shingles"))


def sized(a: Column, b: Column) -> Column:
    """Numbers of shingles that a pair can have."""
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def enough(common: Column, a: Column, b: Column) -> Column:
    """common / (a + b - common) >= 0.8, in whole numbers."""
    return 9 * common >= 4 * (a + b)


def near(n: Column, n2: Column) -> Column:
    """If the parity bits (p0, ... and p02, ...) of two texts leave room for enough common shingles: at most (n + n2) / 9
    are not common then."""
    return 9 * reduce(Column.__add__, (F.bit_count(F.col(f"p{k}").bitwiseXOR(F.col(f"p{k}2"))) for k in range(PARITY))) <= n + n2


def without_cold(n: Column, c: Column, n2: Column, c2: Column) -> Column:
    """If two texts with late shingles in their prefixes, that share no other, can have enough. All their other shingles
    (c, c2) are in their prefixes, where they would have met, so they only can share the late ones."""
    return enough(F.least(n - c, n2 - c2), n, n2)


def possible(met: Column, a: Column, b: Column) -> Column:
    """If a pair with `met` common prefix shingles can have enough: all others come after one of the prefixes."""
    after = lambda n: F.floor((4 * n + 4) / 5) - 1
    return enough(met + F.greatest(after(a), after(b)), a, b)


def verified(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """The pairs (u, v) that are alike."""
    keys = LongSet(pairs.select(F.explode(F.array("u", "v")).alias("key")))
    body = stored(bodies(features, keys), "bodies")
    keys.remove(features)
    a, b = body.select(F.col("key").alias("u"), F.col("shingles").alias("a")), body.select(F.col("key").alias("v"), F.col("shingles").alias("b"))
    out = stored(pairs.select("u", "v").join(a, "u").join(b, "v").where(alike(F.col("a"), F.col("b"))).select("u", "v"), "verified")
    discard(body)
    return out


def alike(a: Column, b: Column) -> Column:
    """Jaccard similarity of at least 0.8, of whole shingle sets."""
    return enough(F.size(F.array_intersect(a, b)), F.size(a), F.size(b))


def cold_pairs(rows: DataFrame) -> DataFrame:
    """u, v, met: pairs that share a prefix shingle of few texts and can be alike. u < v."""
    groups = rows.where("not hot").groupBy("token").agg(F.collect_set(F.struct("key", "n", "h")).alias("p")).where(F.size("p") > 1)  # DENSE at most
    one = groups.select("p", F.explode("p").alias("a"))
    pairs = one.select("a", F.explode(F.filter("p", lambda b: (F.col("a.key") < b["key"]) & sized(F.col("a.n"), b["n"]))).alias("b"))
    met = pairs.groupBy(F.col("a.key").alias("u"), F.col("b.key").alias("v")).agg(F.count("*").alias("met"), *(F.first(f"{x}.{y}").alias(x + y) for x in "ab" for y in "nh"))
    return met.where(possible(F.col("met") + F.least("ah", "bh"), F.col("an"), F.col("bn"))).select("u", "v", "met")


def rooted(table: DataFrame, key: str, links: DataFrame, root: str) -> DataFrame:
    """table with the component of its key."""
    r = links.select(F.col("node").alias(key), F.col("root").alias(root))
    return table.join(r, key, "left").withColumn(root, F.coalesce(root, key))


def apart(table: DataFrame) -> DataFrame:
    """The rows (token, key, n, c, root) of shingles that texts of different components have."""
    split = table.groupBy("token").agg(F.min("root").alias("_a"), F.max("root").alias("_z")).where("_a < _z").select("token")
    return table.join(split, "token")


def copy_links(features: DataFrame, known: DataFrame) -> DataFrame:
    """features: text_key, shingles (different ones, in unsigned order; a key's rows are equal). known: links
    (u, v) that hold anyway. Links that, with the known ones, give the components that all pairs alike give."""
    parts = [stored(frequent(features, k), "late") for k in range(TURNS)]
    late = LongSet(reduce(DataFrame.union, parts))
    rows = stored(prefixes(features, late), "prefixes")
    late.remove(features)
    pairs = stored(cold_pairs(rows), "pairs")
    dense = stored(rows.where("hot").select("token", "key", "n", (F.col("n") - F.floor((4 * F.col("n") + 4) / 5) + 1 - F.col("h")).alias("c")).distinct(), "dense")
    discard(rows, *parts)
    both = pairs.union(pairs.select("v", "u", "met"))
    best = both.groupBy("u").agg(F.max_by("v", F.struct("met", "v")).alias("v"))
    links, tested = known, None
    for turn in range(ROUNDS):
        parts = stored(apart(rooted(dense, "key", components(links), "root")) if turn else dense.withColumn("root", F.col("key")), "parts")
        # First the text with the fewest shingles of its own, from which edited copies come; then any.
        rank = F.struct(F.lit(0) if turn else F.col("c"), F.xxhash64("key", F.lit(turn)), F.col("key").alias("key"), F.col("n").alias("n"))
        centre = stored(parts.groupBy("token").agg(F.min(rank).alias("m")).select("token", F.col("m.key").alias("centre"), F.col("m.n").alias("of")), "centres")
        star = parts.join(centre, "token").where((F.col("key") != F.col("centre")) & sized(F.col("n"), F.col("of"))).select(F.col("key").alias("u"), F.col("centre").alias("v"))
        star = star if turn else star.union(best)
        star = star.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        star = stored(star if tested is None else star.join(tested, ["u", "v"], "left_anti"), "stars")
        tested = star if tested is None else tested.union(star)
        links = links.union(verified(star, features))
    roots = components(links)
    parts = stored(apart(rooted(dense, "key", roots, "root")), "parts")
    keys = LongSet(parts.select("key"))
    a = stored(parts.join(parities(features, keys), "key"), "parities")
    keys.remove(features)
    b = a.select("token", *(F.col(x).alias(f"{x}2") for x in a.columns if x != "token"))
    rest = a.join(b, "token").where((F.col("key") < F.col("key2")) & (F.col("root") != F.col("root2")) & without_cold(*map(F.col, ("n", "c", "n2", "c2"))) & near(F.col("n"), F.col("n2")))
    rest = rest.groupBy(F.col("key").alias("u"), F.col("key2").alias("v")).agg(F.count("*").alias("met"), *(F.first(x).alias(x) for x in ("n", "n2", "c", "c2")))
    rest = rest.where(possible(F.col("met") + F.least("c", "c2"), F.col("n"), F.col("n2"))).select("u", "v")
    few = rooted(rooted(pairs, "u", roots, "ru"), "v", roots, "rv").where("ru <> rv").select("u", "v")
    left = stored(rest.union(few).distinct().join(tested, ["u", "v"], "left_anti"), "left")
    discard(pairs, dense, parts, a)
    return links.union(verified(left, features))
