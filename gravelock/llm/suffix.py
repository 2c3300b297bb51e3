"""6, Suffix-array dedup: removes every byte of a 100-byte string that also starts earlier, by column-wise construction.

1. Anchors. The least hashed ANCHOR-byte string of a window (leftmost on ties) is its anchor; consecutive
   windows with one anchor form a piece. Equal windows have equal anchors at equal places, so windows are
   only ever compared inside the group of one anchor's content.
2. Anchors that occur once in the corpus are dropped (a count over anchor hashes), each document keeps the
   list of its other pieces.
3. Pieces are dealt by anchor. Within one task's batch, pieces equal byte for byte are sent once; the later
   ones are settled there and then, and dealt by their document. Where equal pieces of several batches meet, the
   earliest is kept in the same way. A group of very many pieces (HOT) is dealt window by window instead, which
   gives the same result: equal windows have equal anchors.
4. A task lays the pieces side by side, aligned at their anchors, and goes through the columns from the last
   to the first, inserting one symbol of every piece each round: the order of the suffixes is updated by a
   stable sort on the new symbols (which, in that order, are the collection's Burrows-Wheeler transform of
   the round), and common prefixes with the neighbour by the least over the passed-over ones, plus one. The
   columns are an external file, written once in column order and read from its end to its start in
   sequence, so memory holds one column and the arrays of the round, whatever the pieces' length.
5. Neighbours with 100 common symbols form runs of equal windows; all but the earliest start are removed.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gravelock.llm.common import batches, discard, doc_text, stored

WINDOW, ANCHOR = 100, 24
SPAN_OF = WINDOW - ANCHOR + 1  # anchors in a window
#: A group of more pieces than this in the corpus is dealt by its windows.
HOT = 20_000
BATCH = 1 << 22
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
LOW = np.uint64(0x7F)


def anchor_hashes(x: np.ndarray) -> np.ndarray:
    """For each place of the bytes x, 64 bits from the ANCHOR bytes that start there."""
    n = len(x) - ANCHOR + 1
    words = np.ndarray((len(x) - 7,), "<u8", x.tobytes(), strides=(1,))
    h = words[:n] * M1
    h ^= h >> np.uint64(32)
    h += words[8 : n + 8]
    h *= M2
    h ^= h >> np.uint64(29)
    h += words[16 : n + 16]
    h *= M3
    h ^= h >> np.uint64(32)
    h *= M1
    h ^= h >> np.uint64(29)
    return h


def pieces_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, anchor, key) of the pieces of one text's bytes, in order. Equal windows share key and anchor place."""
    n = len(x) - WINDOW + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none, none, none
    h = anchor_hashes(x)
    # Sliding minimum by blocks as wide as a window's anchors: the least to the right within the block, and to
    # the left within the next. The low bits hold the place in the block, so that the leftmost wins ties.
    w = SPAN_OF
    blocks = -(-len(h) // w)
    v = np.full(blocks * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    v[: len(h)] = h | LOW
    v = v.reshape(blocks, w)
    v ^= LOW ^ np.arange(w, dtype=np.uint64)
    right = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    left = np.minimum.accumulate(v, axis=1).reshape(-1)
    at = np.arange(n)
    a, b = right[:n], left[w - 1 : w - 1 + n]
    own = (a | LOW) <= (b | LOW)
    base = at // w * w
    anchor = np.where(own, base + (a & LOW).astype(np.int64), (at + w - 1) // w * w + (b & LOW).astype(np.int64))
    first = np.flatnonzero(np.diff(anchor, prepend=-1))
    anchor = anchor[first]
    return first, np.diff(first, append=n), anchor, h[anchor].view(np.int64)


def repeated_pieces(docs: DataFrame) -> DataFrame:
    """doc_id, i (numbers of the document's pieces whose anchor is not the only one), hot (the same, in very large groups)."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, texts in batches(found):
            for doc_id, text in zip(ids, texts, strict=True):
                key = pieces_of(np.frombuffer(text.encode(), np.uint8))[3]
                if len(key):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), doc_id)), pa.array(np.arange(len(key), dtype=np.int32)), pa.array(key)], ["row", "i", "key"])

    def merged(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in run(found):
            held.append(b)
            n += b.num_rows
            if n >= 1 << 17:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    anchors = stored(docs.select(F.col("row").alias("doc_id"), "text").mapInArrow(merged, "row long, i int, key long"), "anchors")
    many = stored(anchors.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "anchor_counts")
    kept = anchors.join(many, "key")
    found = stored(kept.groupBy("row").agg(F.collect_list(F.when(F.col("n") <= HOT, F.col("i"))).alias("i"), F.collect_list(F.when(F.col("n") > HOT, F.col("i"))).alias("hot")), "repeated")
    discard(anchors)
    discard(many)
    return found


def column_order(pieces: list[bytes], anchors: np.ndarray, rank: np.ndarray, window: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pieces, window starts within them) to remove, round by round. rank: the order of the anchors' places in the corpus.

    Only windows at equal distance from the anchor are compared, which for pieces of one task is all.
    """
    m = len(pieces)
    if not m:
        return
    sizes = np.fromiter(map(len, pieces), np.int64, m)
    before, after = int(anchors.max()), int((sizes - anchors).max())
    width = before + after
    with tempfile.TemporaryFile(dir=os.environ.get("TMPDIR")) as file:
        # The external file: column by column, the symbols of all pieces (0 where a piece has none).
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        offset = np.concatenate(([0], np.cumsum(sizes)[:-1])) + anchors - before
        lo, hi = before - anchors, before - anchors + sizes
        for x in range(width):
            there = (lo <= x) & (x < hi)
            file.write(np.where(there, flat[np.where(there, offset + x, 0)], 0).astype(np.uint8).tobytes())
        del flat, offset
        begins: dict[int, np.ndarray] = {}
        by_end = np.argsort(-hi, kind="stable")
        cut = np.flatnonzero(np.diff(hi[by_end]))
        for part in np.split(by_end, cut + 1):
            begins[int(hi[part[0]])] = part
        order, common = np.empty(0, np.int64), np.empty(0, np.int32)  # suffixes in order; common prefix with the one before
        for x in range(width - 1, -1, -1):
            file.seek(x * m)
            column = np.frombuffer(file.read(m), np.uint8)
            new = begins.get(x + 1)
            if new is not None:  # empty suffixes stand first
                order, common = np.concatenate((new, order)), np.concatenate((np.zeros(len(new), np.int32), common))
                if len(new) < len(common):
                    common[len(new)] = 0
            stays = lo[order] <= x
            if not stays.all():
                # What leaves hands its common prefix on to the next that stays.
                at = np.flatnonzero(stays)
                if not len(at):
                    order, common = order[:0], common[:0]
                    continue
                common = np.minimum.reduceat(common[: at[-1] + 1], np.concatenate(([0], at[:-1] + 1)))
                order = order[at]
                common[0] = 0
            symbol = column[order]  # of this round, in suffix order: the transform
            by = np.argsort(symbol, kind="stable")
            symbol = symbol[by]
            first = np.ones(len(by), bool)
            first[1:] = symbol[1:] != symbol[:-1]
            # Least common prefix from behind the last suffix with the same symbol up to this one.
            starts = np.where(first, by, np.concatenate(([0], by[:-1] + 1)))
            ends = by + 1
            passed = least_between(common, starts, ends, first)
            common = np.where(first, 0, passed + 1).astype(np.int32)
            order = order[by]
            same = common >= window
            if same.any():
                near = same.copy()
                near[:-1] |= same[1:]
                at = np.flatnonzero(near)
                runs = np.flatnonzero(~same[at])
                who = order[at]
                least = np.minimum.reduceat(rank[who], runs)
                later = rank[who] > np.repeat(least, np.diff(runs, append=len(at)))
                if later.any():
                    gone = who[later]
                    yield gone, x - lo[gone]


def least_between(common: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The least of common[starts[i]:ends[i]], where starts[i] = ends[i-1] but for the first of a run."""
    # reduceat takes one list of bounds; the last of each run needs its own end.
    last = np.append(first[1:], True)
    size = len(starts) + int(last.sum())
    place = np.arange(len(starts)) + np.concatenate(([0], np.cumsum(last)[:-1]))
    bounds = np.zeros(size, np.int64)
    bounds[place] = starts
    bounds[place[last] + 1] = np.minimum(ends[last], len(common) - 1)
    out = np.minimum.reduceat(common, bounds)[place]
    # Where a run's end is the array's end, the bound was one short.
    short = last & (ends == len(common)) & (starts < len(common) - 1)
    out[short] = np.minimum(out[short], common[-1])
    return out


def runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of the intervals: overlapping and touching ones become one."""
    if not len(starts):
        return starts, ends
    by = np.argsort(starts, kind="stable")
    starts, ends = starts[by], np.maximum.accumulate(ends[by])
    new = np.concatenate(([True], starts[1:] > ends[:-1]))
    return starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)]


PIECES = "key long, row long, start long, anchor int, windows int, piece binary"
NAMES = [x.split()[0] for x in PIECES.split(", ")]
ORDER = ("key", "anchor", "piece", "row", "start")


def mix(row: int, start: int) -> int:
    """A signed 64-bit digest of a stretch of a document, the same for starts that are close."""
    x = (row * 0x9E3779B97F4A7C15 + (start >> 12)) * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF
    x ^= x >> 32
    return x - (1 << 64) if x >> 63 else x


def sent_pieces(joined: DataFrame) -> DataFrame:
    """Pieces for the groups (piece given), and spans already known to go (piece null)."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def flush(held: dict, gone: list) -> pa.RecordBatch:
        rows = [(k, r, s, a, w, p) for (k, a, p), (r, s, w) in held.items()] + gone
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], NAMES)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        held, gone, size = {}, [], 0

        def put(key: int, row: int, start: int, anchor: int, windows: int, piece: bytes) -> None:
            nonlocal size
            other = held.get((key, anchor, piece))
            if other is None:
                held[key, anchor, piece] = (row, start, windows)
                size += len(piece) + 200
                return
            mine = (row, start, windows)
            later = max(mine, other)
            held[key, anchor, piece] = min(mine, other)
            # Settled: any task can take it, so it is dealt by its place, not by its key.
            gone.append((mix(later[0], later[1]), later[0], later[1], 0, windows, None))
            size += 60

        for b in found:
            for row, packed, i, hot in zip(*(b.column(c).to_pylist() for c in ("row", "packed", "i", "hot")), strict=True):
                data = unpack(packed)
                start, windows, anchor, key = pieces_of(np.frombuffer(data, np.uint8))
                some = np.array(i, np.int64)
                for s, w, a, k in zip(*(c[some].tolist() for c in (start, windows, anchor, key)), strict=True):
                    put(k, row, s, a - s, w, data[s : s + w + WINDOW - 1])
                some = np.array(hot, np.int64)
                for s, w, a in zip(*(c[some].tolist() for c in (start, windows, anchor)), strict=True):
                    for x in range(s, s + w):
                        piece = data[x : x + WINDOW]
                        put(int.from_bytes(hashlib.blake2b(piece, digest_size=8).digest(), "little", signed=True), row, x, a - x, 1, piece)
                if size > 16 * BATCH:
                    yield flush(held, gone)
                    held, gone, size = {}, [], 0
            if len(gone) > 1 << 16:
                yield flush({}, gone)
                gone = []
        if held or gone:
            yield flush(held, gone)

    return joined.mapInArrow(run, PIECES)


def later_windows(pieces: DataFrame) -> DataFrame:
    """row, start, end of the stretches to remove. pieces: a key's in one partition, sorted by ORDER: of equal pieces
    the earliest comes first, so a task holds different pieces only, however often one is sent."""

    def of_task(rows: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        row, start, anchor = (np.array(c, np.int64) for c in list(zip(*rows, strict=True))[:3])
        by = np.lexsort((start, row))
        row, start, anchor = row[by], start[by], anchor[by]
        rank = np.empty(len(by), np.int64)
        rank[np.lexsort((start + anchor, row))] = np.arange(len(by))
        for who, at in column_order([rows[j][3] for j in by.tolist()], anchor, rank):
            s = start[who] + at
            yield row[who], s, s + WINDOW

    def joined(parts: list[tuple]) -> pa.RecordBatch:
        """Fewer rows: the union of what each document loses here."""
        row, s, e = (np.concatenate(c) for c in zip(*parts, strict=True))
        by = np.lexsort((s, row))
        row, s, e = row[by], s[by], e[by]
        new = np.ones(len(row), bool)
        edge = np.flatnonzero(np.diff(row)) + 1
        # Ends so far within the document: raise each document above all before it, then take the running maximum.
        step = int(e.max()) + 1
        nth = np.zeros(len(row), np.int64)
        nth[edge] = 1
        top = np.maximum.accumulate(e + np.cumsum(nth) * step) - np.cumsum(nth) * step
        new[1:] = (s[1:] > top[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        return pa.RecordBatch.from_arrays([pa.array(row[first]), pa.array(s[first]), pa.array(top[np.append(first[1:], len(row)) - 1])], ["row", "start", "end"])

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, n, done, was = [], 0, [], (None, None, None)
        for b in found:
            for key, row, start, anchor, windows, piece in zip(*(b.column(c).to_pylist() for c in NAMES), strict=True):
                if piece is None or (key, anchor, piece) == was:
                    # Known to go, or equal to the earlier piece right before it, which enters the construction for all.
                    done.append((np.array([row]), np.array([start]), np.array([start + windows + WINDOW - 1])))
                    continue
                if n > 8 * BATCH and key != was[0]:  # groups are whole: rows come sorted by key
                    done += of_task(rows)
                    rows, n = [], 0
                was = key, anchor, piece
                rows.append((row, start, anchor, piece))
                n += len(piece)
            if len(done) > 1 << 16:
                yield joined(done)
                done = []
        if rows:
            done += of_task(rows)
        if done:
            yield joined(done)

    return pieces.mapInArrow(run, "row long, start long, end long")


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string"


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """One row for each document: SCHEMA; spans are the removed runs as start:end in bytes.

    Null texts are empty; documents of under 100 bytes lose nothing. Repeated rows and null ids are told
    apart by `ranked`, which orders rows by doc_id (null last), then text; of equal rows one is the earlier.
    An empty table gives an empty result; other columns are ignored. Texts cross the network twice, compressed.
    """
    spark = docs.sparkSession
    d = ranked(docs)
    found = repeated_pieces(d.select("row", "text"))
    packed = compressed(d)
    sent = sent_pieces(packed.join(found, "row").select("row", "packed", "i", "hot"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spans = stored(later_windows(sent.repartition(n, "key").sortWithinPartitions(*ORDER)), "removed")
    discard(found)
    lost = spans.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("lost"))
    out = compressed(d).join(lost, "row", "left")

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for b in found:
            rows = []
            for packed, lost in zip(b.column("packed").to_pylist(), b.column("lost").to_pylist(), strict=True):
                data = unpack(packed)
                s, e = runs(np.array([x["start"] for x in lost or ()], np.int64), np.array([x["end"] for x in lost or ()], np.int64))
                keep = [data[a:z] for a, z in zip([0, *e.tolist()], [*s.tolist(), len(data)], strict=True)]
                rows.append((len(data), int((e - s).sum()), len(s), hashlib.sha256(b"".join(keep)).hexdigest(), ",".join(f"{a}:{z}" for a, z in zip(s, e, strict=True))))
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], [x.split()[0] for x in SCHEMA.split(", ")])

    return out.select("doc_id", "packed", "lost").mapInArrow(run, SCHEMA)


def ranked(docs: DataFrame) -> DataFrame:
    """doc_id, text, row: as doc_id where ids are all there and differ; else a running number by doc_id and text."""
    d = doc_text(docs)
    ids = d.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL")
    if not ids.take(1):
        return d.withColumn("row", F.col("doc_id"))
    # Even ranges by id, then by text, so that one much repeated id is many ranges; offsets come from the ranges' sizes.
    n = max(1, int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("doc_id").asc_nulls_last(), F.col("text")]
    s = stored(d.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id()), "ordered")
    sizes = sorted((r["part"], r["count"], r["least"]) for r in s.groupBy("part").agg(F.count("*").alias("count"), F.min("nth").alias("least")).collect())
    shift, at = [], 0
    for part, count, least in sizes:
        shift += [F.lit(part), F.lit(at - least)]
        at += count
    return s.withColumn("row", F.col("nth") + F.element_at(F.create_map(*shift), F.col("part"))).select("doc_id", "text", "row")


def compressed(d: DataFrame) -> DataFrame:
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in found:
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array([pack(t.encode()) for t in b.column("text").to_pylist()], pa.binary())], ["row", "doc_id", "packed"])

    return d.select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, packed binary")
