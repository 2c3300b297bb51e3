"""3, LM scoring: an Elias-Fano n-gram trie of order three, in memory-mapped levels, learned from the corpus.

Level one holds the words: sorted 64-bit digests with their exact counts and numbers (frequent words have small
ones). The other levels are cut into shards by context. A shard's trie leads from a context of one word v to its
successors w (p2), and from v to the words u before it and on to the successors of u v (p3). All
pointers are monotone and, like the words below each context, Elias-Fano sequences: a context's words are made
to rise above the last word of the context before. A successor is searched for among its context's words only,
and in the third level by its place among the successors of v, not by its number.

p1(w) = (c(w)+1) / (N+V+1). After a context h with c(h) tokens of N(h) kinds, absolute discounting is
interpolated: p(w|h) = max(c(hw)-D, 0) / c(h) + D N(h) / c(h) p(w|shorter h); p3 rests on p2, and p2 on p1. All
counts enter, no n-gram is dropped. Probabilities and back-off weights are 16-bit logarithms, so a text's score is
a sum of whole numbers, whatever the order of the sum. A text's first token has p1.

Frequent histories: the successors of a word v, or of a pair u v, of HOT_TOKENS training tokens or more are counted
apart, each batch's first, in levels of their own, whose files are dealt by history and successor, so none is too
large for a task. What follows such a pair is scored from these files by the batch that has it. The trigrams of
such a word are dealt to shards by u as well, and its shards take p2 from the files. So every probability is that
of the whole context, and scores do not depend on HOT_TOKENS, on the number of shards or on the input's size.

Texts are read once, and written as batches of token indices. Words are counted first; then each batch looks
up its words and deals its trigrams, as compressed lists, to the shards. A shard's task takes its contexts in
pieces: for each it counts the training trigrams, writes the trie's file to the shared folder, maps it and looks up
every trigram that it was sent. It answers each batch with one sum for each text. No task or machine ever needs
the whole model.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gravelock.llm.common import batches, discard, doc_text, removed, scratch, stored
from gravelock.llm.elias_fano import EliasFano
from gravelock.llm.files import Filed, Mapped, drop_file, file_of, laid_out, mapped, put_file

FOLDS, HELD_OUT = 7, 2
DISCOUNT = 0.75
BEGIN, END = 1, 2  # digests that no word has
#: log10 probabilities and weights lie in -RANGE..0, in STEPS steps.
RANGE, STEPS = 24.0, 65535
MAX_KNOWN = 600_000
CHUNK_CHARS = 6 << 20
SHARD_TOKENS, HOT_TOKENS = 1 << 20, 1 << 18
#: Trigrams of a shard that are sorted, counted and looked up at a time.
PIECE_TOKENS = 1 << 17
#: Files of level one.
MAX_FILES = 1 << 14
#: Words of one file that are held before they are summed.
HELD_WORDS = 1 << 21


def held_out(doc_id: int | None) -> bool:
    """A null doc_id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


class Digests(dict):
    """word -> its 64-bit digest as a signed long, never 0, BEGIN or END."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        h = h if h > 2 else h + 3
        h = h - (1 << 64) if h >> 63 else h
        if len(self) >= MAX_KNOWN:
            self.clear()
        self[word] = h
        return h


@lru_cache(maxsize=1)
def digests() -> Digests:
    return Digests()


def tokens_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(digests of all tokens, each text's words and END; number of tokens of each text)."""
    known = digests().__getitem__
    parts = []
    for t in texts:
        words = t.encode().lower().split()
        parts.append(np.fromiter(map(known, words), np.int64, len(words)))
        parts.append(np.array([END]))
    return np.concatenate(parts), np.fromiter((len(p) + 1 for p in parts[::2]), np.int64, len(texts))


def chunks(ids: list, texts: list[str]) -> Iterator[tuple[list, list[str]]]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > CHUNK_CHARS:
            yield ids[at : i + 1], texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield ids[at:], texts[at:]


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A digest of the pairs."""
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x += b.astype(np.uint64)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    return x


def squeezed(*columns: np.ndarray) -> bytes:
    """Unsigned columns, each as planes of its bytes (those that hold anything), compressed."""
    parts = [len(columns).to_bytes(4, "little")]
    for c in columns:
        c = c.astype("<u8", copy=False)
        width = (int(c.max()).bit_length() + 7) // 8 if len(c) else 0
        parts += [len(c).to_bytes(4, "little"), width.to_bytes(4, "little")]
        c = c.astype("<u4") if width <= 4 else c
        parts.append(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1)[:, :width].T).tobytes() if len(c) else b"")
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unsqueezed(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    at, out = 4, []
    for _ in range(int.from_bytes(raw[:4], "little")):
        n, width = (int.from_bytes(raw[at + k : at + k + 4], "little") for k in (0, 4))
        at += 8
        c = np.zeros((n, 8 if width > 4 else 4), np.uint8)
        c[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
        out.append(c.view("<u8" if width > 4 else "<u4").reshape(-1))
        at += n * width
    return out


def quantised(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-x * (STEPS / RANGE)), 0, STEPS).astype("<u2")


def restored(q: np.ndarray) -> np.ndarray:
    return q * (-RANGE / STEPS)


# --- batches of tokens

BATCH = "batch long, doc_id array<long>, length binary, words binary, trained binary, tokens binary"


def tokenised(docs: DataFrame) -> DataFrame:
    """One row for each batch of whole texts: its different words (digests, frequent ones first), how often each
    is in training texts, and the texts' tokens as places among those words."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 32, 0
        for _, all_ids, all_texts in batches(found, 2048):
            for ids, texts in chunks(all_ids, all_texts):
                token, length = tokens_of(texts)
                words, which, often = np.unique(token, return_inverse=True, return_counts=True)
                rank = np.empty(len(words), np.int64)
                by = np.argsort(-often, kind="stable")
                rank[by] = np.arange(len(by))
                which = rank[which]
                training = np.repeat(np.fromiter((not held_out(i) for i in ids), bool, len(ids)), length)
                trained = np.bincount(which[training], minlength=len(words))
                blobs = [pa.array([squeezed(c)], pa.binary()) for c in (length, words[by].view(np.uint64), trained, which)]
                yield pa.RecordBatch.from_arrays([pa.array([base + n], pa.int64()), pa.array([ids], pa.list_(pa.int64())), *blobs], ["batch", "doc_id", "length", "words", "trained", "tokens"])
                n += 1
        digests.cache_clear()  # the worker is used again by later steps, which need the memory

    return docs.mapInArrow(run, BATCH)


# --- files with named arrays, mapped


def filed(arrays: dict[str, np.ndarray | EliasFano]) -> bytes:
    meta, flat = {}, {}
    for k, a in arrays.items():
        if isinstance(a, EliasFano):
            meta[k] = [a.n, a.width]
            flat |= {f"{k}.{x}": getattr(a, x) for x in ("low", "high", "ones")}
        else:
            flat[k] = a
    return laid_out(flat, meta)


def sequence(file: Filed, k: str) -> EliasFano:
    return EliasFano(*file.meta[k], *(file.array(f"{k}.{x}") for x in ("low", "high", "ones")))


# --- level one: the words


def counted_words(tokens: DataFrame, files: int, parts: int) -> DataFrame:
    """file, words (sorted digests), counts: one row for each file that has words. Words of training texts only."""

    def deal(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            for words, trained in zip(b.column("words").to_pylist(), b.column("trained").to_pylist(), strict=True):
                (h,), (n,) = unsqueezed(words), unsqueezed(trained)
                h, n = h[n > 0].astype(np.uint64), n[n > 0]
                by = np.argsort(h)
                h, n = h[by], n[by]
                cuts = np.searchsorted(file_of(h, files), np.arange(files + 1))
                some = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([squeezed(np.diff(h[cuts[k] : cuts[k + 1]], prepend=np.uint64(0)), n[cuts[k] : cuts[k + 1]]) for k in some], pa.binary())], ["file", "words"])

    def added(held: list) -> tuple[np.ndarray, np.ndarray]:
        h, n = (np.concatenate(c) for c in zip(*held, strict=True))
        by = np.argsort(h)
        h = h[by]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        return h[first], np.add.reduceat(n[by].astype(np.int64), first)

    def total(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(k: int, held: list) -> pa.RecordBatch:
            h, n = added(held)
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([squeezed(np.diff(h, prepend=np.uint64(0)), n)], pa.binary()), pa.array([n], pa.list_(pa.int64()))], ["file", "words", "n"])

        held, size, now = [], 0, None
        for b in found:
            for k, words in zip(b.column("file").to_pylist(), b.column("words").to_pylist(), strict=True):
                if held and k != now:
                    yield done(now, held)
                    held, size = [], 0
                now = k
                gaps, n = unsqueezed(words)
                held.append((np.cumsum(gaps.astype(np.uint64), dtype=np.uint64), n))
                size += len(n)
                if size > HELD_WORDS and len(held) > 1:  # memory: the different words of one file
                    held = [added(held)]
                    size = len(held[0][0]) // 2
        if held:
            yield done(now, held)

    return tokens.select("words", "trained").mapInArrow(deal, "file int, words binary").repartition(parts, "file").sortWithinPartitions("file").mapInArrow(total, "file int, words binary, n array<long>")


class Words:
    """Level one. bands: p1's quantised logarithm and the first number of the words that have it (65,536 at most)."""

    def __init__(self, path: str, files: int, n_words: int, n_tokens: int, bands: tuple[np.ndarray, np.ndarray]):
        self.path, self.files, self.n_words, self.n_tokens, self.bands = path, files, n_words, n_tokens, bands
        self.mass = n_tokens + n_words + 1
        #: Numbers of the beginning of a text, and of words that training texts do not have.
        self.begin, self.unknown = n_words, n_words + 1

    def found(self, h: np.ndarray, maps: Mapped) -> tuple[np.ndarray, np.ndarray]:
        """(number, count) of each digest (unsigned, sorted); count 0 where it is not known."""
        number, count = np.full(len(h), self.unknown, np.int64), np.zeros(len(h), np.int64)
        if not self.n_words:
            return number, count
        cuts = np.searchsorted(file_of(h, self.files), np.arange(self.files + 1))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = cuts[k], cuts[k + 1]
            own, c, n = map(maps[f"{self.path}/{k}.words"].array, ("h", "c", "number"))
            if len(own):
                at = np.searchsorted(own, h[a:b])
                at[at == len(own)] = 0
                ok = np.flatnonzero(own[at] == h[a:b])
                number[a + ok], count[a + ok] = n[at[ok]], c[at[ok]]
        return number, count

    def p1(self, number: np.ndarray) -> np.ndarray:
        """Quantised, by number."""
        level, first = self.bands
        known = level[np.searchsorted(first, number, "right") - 1] if len(first) else np.zeros(len(number), "<u2")
        return np.where(number < self.n_words, known, quantised(np.log10(1 / self.mass))).astype(np.int64)


def band(n: np.ndarray, mass: int) -> np.ndarray:
    return quantised(np.log10((n + 1) / mass))


def words_level(tokens: DataFrame, files: int, parts: int, hot_tokens: int) -> tuple[Words, dict[int, int]]:
    """Counts the words and writes the files of level one. Numbers go by p1, so that p1 can be told from the number.
    Also: the numbers of frequent histories (with the beginning of texts), and their counts; N / hot_tokens at most."""
    spark = tokens.sparkSession
    table = stored(counted_words(tokens, files, parts), "words")
    n_words, n_tokens = table.agg(F.sum(F.size("n")), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    n_words, n_tokens = n_words or 0, n_tokens or 0
    mass, path = n_tokens + n_words + 1, scratch(spark, "words")

    def per_file(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            for k, n in zip(b.column("file").to_pylist(), b.column("n"), strict=True):
                own, of = np.unique(band(n.values.to_numpy(), mass), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k, np.int32)), pa.array(own.astype(np.int32)), pa.array(of)], ["file", "band", "k"])

    per = stored(table.select("file", "n").mapInArrow(per_file, "file int, band int, k long"), "bands")
    bands = per.groupBy("band").agg(F.sum("k").alias("k")).orderBy("band").collect()  # 65,536 rows at most
    level = np.array([r["band"] for r in bands], np.int64)
    first = np.cumsum([0, *(r["k"] for r in bands)])[:-1].astype(np.int64)
    # A band's words before each file: over blocks of files, then within each block.
    so_far = lambda x, *by: F.coalesce(F.sum(x).over(Window.partitionBy(*by).orderBy("file" if len(by) > 1 else "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_block = per.withColumn("block", F.floor(F.col("file") / 16))
    blocks = per_block.groupBy("band", "block").agg(F.sum("k").alias("all")).withColumn("ahead", so_far("all", "band"))
    within = per_block.withColumn("before", so_far("k", "band", "block")).join(blocks, ["band", "block"])
    within = within.groupBy("file").agg(F.collect_list(F.struct("band", (F.col("before") + F.col("ahead")).alias("before"))).alias("starts"))

    def write(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = []
        for b in found:
            for k, words, n, starts in zip(*(b.column(c).to_pylist() for c in ("file", "words", "n", "starts")), strict=True):
                gaps = unsqueezed(words)[0]
                h, n = np.cumsum(gaps.astype(np.uint64), dtype=np.uint64), np.array(n, np.int64)
                own = np.searchsorted(level, band(n, mass))
                offset = np.zeros(len(level), np.int64)
                for x in starts:
                    offset[np.searchsorted(level, x["band"])] = x["before"]
                by = np.argsort(own, kind="stable")
                edge = np.flatnonzero(np.diff(own[by], prepend=-1))
                nth = np.empty(len(h), np.int64)
                nth[by] = np.arange(len(h)) - np.repeat(edge, np.diff(edge, append=len(h)))
                number = first[own] + offset[own] + nth
                put_file(f"{path}/{k}.words", filed({"h": h, "c": n, "number": number}))
                many = np.flatnonzero(n >= hot_tokens)
                hot += zip(np.where(h[many] == END, n_words, number[many]).tolist(), n[many].tolist(), strict=True)  # a text has one END and one beginning
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in hot], pa.int64()) for k in (0, 1)], ["number", "n"])

    hot = {r["number"]: r["n"] for r in table.join(within, "file").mapInArrow(write, "number long, n long").collect()}
    present = {r["file"] for r in table.select("file").collect()}  # MAX_FILES at most
    for k in set(range(files)) - present if n_words else ():
        put_file(f"{path}/{k}.words", filed({"h": np.empty(0, np.uint64), "c": np.empty(0, np.int64), "number": np.empty(0, np.int64)}))
    discard(table)
    discard(per)
    return Words(path, files, n_words, n_tokens, (level, first)), hot


# --- successors of frequent histories


class Successors:
    """How often each word follows each of some histories. keys: the histories' (sorted), totals: their tokens,
    kinds: their different successors. A history's place among the keys stands for it."""

    def __init__(self, path: str, files: int, slot_tokens: int, keys: np.ndarray, totals: np.ndarray):
        self.path, self.files, self.slot_tokens, self.keys, self.totals = path, files, slot_tokens, keys, totals
        self.kinds, self.there = np.zeros(len(keys), np.int64), np.zeros(files, bool)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def file(self, g: np.ndarray, w: np.ndarray) -> np.ndarray:
        """A history's successors are in as many files as it has slots."""
        slot = w % (1 + self.totals[g] // self.slot_tokens)
        return file_of(mixed(g, slot), self.files)

    def counts(self, g: np.ndarray, w: np.ndarray, maps: Mapped) -> np.ndarray:
        """How often w follows the histories at these places."""
        key, back = np.unique(pair_key(g, w), return_inverse=True)
        g, w, n = key >> 40, key & (1 << 40) - 1, np.zeros(len(key), np.int64)
        file = self.file(g, w)
        by = np.argsort(file, kind="stable")
        cuts = np.append(heads(file[by]), len(by)) if len(by) else np.zeros(1, np.int64)
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            x, k = by[a:z], file[by[a]]
            if self.there[k]:
                held = maps[f"{self.path}/{k}.next"]
                context = held.array("context")
                at = np.minimum(np.searchsorted(context, g[x]), len(context) - 1)
                ok = np.flatnonzero(context[at] == g[x])
                if len(ok):
                    place, _ = Level(held, "next").search(at[ok], w[x[ok]])
                    n[x[ok]] = np.where(place >= 0, held.array("n")[place], 0)
        return n[back]


def successors(pairs: DataFrame, level: Successors, parts: int, hot_tokens: int) -> dict[tuple[int, int], int]:
    """Writes a level's files. pairs: file, pairs (place of the history, word, count: squeezed). Returns the successors
    (place, word) that follow hot_tokens times or more."""
    path = level.path

    def added(held: list) -> list[np.ndarray]:
        g, w, n = (np.concatenate(c).astype(np.int64) for c in zip(*held, strict=True))
        by = np.lexsort((w, g))
        edge = heads(g[by], w[by])
        return [g[by][edge], w[by][edge], np.add.reduceat(n[by], edge)]

    def done(k: int, held: list) -> list[tuple[int, int, int]]:
        """Rows: (k, -2, 0); (place, -1, number of successors here) for each history; (place, word, count) for those that are hot."""
        g, w, n = added(held)
        own = heads(g)
        size = np.diff(own, append=len(g))
        put_file(f"{path}/{k}.next", filed({"context": g[own], **Level.arrays("next", np.repeat(np.arange(len(own)), size), w, len(own)), "n": n}))
        many = np.flatnonzero(n >= hot_tokens)
        return [(k, -2, 0), *((x, -1, y) for x, y in zip(g[own].tolist(), size.tolist(), strict=True)), *zip(g[many].tolist(), w[many].tolist(), n[many].tolist(), strict=True)]

    def total(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, now, rows = [], 0, None, []
        for b in found:
            for k, data in zip(b.column("file").to_pylist(), b.column("pairs").to_pylist(), strict=True):
                if held and k != now:
                    rows += done(now, held)
                    held, size = [], 0
                now = k
                held.append(unsqueezed(data))
                size += len(held[-1][0])
                if size > HELD_WORDS and len(held) > 1:  # memory: the different successors of one file
                    held = [added(held)]
                    size = len(held[0][0]) // 2
        if held:
            rows += done(now, held)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["g", "w", "n"])

    rows = pairs.repartition(parts, "file").sortWithinPartitions("file").mapInArrow(total, "g long, w long, n long")
    hot = {}
    for r in rows.collect():  # N / slot_tokens rows for each level, and some for each file, at most
        if r["w"] == -2:
            level.there[r["g"]] = True
        elif r["w"] == -1:
            level.kinds[r["g"]] += r["n"]
        else:
            hot[r["g"], r["w"]] = r["n"]
    return hot


def pair_key(g: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A history's place and a word's number as one; negative if there is no such history."""
    return g << 40 | w


def numbered(h: np.ndarray, words: Words, maps: Mapped) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, counts) of a batch's words, and behind them of the beginning of a text."""
    number, count = np.empty(len(h) + 1, np.int64), np.zeros(len(h) + 1, np.int64)
    by = np.argsort(h)
    number[by], count[by] = words.found(h[by], maps)
    number[-1] = words.begin
    return number, count


def histories(token: np.ndarray, length: np.ndarray, begin: int, n: int) -> list[np.ndarray]:
    """The tokens, and the words one, two, to n places before them, as far as the text goes."""
    begins, out = np.cumsum(length) - length, [token]
    for k in range(1, n + 1):
        back = np.full(len(token), begin, np.int64)
        back[k:] = token[:-k]
        for j in range(k):
            back[begins[length > j] + j] = begin
        out.append(back)
    return out


def following(tokens: DataFrame, words: Words, single: Successors, double: Successors | None = None) -> DataFrame:
    """The training tokens after the histories of `single`, or of `double`: file, pairs (place, word, count); a row of each batch for each file."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps, level = Mapped(), double or single
        for b in found:
            for doc_id, length, h, token in zip(*(b.column(c).to_pylist() for c in ("doc_id", "length", "words", "tokens")), strict=True):
                (length,), (h,), (token,) = unsqueezed(length), unsqueezed(h), unsqueezed(token)
                length = length.astype(np.int64)
                number, _ = numbered(h.astype(np.uint64), words, maps)
                w, v, u = histories(token, length, len(h), 2)
                g = single.places(number)
                g = double.places(pair_key(g[u], number[v])) if double else g[v]
                own = np.flatnonzero((g >= 0) & np.repeat(np.fromiter((not held_out(i) for i in doc_id), bool, len(doc_id)), length))
                key, n = np.unique(pair_key(g[own], number[w[own]]), return_counts=True)
                g, w = key >> 40, key & (1 << 40) - 1
                file = level.file(g, w)
                by = np.argsort(file, kind="stable")
                cuts = np.append(heads(file[by]), len(by)) if len(by) else np.zeros(1, np.int64)
                rows = [by[a:z] for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([file[x[0]] for x in rows], pa.int32()), pa.array([squeezed(g[x], w[x], n[x]) for x in rows], pa.binary())], ["file", "pairs"])

    return tokens.mapInArrow(run, "file int, pairs binary")


def frequent_histories(tokens: DataFrame, words: Words, hot: dict[int, int], path: str, parts: int, hot_tokens: int, shard_tokens: int) -> tuple[Successors, Successors]:
    """The levels of words, and of pairs of words, that are frequent histories. hot: the words' numbers and counts."""

    def level(name: str, found: dict[int, int], *before: Successors) -> tuple[Successors, dict]:
        keys = np.array(sorted(found), np.int64)
        totals = np.array([found[k] for k in keys.tolist()], np.int64)
        out = Successors(f"{path}/{name}", min(MAX_FILES, max(parts, -(-int(totals.sum()) // shard_tokens))), hot_tokens, keys, totals)
        return out, successors(following(tokens, words, *before, out), out, parts, hot_tokens) if found else {}

    single, pairs = level("single", hot)
    double, _ = level("double", {g << 40 | w: n for (g, w), n in pairs.items()}, single)
    return single, double


def after_one(g: np.ndarray, w: np.ndarray, words: Words, single: Successors, maps: Mapped) -> tuple[np.ndarray, np.ndarray]:
    """(p2, its quantised logarithm) of words after the frequent ones at g."""
    n, c = single.counts(g, w, maps), single.totals[g]
    b, p1 = DISCOUNT * single.kinds[g] / c, words.p1(w)
    p = np.where(n > 0, (n - DISCOUNT) / c, 0) + b * 10.0 ** restored(p1)
    return p, np.where(n > 0, quantised(np.log10(p)).astype(np.int64), quantised(np.log10(b)) + p1)


def after_two(g: np.ndarray, of: np.ndarray, w: np.ndarray, words: Words, single: Successors, double: Successors, maps: Mapped) -> np.ndarray:
    """Quantised logarithms of p3 of words after the frequent pairs at g, whose last words are at `of` in `single`."""
    key, back = np.unique(pair_key(g, w), return_inverse=True)
    first = np.empty(len(key), np.int64)
    first[back] = of
    g, w = key >> 40, key & (1 << 40) - 1
    p2, q2 = after_one(first, w, words, single, maps)
    n, c = double.counts(g, w, maps), double.totals[g]
    b = DISCOUNT * double.kinds[g] / c
    p = np.where(n > 0, (n - DISCOUNT) / c, 0) + b * p2
    return np.where(n > 0, quantised(np.log10(p)).astype(np.int64), quantised(np.log10(b)) + q2)[back]


# --- the trie of a shard


class Level:
    """Children of contexts: `to` points to the first of each, `kid` holds them, each context's above the last of the one before."""

    @staticmethod
    def arrays(name: str, parent: np.ndarray, kid: np.ndarray, parents: int) -> dict[str, EliasFano]:
        """parent, kid: sorted by both; every parent has children."""
        to = np.searchsorted(parent, np.arange(parents + 1))
        base = np.concatenate(([0], np.cumsum(kid[to[1:] - 1])))[:-1] if parents else np.empty(0, np.int64)
        return {f"{name}_to": EliasFano.build(to.astype(np.int64)), f"{name}_kid": EliasFano.build((kid + base[parent]).astype(np.int64))}

    def __init__(self, file: Filed, name: str):
        self.to, self.kid = sequence(file, f"{name}_to"), sequence(file, f"{name}_kid")

    def search(self, parent: np.ndarray, kid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each kid among all children, or -1; its parent's first child). parent: rising, all of them there."""
        edge = np.flatnonzero(np.concatenate(([True], parent[1:] != parent[:-1])))
        of = np.repeat(np.arange(len(edge)), np.diff(edge, append=len(parent)))
        begin, end = self.to.get(parent[edge]), self.to.get(parent[edge] + 1)
        base = np.zeros(len(edge), np.int64)
        some = np.flatnonzero(begin > 0)
        if len(some):
            base[some] = self.kid.get(begin[some] - 1)
        target = kid + base[of]
        at = self.kid.successor(target, begin[of], end[of])
        place = np.full(len(kid), -1, np.int64)
        there = np.flatnonzero(at < end[of])
        there = there[self.kid.get(at[there]) == target[there]]
        place[there] = at[there]
        return place, begin[of]


def heads(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def shard_file(context: np.ndarray, u: np.ndarray, w: np.ndarray, n: np.ndarray, words: Words, single: Successors, maps: Mapped) -> bytes:
    """The trie of the trigrams (u, context, w), sorted by context, u and w, seen n times each. A frequent word's contexts take p2 from `single`."""
    own = heads(context)
    c = np.repeat(np.arange(len(own)), np.diff(own, append=len(context)))
    c1 = np.add.reduceat(n, own)
    # Successors of the context, with all words before it.
    by = np.argsort(c << 32 | w) if words.n_words < 1 << 32 else np.lexsort((w, c))
    pair = heads(c[by], w[by])
    pc, pw, n2 = c[by][pair], w[by][pair], np.add.reduceat(n[by], pair)
    p1 = 10.0 ** restored(words.p1(pw))
    b1 = DISCOUNT * np.bincount(pc, minlength=len(own)) / c1
    p2 = (n2 - DISCOUNT) / c1[pc] + b1[pc] * p1
    g = single.places(context[own] >> 24)
    some = np.flatnonzero(g[pc] >= 0)
    if len(some):
        p2[some], _ = after_one(g[pc[some]], pw[some], words, single, maps)
    # Words before the context, and successors of both, by their places among the context's successors.
    before = heads(c, u)
    c2 = np.add.reduceat(n, before)
    of = np.repeat(np.arange(len(before)), np.diff(before, append=len(c)))
    place = np.empty(len(w), np.int64)
    place[by] = np.repeat(np.arange(len(pair)), np.diff(pair, append=len(w)))
    b2 = DISCOUNT * np.diff(before, append=len(c)) / c2
    p3 = (n - DISCOUNT) / c2[of] + b2[of] * p2[place]
    first = np.searchsorted(pc, np.arange(len(own)))
    return filed({
        "context": context[own], "weight1": quantised(np.log10(b1)), **Level.arrays("next", pc, pw, len(own)), "p2": quantised(np.log10(p2)),
        **Level.arrays("before", c[before], u[before], len(own)), "weight2": quantised(np.log10(b2)), **Level.arrays("both", of, place - first[c], len(before)), "p3": quantised(np.log10(p3)),
    })


class Trie:
    def __init__(self, file: Filed):
        self.context, self.weight1, self.p2, self.weight2, self.p3 = map(file.array, ("context", "weight1", "p2", "weight2", "p3"))
        self.next, self.before, self.both = (Level(file, x) for x in ("next", "before", "both"))

    def logs(self, context: np.ndarray, u: np.ndarray, w: np.ndarray, p1: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Quantised logarithms of p(w | u, context); all sorted by context, u and w. p1: w's own. low: those of p2 of frequent words, else -1."""
        out = np.where(low >= 0, low, p1)
        if not len(self.context) or not len(out):
            return out
        edge = heads(context)
        at = np.searchsorted(self.context, context[edge])
        at[at == len(self.context)] = 0
        at = np.where(self.context[at] == context[edge], at, -1)
        c = np.repeat(at, np.diff(edge, append=len(context)))
        rows = np.flatnonzero(c >= 0)
        if not len(rows):
            return out
        c, u, w = c[rows], u[rows], w[rows]
        # Each different pair (context, w) once.
        by = np.argsort(c << 32 | w) if int(w.max()) < 1 << 32 else np.lexsort((w, c))
        pair = heads(c[by], w[by])
        place, first = self.next.search(c[by][pair], w[by][pair])
        again = np.diff(pair, append=len(by))
        lower, rank = np.empty(len(by), np.int64), np.empty(len(by), np.int64)
        q = np.where(place >= 0, self.p2[place], self.weight1[c[by][pair]] + p1[rows][by][pair].astype(np.int64))
        lower[by] = np.repeat(q, again)
        lower = np.where(low[rows] >= 0, low[rows], lower)
        rank[by] = np.repeat(np.where(place >= 0, place - first, -1), again)
        both = heads(c, u)
        place, _ = self.before.search(c[both], u[both])
        of = np.repeat(place, np.diff(both, append=len(c)))
        q = lower + np.where(of >= 0, self.weight2[of], 0)
        some = np.flatnonzero((of >= 0) & (rank >= 0))
        if len(some):
            place, _ = self.both.search(of[some], rank[some])
            hit = place >= 0
            q[some[hit]] = self.p3[place[hit]]
        out[rows] = q
        return out


# --- trigrams to shards, sums back

TO_SHARD = "shard int, batch long, trigrams binary"


def dealt(tokens: DataFrame, words: Words, single: Successors, double: Successors, shards: int, hot_tokens: int, class_tokens: int | None) -> DataFrame:
    """Each batch's trigrams for each shard; and (shard -1) a row of each batch for itself: what needs no shard."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = Mapped()
        for b in found:
            for batch, doc_id, length, h, token in zip(*(b.column(c).to_pylist() for c in ("batch", "doc_id", "length", "words", "tokens")), strict=True):
                (length,), (h,), (token,) = unsqueezed(length), unsqueezed(h), unsqueezed(token)
                h, length = h.astype(np.uint64), length.astype(np.int64)
                number, count = numbered(h, words, maps)
                h = np.append(h, np.uint64(BEGIN))
                begins = np.cumsum(length) - length
                doc = np.repeat(np.arange(len(length)), length)
                known = np.add.reduceat((count > 0)[token].astype(np.int64), begins)
                base = np.add.reduceat(np.log10((count + 1) / words.mass)[token], begins)
                p1 = words.p1(number)

                w, v, u, t = histories(token, length, len(h) - 1, 3)
                sums = np.zeros(len(length), np.int64)
                own = (count > 0)[v]  # else p1 stands: the first token, and after unknown words
                alone = np.flatnonzero(~own)
                sums += np.bincount(doc[alone], p1[token[alone]], minlength=len(length)).astype(np.int64)
                if len(double.keys):
                    g = single.places(number)
                    pair = double.places(pair_key(g[u], number[v]))
                    some = np.flatnonzero(pair >= 0)
                    q = after_two(pair[some], g[v[some]], number[w[some]], words, single, double, maps)
                    sums += np.bincount(doc[some], q, minlength=len(length)).astype(np.int64)
                    own[some] = False
                own = np.flatnonzero(own)
                w, v, u, t, doc = w[own], v[own], u[own], t[own], doc[own]
                kinds = 1 + count // (class_tokens or hot_tokens)
                cls = np.zeros(len(v), np.int64)
                many = np.flatnonzero(kinds[v] > 1)
                if len(many):
                    far = np.where(count[u[many]] >= class_tokens, h[t[many]], np.uint64(0)) if class_tokens else np.zeros(1, np.uint64)
                    cls[many] = mixed(h[u[many]], far) % kinds[v[many]].astype(np.uint64)
                context = number[v] << 24 | cls
                shard = (mixed(context.view(np.uint64), np.uint64(0)[None]) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
                by = np.argsort(context, kind="stable")
                by = by[np.argsort(shard[by].astype(np.uint16 if shards <= 1 << 16 else np.uint32), kind="stable")]
                shard, context, doc = shard[by], context[by], doc[by]
                u, w = number[u[by]], number[w[by]]
                training = np.fromiter((not held_out(i) for i in doc_id), np.int64, len(doc_id))
                doc = doc << 1 | training[doc]
                cuts = np.append(heads(shard), len(shard)) if len(shard) else np.zeros(1, np.int64)
                lists = []
                for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    edge = heads(context[a:z])
                    lists.append(squeezed(context[a:z][edge], np.diff(edge, append=z - a), u[a:z], w[a:z], doc[a:z]))
                head = squeezed(length, known, sums, base.view(np.uint64))
                kinds = [-1, *shard[cuts[:-1]].astype(np.int64).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array([batch] * len(kinds), pa.int64()), pa.array([head, *lists], pa.binary())], ["shard", "batch", "trigrams"])

    return tokens.mapInArrow(run, TO_SHARD)


def summed(key: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different keys, sorted; their sums)."""
    by = np.argsort(key, kind="stable")
    key = key[by]
    edge = heads(key)
    return key[edge], np.add.reduceat(q[by], edge)


def context_cuts(parts: list[list[np.ndarray]], tokens: int) -> np.ndarray:
    """Contexts that begin pieces of about so many trigrams, or one context with more; and an end. parts: contexts (sorted), trigrams of each, and more."""
    context, n = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    by = np.argsort(context)
    context, n = context[by].astype(np.uint64), n[by].astype(np.int64)
    return np.append(np.unique(context[heads((np.cumsum(n) - n) // tokens)]), context[-1] + np.uint64(1))


def answered(lists: DataFrame, words: Words, single: Successors, path: str, keep: bool, piece_tokens: int = PIECE_TOKENS) -> DataFrame:
    """batch, shard, sums: for each batch a row of (its texts' places, sums of quantised logarithms) from each shard. lists: a shard's together.
    A shard is worked off in pieces, by contexts: memory is that of its compact lists, and of one piece or context."""

    def piece(name: str, parts: list[list[np.ndarray]], maps: Mapped) -> tuple[np.ndarray, np.ndarray]:
        """(part << 32 | text's place, sorted; sums) of contexts that are nowhere else; their trie is a file of its own."""
        context = np.concatenate([np.repeat(p[0].astype(np.int64), p[1]) for p in parts])
        u, w, doc = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in (2, 3, 4))
        doc |= np.repeat(np.arange(len(parts)), [len(p[2]) for p in parts]) << 33
        # Contexts by their order here: (context, u) then fits one number if words do.
        different, c = np.unique(context, return_inverse=True)
        if words.unknown < 1 << 32:
            by = np.argsort(c << 32 | u)
            key = np.zeros(len(by), np.int64)
            key[1:] = np.cumsum((c[by][1:] != c[by][:-1]) | (u[by][1:] != u[by][:-1]))
            by = by[np.argsort(key << 32 | w[by])]
        else:
            by = np.lexsort((w, u, c))
        c, u, w, doc = c[by], u[by], w[by], doc[by]
        context = different[c]
        edge = heads(c, u, w)
        n = np.add.reduceat(doc & 1, edge)
        seen = edge[n > 0]
        g, low = single.places(context[edge] >> 24), np.full(len(edge), -1, np.int64)
        some = np.flatnonzero(g >= 0)
        if len(some):
            _, low[some] = after_one(g[some], w[edge[some]], words, single, maps)
        if len(seen):
            put_file(name, shard_file(context[seen], u[seen], w[seen], n[n > 0], words, single, maps))
            q = Trie(mapped(name)).logs(context[edge], u[edge], w[edge], words.p1(w[edge]), low)
        else:
            q = np.where(low >= 0, low, words.p1(w[edge]))
        if not keep and len(seen):
            drop_file(name)
        return summed(doc >> 1, np.repeat(q, np.diff(edge, append=len(c))))

    def one(shard: int, batch: list[int], held: list[bytes], maps: Mapped) -> pa.RecordBatch:
        parts = [unsqueezed(x) for x in held]
        held.clear()
        cuts = context_cuts(parts, piece_tokens)
        at = [np.searchsorted(p[0], cuts) for p in parts]
        to = [np.concatenate(([0], np.cumsum(p[1], dtype=np.int64)))[a] for p, a in zip(parts, at, strict=True)]
        found = []
        for k in range(len(cuts) - 1):
            own = [[*(x[a[k] : a[k + 1]] for x in p[:2]), *(x[t[k] : t[k + 1]] for x in p[2:])] for p, a, t in zip(parts, at, to, strict=True)]
            found.append(piece(f"{path}/{shard}.{k}.trie", own, maps))
        # Sums of all pieces, for some batches at a time.
        ahead = np.cumsum([0, *(len(p[2]) for p in parts)])[:-1] // piece_tokens
        edges = [*heads(ahead).tolist(), len(parts)]
        del parts, own
        sums = []
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            some = [(key[x:y], q[x:y]) for key, q in found for x, y in [np.searchsorted(key, [a << 32, z << 32])]]
            key, total = summed(*(np.concatenate(x) for x in zip(*some, strict=True)))
            ends = np.searchsorted(key >> 32, np.arange(a, z + 1))
            sums += [squeezed(key[x:y] & 0xFFFFFFFF, total[x:y]) for x, y in zip(ends[:-1], ends[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(batch, pa.int64()), pa.array([shard] * len(batch), pa.int32()), pa.array(sums, pa.binary())], ["batch", "shard", "sums"])

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, held, now, maps = [], [], None, Mapped()
        for b in found:
            for shard, of, data in zip(*(b.column(c).to_pylist() for c in ("shard", "batch", "trigrams")), strict=True):
                if shard < 0:
                    yield pa.RecordBatch.from_arrays([pa.array([of], pa.int64()), pa.array([-1], pa.int32()), pa.array([data], pa.binary())], ["batch", "shard", "sums"])
                    continue
                if held and shard != now:
                    yield one(now, batch, held, maps)
                    batch, held = [], []
                now = shard
                batch.append(of)
                held.append(data)
        if held:
            yield one(now, batch, held, maps)

    return lists.mapInArrow(run, "batch long, shard int, sums binary")


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def lm_scores(docs: DataFrame, model: str | None = None, class_tokens: int | None = None, shard_tokens: int = SHARD_TOKENS, hot_tokens: int = HOT_TOKENS) -> DataFrame:
    """One row for each row of docs (doc_id, text): SCHEMA; scores are log10 probabilities. model: a folder that keeps the trie's files.

    class_tokens, if given, asks for another model, in which a word v has 1 + c(v) // class_tokens contexts, chosen by
    the word u before it, and the word before that if u is as frequent; scores depend on it, and so on the input's size.

    Null and empty texts are one END token; a null doc_id is in training; repeated rows count, and are
    scored, each; without training texts every probability is 1 (N = V = 0); an empty table gives an empty
    result; other columns are ignored. Memory: a batch of CHUNK_CHARS characters or one longer text in the first
    steps, a shard's compact lists and the trigrams of one piece, or of one context, in the last.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tokens = stored(tokenised(doc_text(docs)), "tokens")
    words, hot = words_level(tokens, min(MAX_FILES, parts), parts, hot_tokens)
    shards = max(1, -(-words.n_tokens // shard_tokens))
    path = model or scratch(spark, "trie")
    single, double = frequent_histories(tokens, words, {} if class_tokens else hot, path, parts, hot_tokens, shard_tokens)
    lists = dealt(tokens, words, single, double, shards, hot_tokens, class_tokens)
    n = max(parts, min(shards, 1 << 15))
    to = F.pmod(F.when(F.col("shard") < 0, F.xxhash64("batch")).otherwise(F.col("shard")), F.lit(n)).cast("int")
    lists = lists.repartitionById(n, to).sortWithinPartitions("shard", "batch")
    sums = stored(answered(lists, words, single, path, model is not None), "sums")
    ids = stored(tokens.select("batch", "doc_id"), "ids")
    discard(tokens)
    if model is None:
        removed(spark, words.path)
        removed(spark, path)
    back = sums.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("shard", "sums"))).alias("sums")).join(ids, "batch")
    n_tokens = words.n_tokens

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            for doc_id, (head, *others) in zip(b.column("doc_id").to_pylist(), b.column("sums").to_pylist(), strict=True):
                length, known, q, base = unsqueezed(head["sums"])
                q = q.astype(np.int64)
                for x in others:
                    place, more = unsqueezed(x["sums"])
                    q[place] += more.astype(np.int64)
                columns = (doc_id, [held_out(i) for i in doc_id], length.astype(np.int64), known.astype(np.int64), np.full(len(q), n_tokens), base.astype("<u8").view("<f8"), restored(q))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2), strict=True)], NAMES)

    return back.select("doc_id", "sums").mapInArrow(run, SCHEMA)
