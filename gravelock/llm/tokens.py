"""10, Token counts: a tokenizer compiled to a deterministic transducer whose transitions carry emitted-token counts.

`transducer.Transducer` is the machine: states and annotated transitions over characters, compiled from the tokenizer
file's merges when first reached; the tokenizer's library takes no part. ASCII white space leads every state back to the
boundary state and emits what the state still owes, so a path from boundary to boundary, a word, has one count,
which `WordCounts` keeps for words that come again; so does the end of a piece of the split pattern, and `PieceCounts`
keeps the counts of pieces, which come again in other words.

Because every entry state is forgotten at the first white space, the state map of any chunk of text is the
small monoid element (head, emitted, tail); `compose` is associative, so the maps of a text's chunks are
combined by a parallel prefix scan (`scan`), and a chunk may be cut anywhere, also inside a word or a character.
Head and tail are the stretches at the chunk's ends that a word across the cut needs; the words within are counted.

`WordTokens` gives ids instead of counts, for packing, by the library's own merges.
"""

from __future__ import annotations

import gc
import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gravelock.llm.common import batches, doc_text
from gravelock.llm.transducer import Transducer, byte_alphabet

#: Compiled transitions, and word pieces, kept in a Python worker: in two generations, of which the older goes when
#: the younger is full, so that frequent words stay (results do not change).
MAX_COMPILED, MAX_PIECES = 250_000, 150_000
CHUNK_BYTES = 1 << 16
#: Beyond this, a word is tokenized without being kept.
MAX_WORD = 256
#: The split pattern of the tokenizer file (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for visible ASCII in lower case, and what that is.
ASCII_SPLIT = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+").findall
VISIBLE = re.compile(rb"[!-~]+").fullmatch
#: Below U+0180 nothing composes and lower-casing is one to one, but for U+0130; U+0080 to U+00A0 has white space.
PLAIN = re.compile("[!-~\xa1-\xac\xae-\u012f\u0131-\u017f]+").fullmatch


class PieceCounts(dict):
    """piece of the split pattern (UTF-8, lower case) -> its number of tokens, by the transducer."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self.machine, self.old = machine, {}

    def __missing__(self, piece: bytes) -> int:
        n = self.old.get(piece)
        if n is None:
            n = self.machine.piece(piece)
        if len(self) >= MAX_PIECES:
            self.old = dict(self)
            self.clear()
        self[piece] = n
        return n


class WordCounts(dict):
    """word (UTF-8, no ASCII white space) -> its number of tokens, by the transducer."""

    def __init__(self, path: str):
        super().__init__()
        self.machine, self.old = Transducer(path), {}
        self.piece = PieceCounts(self.machine).__getitem__
        self.special = re.compile(b"|".join(re.escape(t.encode()) for t in self.machine.merges.specials) or b"(?!)").search
        self.split = regex.compile(SPLIT).findall

    def counted(self, word: bytes) -> int:
        """Piece by piece where pieces are easily told, else through the machine as it is."""
        if len(word) <= MAX_WORD and not self.special(word):
            if VISIBLE(word):
                low = word.lower()
                return self.piece(low) if low.isalpha() else sum(map(self.piece, ASCII_SPLIT(low)))
            s = word.decode()
            if PLAIN(s):
                low = s.lower()
                return self.piece(low.encode()) if s.isalpha() else sum([self.piece(p.encode()) for p in self.split(low)])
        return self.machine.count(word)

    def __missing__(self, word: bytes) -> int:
        n = self.old.get(word)
        if n is None:
            n = self.counted(word)
        if len(word) <= MAX_WORD:
            if len(self) >= MAX_COMPILED:
                self.old = dict(self)
                self.clear()
            self[word] = n
        return n


class PieceTokens(dict):
    """piece of the split pattern (UTF-8, lower case) -> its token ids, by the library's merges."""

    def __init__(self, model, n_ids: int):
        super().__init__()
        self.tokenize, self.letters, self.old = model.tokenize, byte_alphabet(), {}
        self.packed = [i.to_bytes(4, "little") for i in range(n_ids)]

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            shown = piece.decode("latin-1")
            found = self.tokenize(shown if piece.isascii() else shown.translate(self.letters))
            ids = b"".join([self.packed[t.id] for t in found])
        if len(self) >= MAX_PIECES:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class WordTokens(dict):
    """word (UTF-8, no ASCII white space) -> its token ids, as little-endian unsigned 32-bit values."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        self.special = re.compile(b"|".join(re.escape(t.encode()) for t in self.specials) or b"(?!)").search
        self.split = regex.compile(SPLIT).findall
        self.piece = PieceTokens(self.library.model, max(self.library.get_vocab().values()) + 1).__getitem__
        self.old: dict[bytes, bytes] = {}

    def compiled(self, word: bytes) -> bytes:
        if len(word) <= MAX_WORD and VISIBLE(word):
            low = word.lower()
            if low.isalpha():
                return self.piece(low)
            if not self.special(word):
                return b"".join(map(self.piece, ASCII_SPLIT(low)))
        s = word.decode()
        if len(s) > MAX_WORD or not PLAIN(s) or self.special(word):
            ids = self.library.encode(s, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        low = s.lower()
        return self.piece(low.encode()) if s.isalpha() else b"".join([self.piece(p.encode()) for p in self.split(low)])

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.compiled(word)
        if len(word) <= MAX_WORD:
            if len(self) >= MAX_COMPILED:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.encode().split()))


@lru_cache(maxsize=4)
def word_counts(path: str) -> WordCounts:
    """One machine for each Python worker, kept from task to task."""
    return WordCounts(path)


@lru_cache(maxsize=4)
def word_tokens(path: str) -> WordTokens:
    """One table for each Python worker, kept from task to task."""
    return WordTokens(path)


@dataclass(frozen=True)
class ChunkMap:
    """What a chunk does to any entry state: without a boundary it only lengthens the open word (head);
    else head closes the open word, `emitted` tokens follow, and tail is the word left open."""

    head: bytes
    emitted: int
    tail: bytes | None  # None: no boundary in the chunk


class ChunkScan:
    """`count` gives the transducer's count of a whole word, from boundary to boundary."""

    def __init__(self, count: Callable[[bytes], int]):
        self.count = count

    def chunk_map(self, chunk: bytes) -> ChunkMap:
        words = chunk.split()
        if not words:
            return ChunkMap(b"", 0, b"" if chunk else None)
        first = 0 if chunk[:1].isspace() else 1
        last = len(words) - (0 if chunk[-1:].isspace() else 1)
        if last < first:
            return ChunkMap(chunk, 0, None)
        return ChunkMap(words[0] if first else b"", sum(map(self.count, words[first:last])), words[-1] if last < len(words) else b"")

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        if a.tail is None:
            return ChunkMap(a.head + b.head, b.emitted, b.tail)
        if b.tail is None:
            return ChunkMap(a.head, a.emitted, a.tail + b.head)
        joint = a.tail + b.head
        return ChunkMap(a.head, a.emitted + (self.count(joint) if joint else 0) + b.emitted, b.tail)

    def scan(self, maps: list[ChunkMap]) -> ChunkMap:
        """The composition of all maps, by halving: the up-sweep of a parallel prefix scan."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0] if maps else ChunkMap(b"", 0, None)

    def total(self, text: bytes, chunk: int = CHUNK_BYTES) -> int:
        whole = self.scan([self.chunk_map(text[i : i + chunk]) for i in range(0, len(text), chunk)])
        return whole.emitted + sum(self.count(w) for w in (whole.head, whole.tail) if w)


def token_counts(docs: DataFrame, path: str, limit: int = 2048, chunk: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs (doc_id, text), one output row for each.

    Null and empty texts have 0 bytes and 0 tokens; a null doc_id stays null; repeated rows each get a row;
    a very long text is held whole, and its chunks' maps; an empty table gives an empty result; other columns of
    docs are ignored, whatever their names. A narrow map: nothing is shuffled, a lost task is simply run again.
    """

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ChunkScan(word_counts(path).__getitem__)
        for b, _, texts in batches(found):
            gc.disable()  # the machine's many tuples form no cycles, and need not be searched for them
            raw = [t.encode() for t in texts]
            n = [machine.total(t, chunk) for t in raw]
            gc.enable()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return doc_text(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
