"""A byte-pair tokenizer compiled to a deterministic transducer that counts tokens.

Input symbols are characters after normalising. A state holds where the machine is in the split pattern, and of the
piece it is in: its last bytes (as many as the longest token has), the last token of each of its prefixes that ends
among them, and their counts relative to the first. A transition is annotated with the number of tokens that it emits: what
lies before the kept bytes is settled as a piece grows, and a piece's rest is emitted when it ends.

That this is all a state needs follows from two properties of merge lists: an encoding is the right one if and only if
every two neighbours in it are the encoding of what they spell, and every prefix of a piece has one last token. So the
last token after another byte is the suffix that is a token and goes with the last token before it.

States are compiled when they are first reached, as in a lazily determinised automaton, and all forgotten when there are
MAX_STATES; results do not change. The last byte of a piece takes part with the end mark, so it is held back
until the next character tells whether the piece goes on.

Short pieces (`piece`) have the same states, told apart by their paths alone, with one table of transitions for all of
them; the tokens that can end at a symbol are read off the longest beginning of a token that ends there (`Endings`).
"""

from __future__ import annotations

import json
import unicodedata

#: Kept states, and pairs of tokens that are known to be neighbours or not.
MAX_STATES, MAX_PAIRS = 450_000, 1_000_000
#: Unicode white space beyond ASCII (fixed values).
SPACES = frozenset(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Contractions that are pieces of their own (fixed values): after an apostrophe that begins a piece.
SHORT, LONG = frozenset("stmd"), {"r": "e", "v": "e", "l": "l"}

#: Kinds of states: outside a piece; in letters; in other characters; a piece that is complete; after an apostrophe
#: that begins a piece; the same and the first letter of a longer contraction.
OUT, LETTERS, OTHERS, CLOSED, QUOTE, QUOTED = range(6)


def byte_alphabet() -> dict[int, str]:
    """Printable bytes stand for themselves, the others for the characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Merges:
    """Vocabulary and merge ranks of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab = frozenset(model["vocab"])
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.parts = {a + b: (a, b) for a, b in self.rank}
        self.longest = max(len(t.removesuffix(self.end)) for t in self.vocab)
        #: The longest token that ends with a symbol after another one.
        self.reach: dict[str, int] = {}
        for t in self.vocab:
            body = t.removesuffix(self.end) if len(t) > len(self.end) else t
            if len(body) > 1:
                ending = body[-2:] + t[len(body) :]
                self.reach[ending] = max(self.reach.get(ending, 0), len(body))
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.pairs: dict[tuple[str, str], bool] = {}

    def apart(self, a: str, b: str, before: float) -> bool:
        """If no merge joins the end of a with the beginning of b earlier than `before`. Both are undone, the latest
        merge first: a merge across was possible only until the merge that hid its two tokens."""
        rank, parts = self.rank, self.parts
        while True:
            across = rank.get((a, b))
            if across is not None and across < before:
                return False
            x, y = parts.get(a), parts.get(b)
            if x is None and y is None:
                return True
            if y is None or x is not None and rank[x] > rank[y]:
                a, before = x[1], rank[x]
            else:  # of equal merges the left one comes first, so here the one across would win
                b, before = y[0], rank[y] + 1

    def neighbours(self, a: str | None, b: str) -> bool:
        """If a and b (b alone, if a is none) are the encoding of what they spell."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            if a is not None:
                known = self.neighbours(None, b) and self.apart(a, b, float("inf"))
            else:
                of = self.parts.get(b)
                known = of is None or (self.neighbours(None, of[0]) and self.neighbours(None, of[1]) and self.apart(*of, self.rank[of]))
            self.pairs[a, b] = known
        return known


class Endings:
    """Nodes are the beginnings of tokens; a piece's node is the longest that ends it. Nodes are entered when first met."""

    def __init__(self, merges: Merges, letters: dict[int, str]):
        self.merges, self.letters = merges, letters
        self.names = [None, *sorted(merges.vocab)]  # token by number; 0 stands for none
        self.numbers = {t: k for k, t in enumerate(self.names)}
        bodies = {t.removesuffix(merges.end) for t in merges.vocab}
        self.begins = {b[:k] for b in bodies for k in range(len(b) + 1)}
        self.texts, self.nodes = [""], {"": 0}
        self.after: dict[int, int] = {}
        self.inner: list[list[tuple[int, int]]] = [[]]
        self.final: list[list[tuple[int, int]]] = [[]]
        self.pairs: dict[int, bool] = {}

    def follow(self, node: int, byte: int) -> int:
        """The node after another byte."""
        to = self.after.get(node << 8 | byte)
        if to is None:
            text = self.texts[node] + self.letters[byte]
            while text not in self.begins:
                text = text[1:]
            to = self.nodes.get(text)
            if to is None:
                to = self.nodes[text] = len(self.texts)
                self.texts.append(text)
                ends = [text[k:] for k in range(len(text))]
                for table, mark in ((self.inner, ""), (self.final, self.merges.end)):  # the longest first
                    table.append([(len(t), self.numbers[t + mark]) for t in ends if t + mark in self.numbers])
            self.after[node << 8 | byte] = to
        return to

    def neighbours(self, a: int, b: int) -> bool:
        """Merges.neighbours, by numbers, which keep pairs small."""
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        m, x, y = self.merges, self.names[a], self.names[b]
        known = self.pairs[a << 20 | b] = m.neighbours(None, y) and (x is None or m.apart(x, y, float("inf")))
        return known


#: (kind, held back symbol, kept symbols, last tokens and counts at the places between them)
State = tuple[int, str, str, tuple[str | None, ...], tuple[int, ...]]
START: State = (OUT, "", "", (None,), (0,))


class Transducer:
    def __init__(self, path: str):
        self.merges = Merges(path)
        self.letters = byte_alphabet()
        self.numbers: dict[State, int] = {}
        self.states: list[State] = []
        self.go: list[dict[str, tuple[int, int]]] = []
        self.rest: dict[int, int] = {}
        self.number(START)
        self.endings = Endings(self.merges, self.letters)
        self.forget_paths()

    def forget_paths(self) -> None:
        #: (state, byte) -> state within a piece; each state's node, last token and number of tokens.
        self.paths: dict[int, int] = {}
        self.at, self.last, self.sums = [0], [0], [0]

    def end_of(self, path: list[int], found: list[tuple[int, int]]) -> tuple[int, int]:
        """The last token, of those that can end after the states of path, and the number of tokens then."""
        last, pairs = self.last, self.endings.pairs
        for size, token in found:
            if size <= len(path):
                before = path[-size]
                known = pairs.get(last[before] << 20 | token)
                if known or known is None and self.endings.neighbours(last[before], token):
                    return token, self.sums[before] + 1
        raise ValueError("no token ends here")

    def piece(self, piece: bytes) -> int:
        """Tokens of one whole piece of the split pattern (lower case). Its states are kept, so for short ones only."""
        if len(self.sums) > MAX_STATES:
            self.forget_paths()
        paths, at, path, ends = self.paths, 0, [0], self.endings
        for b in piece[:-1]:
            to = paths.get(at << 8 | b)
            if to is None:
                node = ends.follow(self.at[at], b)
                token, n = self.end_of(path, ends.inner[node])
                to = paths[at << 8 | b] = len(self.sums)
                self.at.append(node)
                self.last.append(token)
                self.sums.append(n)
            path.append(to)
            at = to
        return self.end_of(path, ends.final[ends.follow(self.at[at], piece[-1])])[1]

    def number(self, state: State, known: bool = True) -> int:
        """known: another path may have led to the state before."""
        n = self.numbers.get(state) if known else None
        if n is None:
            n = len(self.states)
            if known:
                self.numbers[state] = n
            self.states.append(state)
            self.go.append({})
        return n

    def last_token(self, kept: str, lasts: tuple, counts: tuple, symbol: str) -> tuple[str, int]:
        """The last token once `symbol` follows the kept ones, and the number of tokens then."""
        m, size = self.merges, len(kept)
        vocab, pairs = m.vocab, m.pairs
        for at in range(max(0, size + 1 - m.reach.get(kept[-1:] + symbol, 1)), size + 1):  # kept symbols from here belong to it
            token = kept[at:] + symbol
            if token in vocab and (lasts[at] is not None or at == 0):
                known = pairs.get((lasts[at], token))
                if known or known is None and m.neighbours(lasts[at], token):
                    return token, counts[at] + 1
        raise ValueError(f"no token ends with {symbol!r}")

    def ended(self, state: State) -> int:
        """Tokens that are still to be emitted if the piece ends here."""
        kind, held, kept, lasts, counts = state
        if kind == OUT:
            return 0
        if kind == QUOTED:  # the apostrophe is a piece, the letter another
            return self.ended(self.begun(OTHERS, "'")) + self.ended(self.begun(LETTERS, held))
        return self.last_token(kept, lasts, counts, held + self.merges.end)[1]

    def pushed(self, state: State, kind: int, c: str) -> tuple[State, int]:
        """The state once the bytes of c belong to the piece too, and what is settled by that."""
        _, held, kept, lasts, counts = state
        emitted = 0
        for b in c.encode():
            if held:
                token, n = self.last_token(kept, lasts, counts, held)
                kept, lasts, counts = kept + held, (*lasts, token), (*counts, n)
                if len(kept) >= self.merges.longest:
                    emitted += counts[1] - counts[0]
                    kept, lasts, counts = kept[1:], lasts[1:], tuple(x - counts[1] for x in counts[1:])
            held = self.letters[b]
        return (kind, held, kept, lasts, counts), emitted

    def begun(self, kind: int, c: str) -> State:
        return self.pushed(START, kind, c)[0]

    def step(self, state: State, c: str) -> tuple[State, int]:
        """One transition: the state after c, and the tokens emitted on the way."""
        kind = state[0]
        if c in SPACES or c.isascii() and c.isspace() and not "\x1c" <= c <= "\x1f":
            return START, self.ended(state)
        category = unicodedata.category(c)[0]
        if kind == QUOTE:
            if c in SHORT:
                return self.pushed(state, CLOSED, c)
            if c in LONG:
                return (QUOTED, c, "", (None,), (0,)), 0
            kind = OTHERS
        elif kind == QUOTED:
            first = state[1]
            if c == LONG[first]:
                return self.pushed(self.begun(CLOSED, "'" + first), CLOSED, c)
            after, n = self.step(self.begun(LETTERS, first), c)
            return after, n + self.ended(self.begun(OTHERS, "'"))
        if category == "L":
            return self.pushed(state, LETTERS, c) if kind == LETTERS else (self.begun(LETTERS, c), self.ended(state))
        if category == "N":
            return self.begun(CLOSED, c), self.ended(state)
        if kind == OTHERS:
            return self.pushed(state, OTHERS, c)
        return self.begun(QUOTE if c == "'" else OTHERS, c), self.ended(state)

    def run(self, text: str) -> int:
        """Tokens of normalised text, from boundary to boundary."""
        if len(self.states) > MAX_STATES:
            self.numbers.clear()
            self.states.clear()
            self.go.clear()
            self.rest.clear()
            self.number(START)
        at, n, go = 0, 0, self.go
        for c in text:
            to = go[at].get(c)
            if to is None:
                before = self.states[at]
                state, emitted = self.step(before, c)
                # A piece that goes on, with all its bytes kept, has been reached by no other path.
                to = go[at][c] = (self.number(state, state[0] != before[0] or len(state[2]) >= self.merges.longest - 4), emitted)
            at = to[0]
            n += to[1]
        rest = self.rest.get(at)
        if rest is None:
            rest = self.rest[at] = self.ended(self.states[at])
        return n + rest

    def count(self, word: bytes) -> int:
        """Tokens of a stretch of text between ASCII white space."""
        s = word.decode()
        if "<" in s:
            for special in self.merges.specials:
                if special in s:
                    return s.count(special) + sum(self.count(part.encode()) for part in s.split(special))
        if s.isascii():
            return self.run(s.lower())
        return self.run("".join([c.lower() for c in unicodedata.normalize("NFC", s)]))
