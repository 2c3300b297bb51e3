import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from llm_cases import AWKWARD, frame
from tokenizers import Tokenizer

from gravelock.llm.packing import CAPACITY, SumOfSquares, pack
from gravelock.llm import tokens, transducer
from gravelock.llm.tokens import ChunkScan, WordCounts, WordTokens, token_counts
from gravelock.llm.transducer import Transducer

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_words_equal_the_library(library, sf_dir):
    table = WordTokens(PATH)
    rng = random.Random(1)
    alphabet = "aB'sè É\n ́İσΣ1½<|>endoftxt漢😀​\u0085.ſK-"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(3000)]
    texts += ["it's we'll <|endoftext|> x<|startoftext|>y"] + [r[1] or "" for r in AWKWARD]
    texts += pq.read_table(f"{sf_dir}/documents.parquet")["text"].to_pylist()
    for t in texts:
        assert np.frombuffer(table.ids(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_each_way_to_a_word_equals_the_library(library, monkeypatch):
    rng = random.Random(5)
    latin = [chr(c) for c in range(0x21, 0x190)]
    texts = [a + b + "e" for a in ("", "x", "'", "1") for b in latin] + ["".join(rng.choices(latin, k=rng.randint(1, 9))) for _ in range(4000)]
    texts += ["Größe" * k + tail for k in (1, 51, 52, 90) for tail in ("", ".", "<|endoftext|>", "<|endoftext|", "ß<|startoftext|>é")]
    for most in (150_000, 3):  # pieces are forgotten again and again
        monkeypatch.setattr(tokens, "MAX_PIECES", most)
        table = WordTokens(PATH)
        for t in texts:
            assert np.frombuffer(table.ids(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_latin_words_are_not_given_to_the_whole_library():
    table = WordTokens(PATH)
    table.split = table.library = None
    assert all(table.ids(t) for t in ("plain", "it's", "Größe", "x1,y2;"))


def test_the_transducer_counts_as_the_library_does(library, sf_dir, monkeypatch):
    rng = random.Random(2)
    alphabet = "aB'sè É\n ́İσΣ1½<|>endoftxt漢😀​\u0085.ſK-rvl'"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(rng.choices("abcdeinorst", k=rng.randint(30, 300))) for _ in range(300)]
    texts += ["".join(chr(c) for c in (rng.randint(0, 0x3000) for _ in range(rng.randint(1, 12)))) for _ in range(3000)]
    texts += ["it's we'll 're'x '' 'r 'rx '1 a'v <|endoftext|> x<|startoftext|>y"] + pq.read_table(f"{sf_dir}/documents.parquet")["text"].to_pylist()[:120]
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    for most in (10**6, 500):  # states are forgotten again and again
        monkeypatch.setattr(transducer, "MAX_STATES", most)
        machine = Transducer(PATH)
        assert [sum(map(machine.count, (t or "").encode().split())) for t in texts] == want


def test_pieces_count_as_the_library_does(library, sf_dir, monkeypatch):
    rng = random.Random(6)
    latin = [chr(c) for c in range(0x21, 0x190)]
    texts = [a + b + "e" for a in ("", "x", "'", "1") for b in latin] + ["".join(rng.choices(latin, k=rng.randint(1, 9))) for _ in range(3000)]
    texts += ["".join(rng.choices("abcdeinorst", k=rng.randint(1, 256))) for _ in range(500)]
    texts += ["Größe" * k + tail for k in (1, 36, 37, 90) for tail in ("", ".", "<|endoftext|>", "<|endoftext|", "ß<|startoftext|>é")]
    texts += pq.read_table(f"{sf_dir}/documents.parquet")["text"].to_pylist()[:300]
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    for most in (10**6, 40):  # states, pairs and pieces are forgotten again and again
        monkeypatch.setattr(transducer, "MAX_STATES", most)
        monkeypatch.setattr(transducer, "MAX_PAIRS", most)
        monkeypatch.setattr(tokens, "MAX_PIECES", most)
        machine = ChunkScan(WordCounts(PATH).__getitem__)
        assert [machine.total((t or "").encode()) for t in texts] == want


def test_a_piece_is_counted_once_whatever_stands_beside_it(library):
    table, seen = WordCounts(PATH), []
    whole, piece = table.machine.count, table.machine.piece
    table.machine.count = lambda word: seen.append(word) or whole(word)
    table.machine.piece = lambda p: seen.append(p) or piece(p)
    words = ("undschkeit", "Undschkeit.", "(undschkeit)", "undschkeit,ocióna", "Ocióna.")
    assert [table[w.encode()] for w in words] == [len(library.encode(w, add_special_tokens=False).ids) for w in words]
    assert [x.decode() for x in seen] == ["undschkeit", ".", "(", ")", ",", "ocióna"]


def test_chunk_maps_compose_wherever_cut(library):
    machine = ChunkScan(WordCounts(PATH).__getitem__)
    for t in [r[1] or "" for r in AWKWARD if len(r[1] or "") < 2000]:
        want = len(library.encode(t, add_special_tokens=False).ids)
        for chunk in (1, 2, 3, 5, 7, 64, 10**6):
            # cut inside characters too: only whole words are ever decoded
            assert machine.total(t.encode(), chunk) == want


def test_token_counts(spark, library):
    got = token_counts(frame(spark, AWKWARD), PATH, limit=100).collect()
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 100) for i, t, _ in AWKWARD]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts(frame(spark, []), PATH).count() == 0


def held(rows, docs, library):
    """Every id once, windows gapless and full but at powers of two."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    want = {}
    for i, t, *_ in docs:
        want.setdefault(i, []).append([*library.encode(t or "", add_special_tokens=False).ids, 2])
    assert set(by_doc) == set(want)
    for i, pieces in by_doc.items():
        copies = want[i]
        assert all(len(c) == len(copies[0]) for c in copies) or len(copies) == 1
        covered = np.zeros(len(copies[0]), int)
        for p in pieces:
            assert p.doc_tokens == len(copies[0])
            covered[p.start : p.start + p.length] += 1
            assert p.ids_crc32 == zlib.crc32(np.array(copies[0][p.start : p.start + p.length], "<u4").tobytes())
        assert (covered == len(copies)).all()
    pad = total = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= CAPACITY
        total += at
        pad += 0 if at & (at - 1) == 0 else CAPACITY - at
    return pad, total


def test_pack(spark, library, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for max_open in (2048, 3):
        pad, total = held(pack(docs.repartition(3), PATH, max_open=max_open).collect(), rows, library)
        assert pad == 0 and total > 100_000
    held(pack(frame(spark, AWKWARD), PATH).collect(), AWKWARD, library)
    assert pack(frame(spark, []), PATH).count() == 0


def test_level_choice_is_the_least_sum_of_squares():
    rng = random.Random(3)
    packer = SumOfSquares(64, 10**6)
    for i in range(500):
        s = rng.randint(1, 63)
        n = packer.level.copy()
        best = None
        for h in range(0, 64 - s + 1):
            if h and not n[h]:
                continue
            m = n.copy()
            if h:
                m[h] -= 1
            if h + s < 64:
                m[h + s] += 1
            best = min(best, (m[1:64] ** 2).sum()) if best is not None else (m[1:64] ** 2).sum()
        list(packer.add(i, memoryview(b"\0" * 4 * s)))
        assert (packer.level[1:64] ** 2).sum() == best
        assert [len(w) for w in packer.open] == packer.level[:64].tolist()
