import hashlib
import random

import numpy as np
from llm_cases import AWKWARD, frame

from gravelock.llm import suffix
from gravelock.llm.suffix import column_order, least_between, pieces_of, runs, suffix_dedup


def brute(docs, window=100):
    """docs: (doc_id, text) in order -> removed bytes as bool arrays."""
    seen, out = set(), []
    for _, text in docs:
        x = (text or "").encode()
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - window + 1):
            w = x[i : i + window]
            if w in seen:
                gone[i : i + window] = True
            seen.add(w)
        out.append((x, gone))
    return out


def expected(docs):
    rows = []
    for (doc_id, _), (x, gone) in zip(docs, brute(docs), strict=True):
        kept = np.frombuffer(x, np.uint8)[~gone].tobytes()
        rows.append((doc_id, len(x), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return rows


def planted(seed, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 6)))
    shared = [" ".join(word() for _ in range(rng.randint(20, 80))) for _ in range(6)]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts.append(rng.choice(shared)[rng.randint(0, 40) :] if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(1, 60))))
        docs.append((i * 3, " ".join(parts)))
    docs += [(1000, docs[3][1]), (1001, docs[4][1]), (1002, "a" * 350), (1003, "ab" * 130 + "a" * 120), (1004, "a" * 100), (1005, "x" * 99), (1006, shared[0] * 4), (1007, None)]
    return docs


def test_pieces_cover_each_window_once_and_depend_on_content_only():
    rng = np.random.default_rng(0)
    for x in (rng.integers(97, 100, 1500), np.full(400, 97), np.tile(rng.integers(0, 256, 7), 90), rng.integers(0, 256, 100)):
        x = x.astype(np.uint8)
        start, windows, anchor, _ = pieces_of(x)
        assert start[0] == 0 and (start[1:] == (start + windows)[:-1]).all() and start[-1] + windows[-1] == len(x) - 99
        of = {}
        for s, w, a in zip(start, windows, anchor, strict=True):
            for i in range(s, s + w):
                assert i <= a <= i + 76
                assert of.setdefault(x[i : i + 100].tobytes(), a - i) == a - i
    assert not len(pieces_of(np.zeros(99, np.uint8))[0])


def test_least_between_and_runs():
    rng = np.random.default_rng(1)
    for _ in range(200):
        m = int(rng.integers(1, 30))
        symbol, common = rng.integers(0, 4, m), rng.integers(0, 9, m).astype(np.int32)
        by = np.argsort(symbol, kind="stable")
        s = symbol[by]
        first = np.append(True, s[1:] != s[:-1])
        got = least_between(common, np.where(first, by, np.concatenate(([0], by[:-1] + 1))), by + 1, first)
        for k in range(m):
            if not first[k]:
                assert got[k] == common[by[k - 1] + 1 : by[k] + 1].min()
    s, e = runs(np.array([5, 0, 7, 20]), np.array([8, 5, 9, 30]))
    assert s.tolist() == [0, 20] and e.tolist() == [9, 30]


def test_columns_find_every_later_window():
    rng = random.Random(5)
    for _ in range(30):
        base = [bytes(rng.choices(b"ab", k=12)) for _ in range(3)]
        anchor_text = b"ANCHOR"
        pieces, anchors = [], []
        for _ in range(rng.randint(1, 12)):
            left, right = rng.choice(base)[rng.randint(0, 9) :], rng.choice(base)[: rng.randint(0, 12)]
            pieces.append(left + anchor_text + right)
            anchors.append(len(left))
        rank = np.array(rng.sample(range(len(pieces)), len(pieces)))
        w = 8
        got = {(int(p), int(a)) for who, at in column_order(pieces, np.array(anchors), rank, w) for p, a in zip(who, at, strict=True)}
        want = set()
        for p, (x, a) in enumerate(zip(pieces, anchors, strict=True)):
            for i in range(len(x) - w + 1):
                for q, (y, b) in enumerate(zip(pieces, anchors, strict=True)):
                    j = i - a + b
                    if rank[q] < rank[p] and 0 <= j <= len(y) - w and y[j : j + w] == x[i : i + w]:
                        want.add((p, i))
        assert got == want


def test_against_brute_force(spark, monkeypatch):
    for seed, hot, batch in ((1, 20_000, 1 << 22), (2, 3, 1 << 22), (3, 20_000, 1)):
        monkeypatch.setattr(suffix, "HOT", hot)
        monkeypatch.setattr(suffix, "BATCH", batch)
        docs = planted(seed)
        got = suffix_dedup(frame(spark, docs).repartition(3)).drop("spans").collect()
        assert sorted(map(tuple, got)) == sorted(expected(docs))


def test_awkward(spark):
    rows = [(i, t) for i, t, *_ in AWKWARD]
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    got = suffix_dedup(frame(spark, rows)).drop("spans").collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected(ordered), key=str)
    assert suffix_dedup(frame(spark, [])).count() == 0
