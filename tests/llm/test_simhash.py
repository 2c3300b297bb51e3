import random

import numpy as np
import xxhash
from llm_cases import AWKWARD, frame

from gravelock.llm import copies
from gravelock.llm.graphs import components
from gravelock.llm.simhash import cell_masks, deduplicated, links, near_copies, near_duplicates, signed


def brute_fp(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(ids, fps, bits=2):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    a = np.array(fps, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= bits) + i + 1:
            x, y = find(i), find(int(j))
            root[max(x, y)] = min(x, y)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return [least[find(i)] for i in range(len(ids))]


def held(spark, rows):
    got = sorted(map(tuple, near_duplicates(frame(spark, rows)).collect()), key=str)
    fps = [brute_fp(t) for _, t in rows]
    want = sorted(((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, brute_groups([r[0] for r in rows], fps), strict=True)), key=str)
    assert got == want


def test_near_duplicates_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rng = random.Random(1)
    for i, t in docs[:60]:
        words = (t or "").split()
        if words:
            words[rng.randrange(len(words))] = "edited"
            docs.append((5000 + i, " ".join(words)))
    held(spark, docs + [(9000, ""), (9001, None), (9002, docs[0][1])])


def test_awkward(spark):
    held(spark, [r[:2] for r in AWKWARD])
    assert near_duplicates(frame(spark, [])).count() == 0


def test_links_join_the_same_classes_in_dense_and_in_thin_cells(spark):
    rng = random.Random(2)
    fps = []
    for _ in range(12):
        centre = rng.getrandbits(64)
        fps += [centre] + [centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(60)]
    fps = sorted({*fps, *(rng.getrandbits(64) for _ in range(300))})
    want = brute_groups(list(range(len(fps))), fps)
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    place = {signed(f): i for i, f in enumerate(fps)}
    for dense in (64, 1):
        root = {r.node: r.root for r in components(links(df, dense)).collect()}
        least = {}
        for f, i in place.items():
            r = root.get(f, f)
            least[r] = min(least.get(r, i), i)
        assert [least[root.get(signed(f), signed(f))] for f in fps] == want
    assert len(cell_masks()) == 15


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, 200 + i) for i in range(300)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)] + [(5, 5), (-3, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {x: find(x) for x in {y for e in edges for y in e if e[0] != e[1]}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_copies_and_what_stays(spark):
    rng = random.Random(6)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows, group = [], {}
    for g in range(12):
        base = text(150 + 20 * g)
        for c in range(1 if g % 3 == 0 else 5):
            words = list(base)
            if c:
                for _ in range(max(1, len(words) // 100)):
                    words[rng.randrange(len(words))] = "edit"
            group[len(rows)] = g
            rows.append((len(rows), " ".join(words)))
    far = text(200)
    rows += [(900, " ".join(far)), (901, " ".join(far[:100] + text(100)))]
    group |= {900: 100, 901: 101}
    got = dict(map(tuple, near_copies(frame(spark, rows)).collect()))
    first = {}
    for i, g in sorted(group.items()):
        first.setdefault(g, i)
    assert got == {i: first[g] for i, g in group.items()}
    d = frame(spark, [*rows, rows[0], rows[0]])
    out = deduplicated(d)
    assert out.columns == d.columns and sorted(r.doc_id for r in out.collect()) == sorted(first.values())
    assert deduplicated(frame(spark, [])).count() == 0
    assert sorted((r.doc_id for r in deduplicated(frame(spark, AWKWARD)).collect()), key=str) == sorted([-9, 1, 2, 6, 7, 8, None], key=str)


def shingles(text):
    words = text.encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def copy_groups(rows):
    """Components of the rows by Jaccard similarity of 0.8 or more, and by fingerprints two bits apart."""
    sets, fps = [shingles(t) for _, t in rows], [brute_fp(t, 5) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if 9 * common >= 4 * (len(sets[i]) + len(sets[j])) or bin(fps[i] ^ fps[j]).count("1") <= 2:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


def edited(rng, words, at):
    out = list(words)
    for i in at:
        out[i] = f"e{rng.randrange(10**6)}"
    return out


def test_near_copies_find_every_pair(spark):
    rng = random.Random(8)
    text = lambda n: [f"w{rng.randrange(10**5)}" for _ in range(n)]
    rows = []
    add = lambda words: rows.append((len(rows), " ".join(words)))
    # A passage that many texts share, and pairs of copies whose other words are few.
    passage = text(160)
    for _ in range(40):
        add(passage + text(rng.randrange(5, 200)))
    for _ in range(12):
        own = text(48)
        add(passage + own)
        add(passage + edited(rng, own, [rng.randrange(10, 40)]))
    # Short texts with one edit, and copies of a text that is itself far from each.
    for _ in range(40):
        base = text(64)
        add(base)
        add(edited(rng, base, [rng.randrange(6, 58)]))
    for _ in range(20):
        first = text(150)
        middle = edited(rng, first, range(3, 150, 30))
        add(first)
        add(edited(rng, middle, [70]))
        add(edited(rng, middle, [100]))
    # A large group, none a copy of one centre only.
    chain = text(120)
    for i in range(40):
        chain = edited(rng, chain, [i * 7 % 120])
        add(chain)
    got = dict(map(tuple, near_copies(frame(spark, rows)).collect()))
    assert got == copy_groups(rows)


def test_near_copies_take_the_exact_similarity(spark):
    rng = random.Random(9)
    rows = []
    for i in range(42):
        words = [f"w{rng.randrange(10**5)}" for _ in range(1000)]
        # 5 x 22 of 996 shingles changed is a similarity just over 0.8.
        for t in (words, edited(rng, words, rng.sample(range(5, 990, 6), 19 + i % 7))):
            rows.append((len(rows), " ".join(t)))
    got = dict(map(tuple, near_copies(frame(spark, rows)).collect()))
    assert got == copy_groups(rows)


def test_one_row_of_each_group_stays(spark):
    text = lambda k: " ".join(f"t{k}x{j}" for j in range(90))
    edited = text(1).replace("t1x40", "other")
    rows = [(7, text(1)), (3, edited), (3, text(2)), (3, text(2)), (None, text(2)), (None, text(5)), (None, text(5)), (9, None), (8, ""), (4, " \n "), (5, text(6)), (5, text(7))]
    rows += [(100 + i, text(8)) for i in range(50)]
    docs = frame(spark, rows)
    got = deduplicated(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(3, edited), (3, text(2)), (None, text(5)), (4, " \n "), (5, text(6)), (5, text(7)), (100, text(8))], key=str)


def test_late_pairs_that_cannot_be_alike_are_not_made(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(5, 145), 3):
            words[at] = f"edit{i}of{at}"
        rows.append((i, " ".join(words)))
    rows += [(100 + k, rows[0][1].replace("w149", f"end{k}")) for k in range(3)]
    made, verified = [], copies.verified
    monkeypatch.setattr(copies, "verified", lambda pairs, features: made.append(pairs.count()) or verified(pairs, features))
    assert dict(map(tuple, near_copies(frame(spark, rows)).collect())) == copy_groups(rows)
    assert made[-1] < 200


def test_parity_bits_never_exclude_a_pair():
    rng = np.random.default_rng(4)
    for n in (1, 9, 60, 400, 3000):
        a = rng.integers(-(1 << 63), 1 << 63, n)
        b = np.concatenate([a[: n - n // 9], rng.integers(-(1 << 63), 1 << 63, n // 9)])
        bits = [np.bincount(x & (64 * copies.PARITY - 1), minlength=64 * copies.PARITY) & 1 for x in (a, b)]
        assert (bits[0] != bits[1]).sum() <= len(set(a) ^ set(b))
